"""Metrics of ranked lists. Undefined is null, never zero; unjudged items count as zero only where an operator says so.

Runs are run(route, query_id, comment_id, rank, ...), gold sets gold(query_id, comment_id), judgments
judged(query_id, comment_id, utility). Every metric is one aggregation per list after one join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import average_rank, ranked, top_k

PAIR = ["query_id", "comment_id"]
LIST = ["route", "query_id"]


def gain(utility: Column) -> Column:
    """2^u - 1, of negative utilities 0; null for null."""
    return F.when(utility.isNotNull(), F.pow(F.lit(2.0), F.greatest(utility, F.lit(0.0))) - 1)


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1.0)


def ideal_binary(n: Column, k: int) -> Column:
    """Discounted gain of min(n, k) hits at the top."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def binary_metrics(run: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(route, query_id, n_gold, mrr, ap, and recall_k, precision_k, f1_k, hit_k, ndcg_k, joint_k for each k).

    All queries of the run; without gold every metric is 0. Precision divides by k, also for shorter lists; k <= 0 is 0.
    joint_k: whether all gold is among the first k.
    """
    golds = gold.select(*PAIR).distinct()
    sizes = golds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = run.join(golds.withColumn("hit", F.lit(1)), PAIR, "left").join(sizes, "query_id", "left")
    from pyspark.sql import Window as W

    hits_so_far = F.sum(F.coalesce("hit", F.lit(0))).over(W.partitionBy(*LIST).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("so_far", hits_so_far)
    hit = F.col("hit") == 1
    n = F.coalesce(F.max("n_gold"), F.lit(0))
    out = [n.alias("n_gold"), F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
           F.when(n > 0, F.sum(F.when(hit, F.col("so_far") / F.col("rank")).otherwise(0.0)) / n).otherwise(F.lit(0.0)).alias("ap")]
    for k in ks:
        inside = hit & (F.col("rank") <= k)
        hits = F.count_if(inside)
        recall = F.when(n > 0, hits / n).otherwise(F.lit(0.0))
        precision = hits / F.lit(float(k)) if k > 0 else F.lit(0.0)
        f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
        dcg = F.sum(F.when(inside, discount(F.col("rank"))).otherwise(0.0))
        out += [recall.alias(f"recall_{k}"), precision.alias(f"precision_{k}"), f1.alias(f"f1_{k}"), F.when(hits > 0, 1).otherwise(0).alias(f"hit_{k}"),
                F.when(n > 0, dcg / ideal_binary(n.cast("int"), k)).otherwise(F.lit(0.0)).alias(f"ndcg_{k}"), F.when((n > 0) & (hits == n), 1).otherwise(0).alias(f"joint_{k}")]
    return marked.groupBy(*LIST).agg(*out)


def mean_metrics(per_query: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Means over queries of every number, nulls left out, rounded."""
    skip = {*by, "query_id"}
    numbers = [c for c, t in per_query.dtypes if c not in skip and t in ("double", "float", "int", "bigint")]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), digits).alias(c) for c in numbers])


def ideal_gains(judged: DataFrame, k: int) -> DataFrame:
    """(query_id, idcg): discounted gain of the k best judged items."""
    best = top_k(judged.filter(F.col("utility").isNotNull()), ["query_id"], [F.desc("utility"), "comment_id"], k, "at")
    return best.groupBy("query_id").agg(F.sum(gain(F.col("utility")) * discount(F.col("at"))).alias("idcg"))


def graded_ndcg(run: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(route, query_id, ndcg): gains 2^u - 1 against the ideal over all judged items; unjudged gains are 0; no judged
    gain gives 0."""
    top = run.filter(F.col("rank") <= k).join(judged.select(*PAIR, "utility"), PAIR, "left")
    dcg = top.groupBy(*LIST).agg(F.sum(F.coalesce(gain(F.col("utility")), F.lit(0.0)) * discount(F.col("rank"))).alias("dcg"))
    value = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0))
    return dcg.join(ideal_gains(judged, k), "query_id", "left").select(*LIST, value.alias("ndcg"))


def condensed_ndcg(run: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """As graded_ndcg, but over the judged items of the list only, moved up; null without any."""
    known = ranked(run.join(judged.filter(F.col("utility").isNotNull()).select(*PAIR, "utility"), PAIR).withColumnRenamed("rank", "was"), LIST, ["was"])
    dcg = known.filter(F.col("rank") <= k).groupBy(*LIST).agg(F.sum(gain(F.col("utility")) * discount(F.col("rank"))).alias("dcg"))
    return dcg.join(ideal_gains(judged, k), "query_id").select(*LIST, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).alias("ndcg"))


def set_utility(run: DataFrame, judged: DataFrame, k: int, good: float = 4.0) -> DataFrame:
    """(route, query_id, n, n_judged, complete, utility, good_share): the mean utility of the first k items and the share
    of at least `good`, both null unless these are k different items that are all judged."""
    top = run.filter(F.col("rank") <= k).join(judged.select(*PAIR, "utility"), PAIR, "left")
    n, known = F.count_distinct("comment_id"), F.count("utility")
    complete = (n == k) & (known == k)
    return top.groupBy(*LIST).agg(
        n.alias("n"), known.alias("n_judged"), complete.alias("complete"), F.when(complete, F.avg("utility")).alias("utility"),
        F.when(complete, F.avg((F.col("utility") >= good).cast("double"))).alias("good_share"),
    )


def oracle_utility(pool: DataFrame, judged: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, n_judged, oracle): mean utility of the k best judged items of the pool; null with fewer than k."""
    known = pool.select(*PAIR).distinct().join(judged.filter(F.col("utility").isNotNull()).select(*PAIR, "utility"), PAIR)
    best = top_k(known, ["query_id"], [F.desc("utility"), "comment_id"], k)
    counts = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_judged"))
    means = best.groupBy("query_id").agg(F.avg("utility").alias("m"))
    return counts.join(means, "query_id").select("query_id", "n_judged", F.when(F.col("n_judged") >= k, F.col("m")).alias("oracle"))


def within_query_spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, rho): Spearman correlation with average ranks; null with fewer than 3 rows or a constant side."""
    keys = keys or ["query_id"]
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rows.withColumn("__x", average_rank(F.col(x), keys)).withColumn("__y", average_rank(F.col(y), keys))
    n, sx, sy = F.count(F.lit(1)), F.sum("__x"), F.sum("__y")
    sxy, sxx, syy = F.sum(F.col("__x") * F.col("__y")), F.sum(F.col("__x") ** 2), F.sum(F.col("__y") ** 2)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return r.groupBy(*keys).agg(n.alias("n"), F.when((n >= 3) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy)).alias("rho"))


def pairwise_accuracy(df: DataFrame, score: str, utility: str, margin: float = 1.0) -> DataFrame:
    """(query_id, pairs, accuracy): of the pairs of a query whose utilities differ by the margin, the share in which the
    better one has the larger score; equal scores are wrong. Pairs stay within a query and are aggregated at once."""
    a = df.select("query_id", F.col(score).alias("sa"), F.col(utility).alias("ua")).filter("ua IS NOT NULL")
    b = df.select("query_id", F.col(score).alias("sb"), F.col(utility).alias("ub")).filter("ub IS NOT NULL")
    pairs = a.join(b, "query_id").filter(F.col("ua") - F.col("ub") >= margin)
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("sa") > F.col("sb")).cast("double")).alias("accuracy"))


def alignment(candidates: DataFrame, replies: DataFrame, threshold: float) -> DataFrame:
    """(query_id, cra, rcc, best, coverage, f1) from unit vectors: candidates (query_id, vec) and replies (query_id, vec).

    cra: mean over candidates of the largest similarity to a reply; rcc: mean over replies of the largest to a
    candidate; best: the largest of all; coverage: share of replies with one of at least the threshold. Each query's
    candidates are a fixed-size set, so pairs stay in proportion to the replies.
    """
    from rankloom.functions.vectors import cosine

    c = candidates.select("query_id", F.col("comment_id").alias("c"), F.col("vec").alias("cv"))
    r = replies.select("query_id", F.col("reply_id").alias("r"), F.col("vec").alias("rv"))
    pairs = c.join(r, "query_id").withColumn("s", cosine(F.col("cv"), F.col("rv")))
    by_c = pairs.groupBy("query_id", "c").agg(F.max("s").alias("m")).groupBy("query_id").agg(F.avg("m").alias("cra"), F.max("m").alias("best"))
    by_r = pairs.groupBy("query_id", "r").agg(F.max("s").alias("m")).groupBy("query_id").agg(F.avg("m").alias("rcc"), F.avg((F.col("m") >= threshold).cast("double")).alias("coverage"))
    f1 = F.when(F.col("cra") + F.col("rcc") > 0, 2 * F.col("cra") * F.col("rcc") / (F.col("cra") + F.col("rcc"))).otherwise(F.lit(0.0))
    return by_c.join(by_r, "query_id").withColumn("f1", f1)


def average_linkage(v: np.ndarray, weight: np.ndarray, distance: float) -> list[list[int]]:
    """Clusters of the rows of v, which count `weight` times: the two of the least mean cosine distance join while it is at
    most `distance`; of equal ones those of the first rows.

    The mean distance of two clusters follows from the sums of their vectors, so only these are kept, and of each cluster
    the nearest later one.
    """
    sums, n = v * weight[:, None], weight.astype(float)
    groups, alive = [[i] for i in range(len(v))], np.ones(len(v), dtype=bool)
    least, to = np.full(len(v), np.inf), np.zeros(len(v), dtype=int)

    def gaps(i: int) -> np.ndarray:
        return np.where(alive, np.round(1 - (sums @ sums[i]) / (n * n[i]), 12), np.inf)

    def look(i: int, gap: np.ndarray) -> None:
        if i + 1 < len(v):
            to[i] = i + 1 + int(gap[i + 1 :].argmin())
            least[i] = gap[to[i]]

    for i in range(len(v)):
        look(i, gaps(i))
    while len(v) and least[i := int(least.argmin())] <= distance:
        j = int(to[i])
        groups[i] += groups[j]
        sums[i], n[i] = sums[i] + sums[j], n[i] + n[j]
        alive[j], least[j] = False, np.inf
        gap = gaps(i)
        least[i] = np.inf
        look(i, gap)
        for k in np.flatnonzero(alive[:j]):
            if k != i and to[k] in (i, j):
                look(k, gaps(k))
            elif k < i and (gap[k], i) < (least[k], to[k]):
                least[k], to[k] = gap[k], i
    return [g for g, a in zip(groups, alive) if a]


def cluster_balanced_coverage(candidates: DataFrame, replies: DataFrame, distance: float = 0.6, most: int | None = None) -> DataFrame:
    """(query_id, clusters, rcc): mean over clusters of replies of the mean, over a cluster's replies, of the largest
    similarity to a candidate, so that many replies that say the same count as one view.

    Clusters join while their mean cosine distance is at most `distance` (average linkage). Merging needs a query's
    replies at once; equal vectors are merged before and count by their number. `most`: only the first replies by id, for
    capped references; all by default.
    candidates: (query_id, comment_id, vec), replies: (query_id, reply_id, vec), unit vectors.
    """
    import pandas as pd

    from rankloom.functions.vectors import cosine

    known = replies.filter(F.col("vec").isNotNull())
    if most is not None:
        known = top_k(known, ["query_id"], ["reply_id"], most, "__p")
    c = candidates.select("query_id", F.col("vec").alias("cv"))
    known = known.groupBy("query_id", "reply_id").agg(F.min("vec").alias("vec")).groupBy("query_id", "vec").agg(F.min("reply_id").alias("reply_id"), F.count(F.lit(1)).alias("n"))
    near = known.join(c, "query_id").groupBy("query_id", "reply_id").agg(F.max(cosine(F.col("vec"), F.col("cv"))).alias("m"), F.first("vec").alias("vec"), F.first("n").alias("n"))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("reply_id")
        v, n, m = np.array([np.asarray(x, dtype=float) for x in g["vec"]]), g["n"].to_numpy(), g["m"].to_numpy()
        apart = 1 - (v * v).sum(axis=1) > min(distance, 1e-6)  # no unit vectors, which are not near themselves
        times = np.where(apart, n, 1)
        v, m, n = np.repeat(v, times, axis=0), np.repeat(m, times), np.repeat(np.where(apart, 1, n), times)
        groups = average_linkage(v, n, distance)
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]], "clusters": [len(groups)], "rcc": [float(np.mean([np.average(m[x], weights=n[x]) for x in groups]))]})

    return near.groupBy("query_id").applyInPandas(merge, f"query_id {dict(near.dtypes)['query_id']}, clusters int, rcc double")
