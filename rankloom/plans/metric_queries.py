"""Queries of single metrics, paired statistics, resampled intervals, samples and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.functions import utility as ut
from rankloom.operators import metrics, ranking, sampling, setops, stats

from . import tables as t
from .contract_queries import _LOPO, labelled, lopo_run
from .measure_queries import _DELTA, _IDEAL, _LABELLED, _MARKED, _PER, _deltas, _spearman, bootstrapped, drawn
from .order_queries import _SYSTEM_ROWS, _SYSTEMS, _TWO, system_rows, union
from .record_queries import _MD5
from .scan_queries import big, r6
from .study_queries import _RULES, gold_rules
from .tables import PAIR, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# single metrics: each over the stored dense and BM25 lists, with its own edge


def _marked_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t.run(spark, d), t.gold(spark, d)


_RUN_MARKED = _MARKED.replace("FROM routes r", "FROM run r")
_HITS = "count(CASE WHEN hit = 1 AND rank <= {k} THEN 1 END)"
_GOLDS = "coalesce(max(n_gold), 0)"


def _metric(name: str, oracle: str, columns: dict[str, str], ks: list[int], doc: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = metrics.binary_metrics(*_marked_run(spark, d), ks)
        return m.select("route", "query_id", *[r6(c, n) if dict(m.dtypes)[c] == "double" else F.col(c).cast("bigint").alias(n) for n, c in columns.items()])

    run.__doc__ = doc
    QUERIES[name] = run
    ORACLE[name] = sql(f"SELECT route, query_id, {oracle} FROM marked GROUP BY ALL", "run", "gold", marked=_RUN_MARKED)


def _recall(k: int) -> str:
    return f"(CASE WHEN {_GOLDS} > 0 THEN {_HITS.format(k=k)} / CAST(max(n_gold) AS DOUBLE) ELSE 0.0 END)"


def _precision(k: int) -> str:
    return f"({_HITS.format(k=k)} / {float(k)})" if k > 0 else "0.0"


_metric("h1_recall", f"round({_recall(10)}, 6) AS recall_10, round({_recall(100)}, 6) AS recall_100", {"recall_10": "recall_10", "recall_100": "recall_100"}, [10, 100], "Recall; without gold it is 0.")
_metric("h2_precision", f"round({_precision(10)}, 6) AS precision_10, round({_precision(200)}, 6) AS precision_200, {_precision(0)} AS precision_0", {"precision_10": "precision_10", "precision_200": "precision_200", "precision_0": "precision_0"}, [10, 200, 0], "Precision divides by k, also where the list is shorter; k = 0 gives 0.")
_metric("h3_f1", f"round(CASE WHEN {_recall(10)} + {_precision(10)} > 0 THEN 2 * {_recall(10)} * {_precision(10)} / ({_recall(10)} + {_precision(10)}) ELSE 0 END, 6) AS f1_10", {"f1_10": "f1_10"}, [10], "The harmonic mean of recall and precision.")
_metric("h4_hits", f"CAST(CASE WHEN {_HITS.format(k=5)} > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_5, CAST(CASE WHEN {_HITS.format(k=50)} > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_50", {"hit_5": "hit_5", "hit_50": "hit_50"}, [5, 50], "Whether any gold item is among the first.")
_metric("h5_mrr", "round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 6) AS mrr", {"mrr": "mrr"}, [], "One over the rank of the first gold item, 0 if there is none.")
_metric("h8_average_precision", f"round(CASE WHEN {_GOLDS} > 0 THEN sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) / max(n_gold) ELSE 0 END, 6) AS ap", {"ap": "ap"}, [], "Precision at each gold item over the number of gold items.")
_metric("h13_joint_success", f"CAST(CASE WHEN {_GOLDS} > 0 AND {_HITS.format(k=20)} = max(n_gold) THEN 1 ELSE 0 END AS BIGINT) AS joint_20", {"joint_20": "joint_20"}, [20], "Whether all gold is among the first twenty.")


def _ndcg(k: int) -> str:
    ideal = f"list_sum(list_transform(range(1, CAST(greatest(1, least(max(n_gold), {k})) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"
    return f"(CASE WHEN {_GOLDS} > 0 THEN sum(CASE WHEN hit = 1 AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / {ideal} ELSE 0 END)"


_metric("h6_binary_ndcg", f"round({_ndcg(10)}, 6) AS ndcg_10, round({_ndcg(100)}, 6) AS ndcg_100", {"ndcg_10": "ndcg_10", "ndcg_100": "ndcg_100"}, [10, 100], "Discounted gain of hits against the ideal of as many gold items.")
_metric("h11_former_names", f"round({_recall(10)}, 6) AS \"Recall@10\", round({_ndcg(10)}, 6) AS \"nDCG@10\", round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 6) AS \"MRR\"", {"Recall@10": "recall_10", "nDCG@10": "ndcg_10", "MRR": "mrr"}, [10], "Metrics under the names of older reports.")
_metric("h14_one_metric", f"round({_recall(5)}, 6) AS value", {"value": "recall_5"}, [5], "One metric of each query by its name.")

_GAIN = "(pow(2.0, greatest(utility, 0.0)) - 1)"
_BY_LOPO = "SELECT arm, query_id, CASE WHEN max(idcg) > 0 THEN sum(coalesce({g}, 0) / log2(place + 1)) / max(idcg) ELSE 0.0 END AS ndcg FROM (SELECT 'raw' AS arm, query_id, comment_id, rank AS place FROM l WHERE route = 'dense' AND rank <= 8 UNION ALL SELECT 'other_posts', query_id, comment_id, lopo FROM l WHERE route = 'dense' AND lopo <= 8) LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) LEFT JOIN ideal USING (query_id) GROUP BY ALL".format(g=_GAIN)


@query("h16_other_posts_only", sql("SELECT arm, query_id, round(ndcg, 6) AS ndcg FROM m", "run", "notes", "texts", "judged", l=_LOPO, ideal=_IDEAL, m=_BY_LOPO))
def h16(spark: SparkSession, d: str) -> DataFrame:
    """Graded gain of the raw list and of the list without the query's own post; unjudged items count 0 here."""
    rows = lopo_run(spark, d).filter("route = 'dense'")
    arms = {"raw": rows.filter("rank <= 8").select(*PAIR, "rank"), "other_posts": rows.filter("lopo <= 8").select(*PAIR, F.col("lopo").alias("rank"))}
    run = union(arms, "route", [*PAIR, "rank"])
    return metrics.graded_ndcg(run, t.judged(spark, d), 8).select(F.col("route").alias("arm"), "query_id", r6("ndcg", "ndcg"))


@query("h17_projected_routes", sql("SELECT route, count(*) AS queries, count(*) FILTER (n >= 8) AS full_lists, round(avg(u), 6) AS utility FROM (SELECT route, query_id, count(*) AS n, avg(utility) FILTER (place <= 8) AS u FROM (SELECT r.route, r.query_id, utility, row_number() OVER (PARTITION BY r.route, r.query_id ORDER BY rank) AS place FROM routes r JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL) GROUP BY ALL) GROUP BY 1", "routes", "judged"))
def h17(spark: SparkSession, d: str) -> DataFrame:
    """Routes over judged items only, moved up: how many have eight, and their mean utility."""
    rows = t.routes(spark, d).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).withColumnRenamed("rank", "was")
    placed = ranking.ranked(rows, ranking.KEYS, ["was"], "place")
    per = placed.groupBy(*ranking.KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("place") <= 8, F.col("utility"))).alias("u"))
    return per.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") >= 8).alias("full_lists"), r6(F.avg("u"), "utility"))


@query("h18_ranked_utilities", sql("SELECT query_id, round(avg(utility), 6) AS utility, round(avg(CASE WHEN label_relevance >= 4 AND label_usefulness >= 4 AND label_safety >= 4 THEN 1.0 ELSE 0.0 END), 6) AS reasonable FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(lexical, 0) DESC, comment_id) AS place FROM pool JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL) WHERE place <= 8 GROUP BY 1", "pool", "judged"))
def h18(spark: SparkSession, d: str) -> DataFrame:
    """Mean utility and the share of reasonable items among the first eight by a score."""
    rows = t.pool(spark, d).withColumn("s", F.coalesce("lexical", F.lit(0.0))).join(t.judged(spark, d).filter("utility IS NOT NULL"), PAIR)
    top = ranking.top_k(rows, ["query_id"], [F.desc("s"), "comment_id"], 8, "place")
    ok = (F.col("label_relevance") >= 4) & (F.col("label_usefulness") >= 4) & (F.col("label_safety") >= 4)
    return top.groupBy("query_id").agg(r6(F.avg("utility"), "utility"), r6(F.avg(F.when(ok, 1.0).otherwise(0.0)), "reasonable"))


@query("h19_rankings_by_ids", sql("SELECT route, count(*) AS queries, round(avg(u), 6) AS utility, round(avg(missing), 6) AS missing FROM (SELECT route, query_id, avg(utility) AS u, count(*) - count(utility) AS missing FROM routes LEFT JOIN judged USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL) GROUP BY 1", "routes", "judged"))
def h19(spark: SparkSession, d: str) -> DataFrame:
    """The same of given lists: mean of what is judged, and how many items are not."""
    rows = t.routes(spark, d).filter("rank <= 8").join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    per = rows.groupBy(*ranking.KEYS).agg(F.avg("utility").alias("u"), (F.count(F.lit(1)) - F.count("utility")).alias("missing"))
    return per.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("u"), "utility"), r6(F.avg("missing"), "missing"))


@query("h21_rule_votes", sql("SELECT votes, count(*) AS pairs, round(-(votes / 4.0) * log2(votes / 4.0) - CASE WHEN votes < 4 THEN (1 - votes / 4.0) * log2(1 - votes / 4.0) ELSE 0 END, 6) AS entropy FROM (SELECT query_id, comment_id, count(*) AS votes FROM r GROUP BY ALL) GROUP BY 1", "judged", r=_RULES))
def h21(spark: SparkSession, d: str) -> DataFrame:
    """In how many of four rules an item is gold, and how uncertain that leaves it."""
    votes = gold_rules(spark, d).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("pairs"))
    p = F.col("votes") / 4.0
    return votes.select("votes", "pairs", r6(-p * F.log2(p) - F.when(p < 1, (1 - p) * F.log2(1 - p)).otherwise(0.0), "entropy"))


@query("h22_model_disagreement", sql("SELECT query_id, comment_id, CAST(max(r) - min(r) AS BIGINT) AS spread, round(stddev_pop(r), 6) AS deviation, count(*) FILTER (r <= 8) AS heads FROM (SELECT query_id, comment_id, rank AS r FROM routes) GROUP BY ALL HAVING max(r) - min(r) >= 10", "routes"))
def h22(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose places in the routes are ten or more apart."""
    per = t.routes(spark, d).groupBy(*PAIR).agg((F.max("rank") - F.min("rank")).cast("bigint").alias("spread"), r6(F.stddev_pop("rank"), "deviation"), F.count_if(F.col("rank") <= 8).alias("heads"))
    return per.filter("spread >= 10").select(*PAIR, "spread", "deviation", "heads")


@query("h23_consensus_core", sql("SELECT route, count(*) AS queries, round(avg(h / CAST(n AS DOUBLE)), 6) AS recall FROM (SELECT o.route, c.query_id, count(*) FILTER (o.rank <= 8) AS h, count(*) AS n FROM (SELECT query_id, comment_id FROM gold ANTI JOIN (SELECT query_id, comment_id FROM routes GROUP BY ALL HAVING max(rank) - min(rank) >= 25) USING (query_id, comment_id)) c JOIN routes o USING (query_id, comment_id) GROUP BY ALL) GROUP BY 1", "routes", "gold"))
def h23(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each route once items on which the routes disagree most are left out; what is gold was fixed before."""
    run = t.routes(spark, d)
    apart = run.groupBy(*PAIR).agg((F.max("rank") - F.min("rank")).alias("s")).filter("s >= 25")
    rows = t.gold(spark, d).join(apart.select(*PAIR), PAIR, "left_anti").join(run, PAIR)
    per = rows.groupBy("route", "query_id").agg(F.count_if(F.col("rank") <= 8).alias("h"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), r6(F.avg(F.col("h") / F.col("n")), "recall"))


_H26 = "SELECT system, count(*) AS queries, count(utility) AS complete, round(avg(utility), 6) AS utility, round(avg(nullif(ndcg, 0)), 6) AS ndcg FROM m GROUP BY 1"


@query("h26_system_means", sql(_H26, "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m=_SYSTEM_ROWS))
def h26(spark: SparkSession, d: str) -> DataFrame:
    """Means of each named system over the queries where it is defined."""
    return system_rows(spark, d).groupBy("system").agg(F.count(F.lit(1)).alias("queries"), F.count("utility").alias("complete"), r6(F.avg("utility"), "utility"), r6(F.avg("ndcg"), "ndcg"))


_AT3 = f"SELECT route, query_id, count(utility) AS judged, avg(utility) AS utility, CASE WHEN max(i3) > 0 THEN sum({_GAIN} / log2(rank + 1)) / max(i3) END AS ndcg, CASE WHEN count(utility) = 3 THEN coalesce(1.0 / min(CASE WHEN utility >= 4.5 THEN rank END), 0) END AS mrr FROM routes LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) LEFT JOIN (SELECT query_id, sum({_GAIN} / log2(place + 1)) AS i3 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS place FROM judged WHERE utility IS NOT NULL) WHERE place <= 3 GROUP BY 1) USING (query_id) WHERE rank <= 3 GROUP BY ALL"


def at_three(spark: SparkSession, d: str) -> DataFrame:
    """(route, query_id, judged, utility, ndcg, mrr) of the first three: means of what is judged; mrr only if all are."""
    j = t.judged(spark, d)
    rows = t.routes(spark, d).filter("rank <= 3").join(j.select(*PAIR, "utility"), PAIR, "left").join(metrics.ideal_gains(j, 3), "query_id", "left")
    dcg = F.sum(metrics.gain(F.col("utility")) * metrics.discount(F.col("rank")))
    first = F.coalesce(1 / F.min(F.when(F.col("utility") >= 4.5, F.col("rank"))), F.lit(0.0))
    return rows.groupBy(*ranking.KEYS).agg(F.count("utility").alias("judged"), F.avg("utility").alias("utility"), F.when(F.max("idcg") > 0, dcg / F.max("idcg")).alias("ndcg"), F.when(F.count("utility") == 3, first).alias("mrr"))


@query("h27_metrics_at_three", sql("SELECT route, query_id, judged, round(utility, 6) AS utility, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM m", "routes", "judged", m=_AT3))
def h27(spark: SparkSession, d: str) -> DataFrame:
    return at_three(spark, d).select("route", "query_id", "judged", *[r6(c, c) for c in ("utility", "ndcg", "mrr")])


@query("h28_means_at_three", sql("SELECT route, count(*) AS queries, round(avg(utility), 6) AS utility, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(quantile_cont(utility, 0.5), 6) AS median_utility FROM m GROUP BY 1", "routes", "judged", m=_AT3))
def h28(spark: SparkSession, d: str) -> DataFrame:
    """Means over queries, undefined ones left out."""
    return at_three(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("queries"), *[r6(F.avg(c), c) for c in ("utility", "ndcg", "mrr")], r6(F.percentile("utility", 0.5), "median_utility"))


@query("h29_utility_of_eight", sql("SELECT route, query_id, round(avg(utility), 6) AS utility FROM routes JOIN judged USING (query_id, comment_id) WHERE rank <= 8 AND utility IS NOT NULL GROUP BY ALL HAVING count(DISTINCT comment_id) = 8", "routes", "judged"))
def h29(spark: SparkSession, d: str) -> DataFrame:
    """The mean utility of exactly eight judged items; other lists have no row."""
    s = metrics.set_utility(t.routes(spark, d), t.judged(spark, d), 8)
    return s.filter("complete").select("route", "query_id", r6("utility", "utility"))


@query("h30_utility_or_null", sql("SELECT query_id, round(CASE WHEN count(utility) = 8 AND count(*) = 8 THEN avg(utility) END, 6) AS utility, 8 - count(utility) AS missing FROM run LEFT JOIN judged USING (query_id, comment_id) WHERE route = 'bm25' AND rank <= 8 GROUP BY 1", "run", "judged"))
def h30(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.set_utility(t.run(spark, d).filter("route = 'bm25'"), t.judged(spark, d), 8)
    return s.select("query_id", r6("utility", "utility"), (8 - F.col("n_judged")).alias("missing"))


_GRADE = "CAST(greatest(0, least(6, round_even(utility, 0) - 1)) AS BIGINT)"


@query("h32_grade_ndcg", sql(f"SELECT count(*) AS queries, round(avg(CASE WHEN i > 0 THEN s / i ELSE 0 END), 6) AS ndcg FROM (SELECT query_id, sum((pow(2, g) - 1) / log2(p + 1)) FILTER (p <= 8) AS s, sum((pow(2, g) - 1) / log2(q + 1)) FILTER (q <= 8) AS i FROM (SELECT query_id, {_GRADE} AS g, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(lexical, 0) DESC, comment_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY {_GRADE} DESC, comment_id) AS q FROM l) GROUP BY 1)", "pool", "judged", l=_LABELLED))
def h32(spark: SparkSession, d: str) -> DataFrame:
    """Mean nDCG of a score's order on seven grades, within the judged candidates."""
    rows = labelled(spark, d).select(*PAIR, F.coalesce("lexical", F.lit(0.0)).alias("s"), ut.grade(F.col("utility")).alias("g"))
    rows = ranking.ranked(ranking.ranked(rows, ["query_id"], [F.desc("s"), "comment_id"], "p"), ["query_id"], [F.desc("g"), "comment_id"], "q")
    part = lambda c: F.sum(F.when(F.col(c) <= 8, (F.pow(F.lit(2.0), F.col("g")) - 1) * metrics.discount(F.col(c))))
    per = rows.groupBy("query_id").agg(part("p").alias("s"), part("q").alias("i"))
    return per.agg(F.count(F.lit(1)).alias("queries"), r6(F.avg(F.when(F.col("i") > 0, F.col("s") / F.col("i")).otherwise(0.0)), "ndcg"))


# intervals


_BOOT = ("routes", "judged")
_CTES = {"ideal": _IDEAL, "per": _PER}


@query("i2_paired_interval", sql("SELECT count(*) AS rows, max(n) AS n, max(mean) AS mean, max(low) AS low, max(high) AS high FROM (" + bootstrapped("d2", "query_id", "delta", "arm", 2000) + ")", *_BOOT, **_CTES, dl=_DELTA, d2="SELECT 'all' AS arm, * FROM dl"))
def i2(spark: SparkSession, d: str) -> DataFrame:
    """The interval of a mean paired difference."""
    ci = stats.bootstrap_mean(_deltas(spark, d).withColumn("arm", F.lit("all")), "query_id", "delta", ["arm"])
    return ci.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), *[r6(F.max(c), c) for c in ("mean", "low", "high")])


_SORTED = "SELECT route, max(n) FILTER (draw = 0) AS n, round(max(m) FILTER (draw = 0), 6) AS mean, round(list_sort(list(m) FILTER (draw > 0))[CAST(floor(0.025 * 1000) AS INT) + 1], 6) AS low, round(list_sort(list(m) FILTER (draw > 0))[least(CAST(floor(0.975 * 1000) AS INT) + 1, len(list(m) FILTER (draw > 0)))], 6) AS high FROM ({means}) GROUP BY 1"


def _means_sql(per: str, value: str, by: str, draws: int, seed: int) -> str:
    times = "CASE WHEN draw = 0 THEN 1 " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END"
    units = f"SELECT {by}, query_id AS u, count(*) AS n, sum({value}) AS s FROM {per} WHERE {value} IS NOT NULL GROUP BY ALL"
    return f"SELECT {by}, draw, CAST(sum(w * n) AS BIGINT) AS n, round(sum(w * s) / sum(w * n), 12) AS m FROM (SELECT *, {times} AS w FROM ({drawn(units, seed, draws, 4)})) WHERE w > 0 GROUP BY ALL"


@query("i3_sorted_interval", sql(_SORTED.format(means=_means_sql("per", "ndcg", "route", 1000, 13)), *_BOOT, **_CTES))
def i3(spark: SparkSession, d: str) -> DataFrame:
    """An interval from the sorted means at fixed places instead of interpolated quantiles."""
    per = metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8)
    ci = stats.bootstrap_mean(per, "query_id", "ndcg", ["route"], 1000, 13, "index")
    return ci.select("route", "n", *[r6(c, c) for c in ("mean", "low", "high")])


@query("i4_shared_draws", sql("SELECT draw, CAST(sum(w) AS BIGINT) AS weight, count(*) AS units FROM (SELECT draw, CASE " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END AS w FROM (" + drawn("SELECT DISTINCT query_id AS u FROM qrels WHERE query_id IS NOT NULL", 7, 100, 4) + ") WHERE draw > 0) WHERE w > 0 GROUP BY 1"))
def i4(spark: SparkSession, d: str) -> DataFrame:
    """A plan of draws that several statistics can share: how many units each draw holds, and their weight."""
    units = table(spark, d, "qrels").filter("query_id IS NOT NULL").select("query_id").distinct()
    w = stats.weights(units, "query_id", 100).filter("draw > 0 AND weight > 0")
    return w.groupBy(F.col("draw").cast("bigint").alias("draw")).agg(F.sum("weight").cast("bigint").alias("weight"), F.count(F.lit(1)).alias("units"))


@query("i5_means_by_shared_draws", sql("SELECT measure, max(n) FILTER (draw = 0) AS n, round(max(m) FILTER (draw = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (draw > 0), 6) AS high FROM (" + _means_sql("x", "v", "measure", 500, 7) + ") GROUP BY 1", "judged", x="SELECT query_id, unnest(['utility', 'relevance']) AS measure, unnest([utility, CAST(label_relevance AS DOUBLE)]) AS v FROM judged"))
def i5(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of two measures over the same draws of queries."""
    pair = lambda n, c: F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("v"))
    rows = t.judged(spark, d).select("query_id", F.explode(F.array(pair("utility", "utility"), pair("relevance", "label_relevance"))).alias("x")).select("query_id", "x.*")
    return stats.bootstrap_mean(rows, "query_id", "v", ["measure"], 500).select("measure", "n", *[r6(c, c) for c in ("mean", "low", "high")])


@query("i6_ratio_interval", sql("SELECT CAST(max(n) FILTER (draw = 0) AS BIGINT) AS units, round(max(r) FILTER (draw = 0), 6) AS ratio, round(quantile_cont(r, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(r, 0.975) FILTER (draw > 0), 6) AS high FROM (SELECT draw, sum(w) AS n, round(sum(w * a) / sum(w * b), 12) AS r FROM (SELECT *, CASE WHEN draw = 0 THEN 1 " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END AS w FROM (" + drawn("SELECT query_id AS u, count(*) FILTER (utility >= 4.5) AS a, count(utility) AS b FROM judged GROUP BY 1", 7, 1000, 4) + ")) WHERE w > 0 GROUP BY 1 HAVING abs(sum(w * b)) > 1e-12)", "judged"))
def i6(spark: SparkSession, d: str) -> DataFrame:
    """A ratio of sums over queries with its interval; draws whose denominator is about 0 are left out."""
    per = t.judged(spark, d).groupBy("query_id").agg(F.count_if(F.col("utility") >= 4.5).alias("a"), F.count("utility").alias("b"))
    return stats.bootstrap_ratio(per, "query_id", "a", "b").select("units", *[r6(c, c) for c in ("ratio", "low", "high")])


_SUFFICIENT = "SELECT query_id, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM (SELECT query_id, sbert - avg(sbert) OVER w AS x, utility - avg(utility) OVER w AS y FROM l WHERE sbert IS NOT NULL AND length IS NOT NULL WINDOW w AS (PARTITION BY query_id)) GROUP BY 1 HAVING count(*) >= 3 AND sum(x * x) > 1e-12 AND sum(y * y) > 1e-12"


@query("i7_clustered_correlation", sql("SELECT round(max(r) FILTER (draw = 0), 6) AS r, round(quantile_cont(r, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(r, 0.975) FILTER (draw > 0), 6) AS high FROM (SELECT draw, round(sum(w * xy) / sqrt(sum(w * xx) * sum(w * yy)), 12) AS r FROM (SELECT *, CASE WHEN draw = 0 THEN 1 " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END AS w FROM (" + drawn("SELECT query_id AS u, xx, yy, xy FROM sf", 7, 1000, 4) + ")) WHERE w > 0 GROUP BY 1)", "pool", "judged", l=_LABELLED, sf=_SUFFICIENT))
def i7(spark: SparkSession, d: str) -> DataFrame:
    """The pooled within-query correlation with an interval over whole queries, from their sums of products."""
    sums = stats.sufficient(labelled(spark, d), "sbert", "utility", "length")
    w = stats.weights(sums.select("query_id", "xx", "yy", "xy"), "query_id", 1000).filter("weight > 0")
    per = w.groupBy("draw").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("xx", "yy", "xy")]).withColumn("r", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 12))
    sampled = F.when(F.col("draw") > 0, F.col("r"))
    return per.agg(r6(F.max(F.when(F.col("draw") == 0, F.col("r"))), "r"), r6(F.percentile(sampled, 0.025), "low"), r6(F.percentile(sampled, 0.975), "high"))


_MOMENTS = "SELECT query_id, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz FROM (SELECT query_id, sbert - avg(sbert) OVER w AS x, utility - avg(utility) OVER w AS y, length - avg(length) OVER w AS z FROM l WHERE sbert IS NOT NULL AND length IS NOT NULL WINDOW w AS (PARTITION BY query_id)) GROUP BY 1 HAVING count(*) >= 3 AND sum(x * x) > 1e-12 AND sum(y * y) > 1e-12"


@query("i9_pooled_correlation", sql("SELECT tier, CAST(sum(n) AS BIGINT) AS n, round(sum(xy) / sqrt(sum(xx) * sum(yy)), 6) AS r FROM m JOIN texts USING (query_id) GROUP BY 1", "pool", "judged", "texts", l=_LABELLED, m=_MOMENTS))
def i9(spark: SparkSession, d: str) -> DataFrame:
    """Pooled within-query correlation of similarity and utility, by tier of the query."""
    s = stats.sufficient(labelled(spark, d), "sbert", "utility", "length").join(t.texts(spark, d).select("query_id", "tier"), "query_id")
    return stats.pooled_correlations(s, ["tier"]).select("tier", "n", r6("r", "r"))


@query("i10_partial_correlation", sql("SELECT CASE WHEN n >= 45 THEN 'large' ELSE 'small' END AS size, count(*) AS units, round((sum(xy) * sum(zz) - sum(xz) * sum(yz)) / sqrt((sum(xx) * sum(zz) - pow(sum(xz), 2)) * (sum(yy) * sum(zz) - pow(sum(yz), 2))), 6) AS partial_r FROM m GROUP BY 1", "pool", "judged", l=_LABELLED, m=_MOMENTS))
def i10(spark: SparkSession, d: str) -> DataFrame:
    """The same with length held fixed, for queries with many and with few judged candidates."""
    s = stats.sufficient(labelled(spark, d), "sbert", "utility", "length").withColumn("size", F.when(F.col("n") >= 45, "large").otherwise("small"))
    return stats.pooled_correlations(s, ["size"]).select("size", "units", r6("partial_r", "partial_r"))


_RHO = _spearman("sbert", "utility", "SELECT * FROM l")


@query("i12_query_correlations", sql("SELECT query_id, n, rho, CASE WHEN rho > 0.1 THEN 'up' WHEN rho < -0.1 THEN 'down' ELSE 'flat' END AS direction FROM r WHERE rho IS NOT NULL", "pool", "judged", l=_LABELLED, r=_RHO))
def i12(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of each query where they are defined, and their direction."""
    r = metrics.within_query_spearman(labelled(spark, d), "sbert", "utility").select("query_id", "n", r6("rho", "rho")).filter("rho IS NOT NULL")
    return r.withColumn("direction", F.when(F.col("rho") > 0.1, "up").when(F.col("rho") < -0.1, "down").otherwise("flat"))


@query("i13_correlation_summary", sql("SELECT count(*) AS queries, round(avg(rho), 5) AS mean, round(quantile_cont(rho, 0.5), 5) AS median, count(*) FILTER (rho > 0) AS wins, count(*) FILTER (rho = 0) AS ties, count(*) FILTER (rho < 0) AS losses FROM r WHERE rho IS NOT NULL", "pool", "judged", l=_LABELLED, r=_RHO))
def i13(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.within_query_spearman(labelled(spark, d), "sbert", "utility").select(r6("rho", "rho")).filter("rho IS NOT NULL")
    return r.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rho"), 5).alias("mean"), F.round(F.percentile("rho", 0.5), 5).alias("median"), F.count_if(F.col("rho") > 0).alias("wins"), F.count_if(F.col("rho") == 0).alias("ties"), F.count_if(F.col("rho") < 0).alias("losses"))


@query("i17_spearman_or_null", sql("SELECT tier, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS rho FROM (SELECT tier, rank() OVER (PARTITION BY tier ORDER BY chars) + (count(*) OVER (PARTITION BY tier, chars) - 1) / 2.0 AS x, rank() OVER (PARTITION BY tier ORDER BY created_year) + (count(*) OVER (PARTITION BY tier, created_year) - 1) / 2.0 AS y FROM (SELECT tier, length(query_text) AS chars, created_year FROM texts WHERE query_text IS NOT NULL AND created_year IS NOT NULL)) GROUP BY 1", "texts"))
def i17(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation by group, null where a side is constant or there are fewer than three."""
    rows = t.texts(spark, d).filter("query_text IS NOT NULL AND created_year IS NOT NULL").select("tier", F.length("query_text").alias("chars"), "created_year")
    return metrics.within_query_spearman(rows, "chars", "created_year", ["tier"]).select("tier", "n", r6("rho", "rho"))


@query("i20_mean_lengths", sql("SELECT scenario, count(*) AS n, round(avg(chars), 6) AS mean, round(stddev_samp(chars) / sqrt(count(*)), 6) AS se FROM (SELECT scenario, length(query_text) AS chars FROM texts WHERE query_text IS NOT NULL) GROUP BY 1", "texts"))
def i20(spark: SparkSession, d: str) -> DataFrame:
    """Means of several groups with their standard errors."""
    rows = t.texts(spark, d).filter("query_text IS NOT NULL").select("scenario", F.length("query_text").alias("chars"))
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("chars"), "mean"), r6(F.stddev_samp("chars") / F.sqrt(F.count(F.lit(1))), "se"))


@query("i24_positive_share", sql("SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM dl", *_BOOT, **_CTES, dl=_DELTA))
def i24(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta"), "mean"), r6(F.avg((F.col("delta") > 0).cast("double")), "positive"))


@query("i26_folds_then_pairs", sql("SELECT count(*) AS queries, round(avg(a - b), 6) AS mean_delta, count(*) FILTER (a - b > 1e-12) AS wins FROM (SELECT query_id, avg(v) FILTER (route = 'sbert') AS a, avg(v) FILTER (route = 'lexical') AS b FROM (SELECT route, query_id, fold, avg(utility) AS v FROM (SELECT route, query_id, comment_id, CAST(CAST(('0x' || substr(md5(comment_id || '#7'), 1, 15)) AS BIGINT) % 2 AS BIGINT) AS fold FROM routes WHERE rank <= 8) JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL GROUP BY ALL) GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL", "routes", "judged"))
def i26(spark: SparkSession, d: str) -> DataFrame:
    """Means of folds first, then of queries, then paired differences."""
    rows = t.routes(spark, d).filter("rank <= 8").join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).withColumn("fold", F.pmod(sampling.seeded("comment_id", 7), F.lit(2)))
    per = rows.groupBy("route", "query_id", "fold").agg(F.avg("utility").alias("v"))
    p = stats.paired(per, "route", "sbert", "lexical", "v")
    return p.agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("delta"), "mean_delta"), F.count_if(F.col("delta") > 1e-12).alias("wins"))


@query("i28_interval_signs", sql("SELECT route, CASE WHEN low > 0.9 THEN 'better' WHEN high < 0.9 THEN 'worse' ELSE 'open' END AS verdict FROM (" + bootstrapped("per", "query_id", "ndcg", "route", 400) + ")", *_BOOT, **_CTES))
def i28(spark: SparkSession, d: str) -> DataFrame:
    """Whether an interval lies above, below or around a value."""
    ci = stats.bootstrap_mean(metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8), "query_id", "ndcg", ["route"], 400)
    return ci.select("route", stats.verdict(F.round("low", 6) - 0.9, F.round("high", 6) - 0.9).alias("verdict"))


@query("i33_counts_and_means", sql("SELECT query_id, count(utility) AS n, round(avg(utility), 6) AS mean, round(min(utility), 6) AS low, round(max(utility), 6) AS high FROM judged GROUP BY 1", "judged"))
def i33(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).groupBy("query_id").agg(F.count("utility").alias("n"), r6(F.avg("utility"), "mean"), r6(F.min("utility"), "low"), r6(F.max("utility"), "high"))


_REPEATS = "SELECT repeat, query_id, avg(utility) AS v FROM (SELECT query_id, comment_id, unnest(range(3)) AS repeat FROM routes WHERE route = 'sbert' AND rank <= 16) JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL AND CAST(('0x' || substr(md5(comment_id || '#' || repeat), 1, 15)) AS BIGINT) % 2 = 0 GROUP BY ALL"


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """(repeat, query_id, v): the mean utility of a random half of the first sixteen, three times."""
    rows = t.routes(spark, d).filter("route = 'sbert' AND rank <= 16").select(*PAIR, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    order = F.conv(F.substring(F.md5(F.concat_ws("#", "comment_id", "repeat")), 1, 15), 16, 10).cast("bigint")
    return rows.filter(order % 2 == 0).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).groupBy("repeat", "query_id").agg(F.avg("utility").alias("v"))


@query("i35_repeat_averages", sql("SELECT count(*) AS queries, round(avg(m), 6) AS mean, round(avg(s), 6) AS spread FROM (SELECT query_id, avg(v) AS m, max(v) - min(v) AS s FROM r GROUP BY 1)", "routes", "judged", r=_REPEATS))
def i35(spark: SparkSession, d: str) -> DataFrame:
    """Repeats averaged within queries, and how far they lie apart."""
    per = repeats(spark, d).groupBy("query_id").agg(F.avg("v").alias("m"), (F.max("v") - F.min("v")).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("m"), "mean"), r6(F.avg("s"), "spread"))


@query("i37_query_means", sql("SELECT query_id, count(*) AS n, round(avg(v), 6) AS mean FROM r GROUP BY 1", "routes", "judged", r=_REPEATS))
def i37(spark: SparkSession, d: str) -> DataFrame:
    return repeats(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v"), "mean"))


@query("i40_means_and_errors", sql("SELECT route, round(avg(ndcg), 6) AS mean, round(stddev_samp(ndcg) / sqrt(count(ndcg)), 6) AS se FROM per GROUP BY 1", *_BOOT, **_CTES))
def i40(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8)
    return per.groupBy("route").agg(r6(F.avg("ndcg"), "mean"), r6(F.stddev_samp("ndcg") / F.sqrt(F.count("ndcg")), "se"))


@query("i41_mean_of_means", sql("SELECT round(avg(m), 6) AS mean FROM (SELECT query_id, avg(v) AS m FROM r GROUP BY 1)", "routes", "judged", r=_REPEATS))
def i41(spark: SparkSession, d: str) -> DataFrame:
    return repeats(spark, d).groupBy("query_id").agg(F.avg("v").alias("m")).agg(r6(F.avg("m"), "mean"))


_CONTRAST_NAMES = [("rrf_0.3", "dense"), ("cc_minmax_0.8", "dense"), ("tail_2", "dense"), ("rrf_1", "lexical")]
_CONTRASTS = " UNION ALL ".join(f"SELECT '{a}-{b}' AS contrast, '{f}' AS family, x.query_id, x.{m} - y.{m} AS delta FROM m x JOIN m y USING (query_id) WHERE x.system = '{a}' AND y.system = '{b}' AND x.{m} IS NOT NULL AND y.{m} IS NOT NULL" for a, b in _CONTRAST_NAMES for f, m in (("utility", "utility"), ("gain", "ndcg")))


def contrasts(spark: SparkSession, d: str) -> DataFrame:
    """(contrast, family, query_id, delta) of named systems by two measures."""
    from rankloom.base import cut

    rows = cut(system_rows(spark, d))
    out = None
    for family, measure in (("utility", "utility"), ("gain", "ndcg")):
        for a, b in _CONTRAST_NAMES:
            part = stats.paired(rows, "system", a, b, measure).select(F.lit(f"{a}-{b}").alias("contrast"), F.lit(family).alias("family"), "query_id", "delta")
            out = part if out is None else out.unionByName(part)
    return out


_C_CTES = {"two": _TWO, "s": _SYSTEMS, "ideal": _IDEAL, "m0": _SYSTEM_ROWS, "m": "SELECT system, query_id, utility, nullif(ndcg, 0) AS ndcg FROM m0"}


@query("i45_contrast_families", sql("SELECT family, contrast, count(*) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses, round(quantile_cont(delta, 0.5), 6) AS median FROM c GROUP BY ALL", "routes", "judged", **_C_CTES, c=_CONTRASTS))
def i45(spark: SparkSession, d: str) -> DataFrame:
    """All registered contrasts of both families."""
    w = stats.win_tie_loss(contrasts(spark, d), ["family", "contrast"])
    return w.select("family", "contrast", "n", r6("mean_delta", "mean"), "wins", "ties", "losses", r6("median_delta", "median"))


@query("i44_contrast_intervals", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("c", "query_id", "delta", "key", 1000) + ")", "routes", "judged", **_C_CTES, c="SELECT family || ':' || contrast AS key, query_id, delta FROM (" + _CONTRASTS + ")"))
def i44(spark: SparkSession, d: str) -> DataFrame:
    """The same contrasts with intervals over the same draws."""
    rows = contrasts(spark, d).withColumn("key", F.concat_ws(":", "family", "contrast"))
    return stats.bootstrap_mean(rows, "query_id", "delta", ["key"], 1000).select("key", "n", *[r6(c, c) for c in ("mean", "low", "high")])


@query("i42_cell_summary", sql("SELECT tier, system, count(*) AS queries, count(utility) AS complete, round(avg(utility), 6) AS utility, round(avg(ndcg), 6) AS ndcg, round(avg(judged), 6) AS judged FROM m0x JOIN texts USING (query_id) GROUP BY ALL", "routes", "judged", "texts", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS, m0x="SELECT system, query_id, judged, utility, nullif(ndcg, 0) AS ndcg FROM m0"))
def i42(spark: SparkSession, d: str) -> DataFrame:
    """Means of each system in each stratum of queries."""
    rows = system_rows(spark, d).join(t.texts(spark, d).select("query_id", "tier"), "query_id")
    return rows.groupBy("tier", "system").agg(F.count(F.lit(1)).alias("queries"), F.count("utility").alias("complete"), *[r6(F.avg(c), c) for c in ("utility", "ndcg", "judged")])


@query("i48_arm_means", sql("SELECT split_part(system, '_', 1) AS arm, count(DISTINCT system) AS systems, count(*) AS rows, round(avg(utility), 6) AS utility FROM m0 GROUP BY 1", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def i48(spark: SparkSession, d: str) -> DataFrame:
    """Systems of one kind together."""
    return system_rows(spark, d).groupBy(F.get(F.split("system", "_"), F.lit(0)).alias("arm")).agg(F.count_distinct("system").alias("systems"), F.count(F.lit(1)).alias("rows"), r6(F.avg("utility"), "utility"))


@query("i50_tolerant_outcomes", sql("SELECT tolerance, count(*) FILTER (delta > tolerance) AS wins, count(*) FILTER (abs(delta) <= tolerance) AS ties, count(*) FILTER (delta < -tolerance) AS losses FROM dl, (SELECT unnest([0.0, 0.01, 0.1]) AS tolerance) GROUP BY 1", *_BOOT, **_CTES, dl=_DELTA))
def i50(spark: SparkSession, d: str) -> DataFrame:
    """Wins, ties and losses by what counts as a tie."""
    rows = _deltas(spark, d).withColumn("tolerance", F.explode(F.array(F.lit(0.0), F.lit(0.01), F.lit(0.1))))
    x, tol = F.col("delta"), F.col("tolerance")
    return rows.groupBy("tolerance").agg(F.count_if(x > tol).alias("wins"), F.count_if(F.abs(x) <= tol).alias("ties"), F.count_if(x < -tol).alias("losses"))


@query("i51_quadrants", sql("SELECT CASE WHEN du > 0 AND dg > 0 THEN 'both up' WHEN du < 0 AND dg < 0 THEN 'both down' WHEN du = 0 OR dg = 0 THEN 'even' ELSE 'split' END AS quadrant, count(*) AS queries FROM (SELECT query_id, round(x.utility - y.utility, 9) AS du, round(x.ndcg - y.ndcg, 9) AS dg FROM m0 x JOIN m0 y USING (query_id) WHERE x.system = 'rrf_0.3' AND y.system = 'dense' AND x.utility IS NOT NULL AND y.utility IS NOT NULL AND x.ndcg IS NOT NULL AND y.ndcg IS NOT NULL) GROUP BY 1", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def i51(spark: SparkSession, d: str) -> DataFrame:
    """Whether two measures of the same change agree in sign."""
    rows = system_rows(spark, d).filter("utility IS NOT NULL AND ndcg IS NOT NULL")
    side = lambda s, n: rows.filter(F.col("system") == s).select("query_id", F.col("utility").alias(f"u{n}"), F.col("ndcg").alias(f"g{n}"))
    both = side("rrf_0.3", 1).join(side("dense", 2), "query_id").select(F.round(F.col("u1") - F.col("u2"), 9).alias("du"), F.round(F.col("g1") - F.col("g2"), 9).alias("dg"))
    u, g = F.col("du"), F.col("dg")
    return both.groupBy(F.when((u > 0) & (g > 0), "both up").when((u < 0) & (g < 0), "both down").when((u == 0) | (g == 0), "even").otherwise("split").alias("quadrant")).agg(F.count(F.lit(1)).alias("queries"))


@query("i52_structure", sql("SELECT route, count(*) AS rows, round(avg(CASE WHEN lopo IS NULL THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 6) AS same_5, round(avg(CASE WHEN lopo IS NULL THEN 1.0 ELSE 0.0 END) FILTER (rank <= 10), 6) AS same_10 FROM l GROUP BY 1", "run", "notes", "texts", l=_LOPO))
def i52(spark: SparkSession, d: str) -> DataFrame:
    """How much of each route's head is of the query's own post, over all queries."""
    same = lambda k: r6(F.avg(F.when(F.col("rank") <= k, F.col("lopo").isNull().cast("double"))), f"same_{k}")
    return lopo_run(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("rows"), same(5), same(10))


_SCOPE = "SELECT query_id, comment_id, string_agg(route, '|' ORDER BY route) AS sources FROM run WHERE rank <= 8 AND (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM judged) GROUP BY ALL"


@query("i53_residual_scope", sql("SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, count(*) AS queries FROM (SELECT q.query_id, count(s.comment_id) AS n FROM (SELECT DISTINCT query_id FROM run) q LEFT JOIN s USING (query_id) GROUP BY 1)", "run", "judged", s=_SCOPE))
def i53(spark: SparkSession, d: str) -> DataFrame:
    """How many unjudged items the queries' heads hold, queries with none included."""
    run = t.run(spark, d)
    left = setops.residual(run.filter("rank <= 8"), t.judged(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    per = run.select("query_id").distinct().join(left, "query_id", "left").fillna(0, ["n"])
    return per.agg(F.min("n").alias("least"), r6(F.avg("n"), "mean"), F.max("n").alias("most"), F.count(F.lit(1)).alias("queries"))


@query("i54_residual_scope_by_source", sql("SELECT source, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM (SELECT query_id, comment_id, unnest(string_split(sources, '|')) AS source FROM s) GROUP BY 1 UNION ALL SELECT 'both', count(*), count(DISTINCT query_id) FROM s WHERE contains(sources, '|')", "run", "judged", s=_SCOPE))
def i54(spark: SparkSession, d: str) -> DataFrame:
    """The same by the route that brings the item, and by both."""
    m = setops.memberships(t.run(spark, d), 8).join(t.judged(spark, d).select(*PAIR), PAIR, "left_anti")
    each = F.concat("routes", F.when(F.size("routes") > 1, F.array(F.lit("both"))).otherwise(F.array().cast("array<string>")))
    out = m.select("query_id", F.explode(each).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("queries"))
    if not m.filter(F.size("routes") > 1).head(1):
        out = out.unionByName(spark.createDataFrame([("both", 0, 0)], "source string, pairs long, queries long"))
    return out


@query("i55_distribution", sql("SELECT post_role, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM texts GROUP BY 1", "texts"))
def i55(spark: SparkSession, d: str) -> DataFrame:
    rows = t.texts(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    return rows.groupBy("post_role").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("post_role", "n", r6(F.col("n") / F.col("t"), "share"))


# samples


@query("j3_balance_keys", sql("SELECT concat_ws('::', coalesce(scenario, 'UNKNOWN'), coalesce(tier, 'UNKNOWN'), source) AS key, count(*) AS n FROM texts GROUP BY 1", "texts"))
def j3(spark: SparkSession, d: str) -> DataFrame:
    known = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    return t.texts(spark, d).groupBy(F.concat_ws("::", known("scenario"), known("tier"), "source").alias("key")).agg(F.count(F.lit(1)).alias("n"))


_TURNS = f"SELECT query_id, coalesce(tier, 'UNKNOWN') AS tier, row_number() OVER (PARTITION BY coalesce(tier, 'UNKNOWN') ORDER BY {_MD5.format(x='query_id')}, query_id) AS turn FROM texts"


@query("j4_flagged_subset", sql(f"SELECT query_id, tier, place <= 30 AS human FROM (SELECT *, row_number() OVER (ORDER BY turn, tier) AS place FROM ({_TURNS}))", "texts"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    """All queries, thirty of them flagged in turns over the tiers."""
    rows = t.texts(spark, d).select("query_id", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"))
    chosen = sampling.balanced(rows, ["tier"], "query_id", 30).select("query_id", F.lit(True).alias("human"))
    return rows.join(chosen, "query_id", "left").select("query_id", "tier", F.coalesce("human", F.lit(False)).alias("human"))


@query("j5_audited_queries", sql("SELECT query_id, source FROM texts WHERE use_bucket = 'query_candidate' AND coalesce(drug_related, 0) = 0 AND query_id NOT IN (SELECT query_id FROM candidate_features WHERE query_id IS NOT NULL)", "texts"))
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Queries fit for a split: of the right bucket, on no drug, and not used elsewhere."""
    used = table(spark, d, "candidate_features").select("query_id").distinct()
    return t.texts(spark, d).filter("use_bucket = 'query_candidate' AND coalesce(drug_related, 0) = 0").join(used, "query_id", "left_anti").select("query_id", "source")


@query("j7_query_strata", sql("SELECT stratum, count(*) AS queries FROM (SELECT unnest(CASE WHEN t.query_id IN (SELECT query_id FROM gold) THEN ['all', 'with gold', coalesce(tier, 'UNKNOWN')] ELSE ['all', 'without gold', coalesce(tier, 'UNKNOWN')] END) AS stratum FROM texts t) GROUP BY 1", "texts", "gold"))
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Named strata, of which each query may be in several."""
    held = t.gold(spark, d).select("query_id").distinct().withColumn("g", F.lit(True))
    rows = t.texts(spark, d).select("query_id", "tier").join(held, "query_id", "left")
    strata = F.array(F.lit("all"), F.when(F.col("g"), "with gold").otherwise("without gold"), F.coalesce("tier", F.lit("UNKNOWN")))
    return rows.select(F.explode(strata).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"))


@query("j9_stratified_ids", sql(f"SELECT query_id, tier FROM ({_TURNS}) WHERE turn <= round(40.0 * (SELECT count(*) FROM texts x WHERE coalesce(x.tier, 'UNKNOWN') = z.tier) / (SELECT count(*) FROM texts))".replace(f"({_TURNS})", f"({_TURNS}) z"), "texts"))
def j9(spark: SparkSession, d: str) -> DataFrame:
    """About forty queries, each tier by its share of all."""
    rows = t.texts(spark, d).select("query_id", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"))
    sizes = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("t"))))
    placed = ranking.top_k(rows.withColumn("o", sampling.seeded("query_id", 7)), ["tier"], ["o", "query_id"], 41, "turn")
    return placed.join(sizes, "tier").filter(F.col("turn") <= F.round(40.0 * F.col("n") / F.col("t"))).select("query_id", "tier")


@query("j10_development_cohort", sql(f"SELECT part, query_id FROM (SELECT 'first' AS part, query_id FROM texts WHERE query_id IN (SELECT query_id FROM qrels) UNION ALL SELECT 'more', query_id FROM (SELECT query_id, row_number() OVER (ORDER BY turn, tier) AS place FROM ({_TURNS.replace('FROM texts', 'FROM texts WHERE query_id NOT IN (SELECT query_id FROM qrels WHERE query_id IS NOT NULL)')})) WHERE place <= 50)", "texts"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    """All judged queries and fifty others, taken in turns over the tiers."""
    used = table(spark, d, "qrels").filter("query_id IS NOT NULL").select("query_id").distinct()
    rows = t.texts(spark, d).select("query_id", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"))
    more = sampling.balanced(rows.join(used, "query_id", "left_anti"), ["tier"], "query_id", 50)
    return rows.join(used, "query_id", "left_semi").select(F.lit("first").alias("part"), "query_id").unionByName(more.select(F.lit("more").alias("part"), "query_id"))


def _fold_sql(seed: int, n: int) -> str:
    return f"CAST(CAST(('0x' || substr(md5(query_id || '#{seed}#0'), 1, 15)) AS BIGINT) % {n} AS BIGINT)"


@query("j12_inner_folds", sql(f"SELECT fold, CASE WHEN {_fold_sql(11, 3)} = fold THEN 'valid' ELSE 'train' END AS role, count(*) AS queries FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL), (SELECT CAST(unnest(range(3)) AS BIGINT) AS fold) GROUP BY ALL"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Training and validation queries of three inner folds."""
    f = sampling.folds(table(spark, d, "qrels"), "query_id", 3, 1, 11).withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return f.groupBy(F.col("fold").cast("bigint").alias("fold"), F.when(F.col("own") == F.col("fold"), "valid").otherwise("train").alias("role")).agg(F.count(F.lit(1)).alias("queries"))


@query("j13_nested_folds", sql(f"SELECT outer_fold, inner_fold, count(*) AS queries FROM (SELECT query_id, {_fold_sql(7, 5)} AS f, {_fold_sql(13, 4)} AS inner_fold FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL)), (SELECT CAST(unnest(range(5)) AS BIGINT) AS outer_fold) WHERE f <> outer_fold GROUP BY ALL"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Inner folds within the training part of each outer one."""
    q = table(spark, d, "qrels")
    outer, inner = sampling.folds(q, "query_id", 5).select("query_id", F.col("fold").alias("f")), sampling.folds(q, "query_id", 4, 1, 13).select("query_id", F.col("fold").alias("inner_fold"))
    rows = outer.join(inner, "query_id").withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("f <> outer_fold")
    return rows.groupBy(*[F.col(c).cast("bigint").alias(c) for c in ("outer_fold", "inner_fold")]).agg(F.count(F.lit(1)).alias("queries"))


@query("j14_tuning_holdout", sql(f"SELECT query_id, place <= 0.2 * n AS held FROM (SELECT query_id, row_number() OVER (ORDER BY {_MD5.format(x='query_id').replace('#7', '#17')}, query_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL))"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the queries, by seeded order, held out for tuning."""
    rows = table(spark, d, "qrels").filter("query_id IS NOT NULL").select("query_id").distinct().withColumn("o", sampling.seeded("query_id", 17)).withColumn("all", F.lit(1))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return ranking.ranked_split(rows, ["all"], ["o", "query_id"], "place").crossJoin(F.broadcast(n)).select("query_id", (F.col("place") <= 0.2 * F.col("n")).alias("held"))
