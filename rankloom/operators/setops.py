"""Set operations, membership, deduplication and digests over lists and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked, top_k

PAIR = ["query_id", "comment_id"]


def stable_unique(df: DataFrame, keys: list[str], item: str, position: str) -> DataFrame:
    """First occurrences in order, renumbered from 1 in `rank`; null items are dropped."""
    first = df.filter(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(position).alias("__p"))
    return ranked(first, keys, ["__p", item]).drop("__p")


def aliases(df: DataFrame, item: str, text: Column) -> DataFrame:
    """(item, canonical): items of equal text share the smallest id. Null texts are their own.

    Only hashes are shuffled, and the smallest id of a text is found by partial aggregation, so a text with a third of
    all rows is no burden; the way back is by the same salted lookup.
    """
    from rankloom.base import lookup_skewed

    rows = df.filter(F.col(item).isNotNull()).select(F.col(item), F.sha2(text, 256).alias("h")).distinct()
    known = rows.filter(F.col("h").isNotNull())
    heads = known.groupBy("h").agg(F.min(item).alias("canonical"), F.count(F.lit(1)).alias("n"))
    return lookup_skewed(known, heads, "h", "n").select(item, "canonical").unionByName(rows.filter(F.col("h").isNull()).select(item, F.col(item).alias("canonical")))


def overlap_by_depth(run: DataFrame, left: str, right: str, depths: list[int]) -> DataFrame:
    """(depth, query_id, shared, jaccard) of two routes' lists cut at each depth; queries of either route.

    Each item's depth of entry is the larger of its ranks, so one join serves all depths.
    """
    spark = run.sparkSession
    steps = F.broadcast(spark.createDataFrame([(d,) for d in depths], "depth int"))
    a, b = (run.filter(F.col("route") == r).groupBy(*PAIR).agg(F.min("rank").alias(n)) for r, n in ((left, "a"), (right, "b")))
    both = a.join(b, PAIR, "full_outer").crossJoin(steps)
    in_a, in_b = (F.coalesce(F.col(c) <= F.col("depth"), F.lit(False)) for c in "ab")
    counts = both.groupBy("depth", "query_id").agg(F.count_if(in_a & in_b).alias("shared"), F.count_if(in_a | in_b).alias("either"))
    return counts.select("depth", "query_id", "shared", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(F.lit(0.0)).alias("jaccard"))


def memberships(run: DataFrame, depth: int | None = None) -> DataFrame:
    """(query_id, comment_id, routes): sorted names of the routes that hold the pair."""
    some = run if depth is None else run.filter(F.col("rank") <= depth)
    return some.groupBy(*PAIR).agg(F.array_sort(F.collect_set("route")).alias("routes"))


def exclusives(run: DataFrame, route: str, k: int, others: list[str], depth: int) -> DataFrame:
    """The top k of `route` that are in none of the others' first `depth`."""
    taken = run.filter(F.col("route").isin(others) & (F.col("rank") <= depth)).select(*PAIR)
    return top_k(run.filter(F.col("route") == route).join(taken, PAIR, "left_anti").drop("rank"), ["query_id"], [F.desc("score"), "comment_id"], k)


def coverage(pairs: DataFrame, judged: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs, judged, missing, coverage) of distinct pairs."""
    marked = pairs.select(*by, *PAIR).distinct().join(judged.select(*PAIR).distinct().withColumn("__j", F.lit(1)), PAIR, "left")
    n, j = F.count(F.lit(1)), F.count("__j")
    return marked.groupBy(*by).agg(n.alias("pairs"), j.alias("judged"), (n - j).alias("missing"), (j / n).alias("coverage"))


def residual(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Distinct pairs without a judgment."""
    return pairs.select(*PAIR).distinct().join(judged.select(*PAIR), PAIR, "left_anti")


def agreement_by_rank(run: DataFrame, left: str, right: str) -> DataFrame:
    """Per query: shared items among the first 8 and 100, whether the order is equal, and the first rank that differs."""
    a = run.filter(F.col("route") == left).select("query_id", "rank", F.col("comment_id").alias("a"))
    b = run.filter(F.col("route") == right).select("query_id", "rank", F.col("comment_id").alias("b"))
    differs = a.join(b, ["query_id", "rank"], "full_outer").groupBy("query_id").agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("rank"))).alias("first_difference"))
    cuts = overlap_by_depth(run.filter(F.col("route").isin(left, right)), left, right, [8, 100])
    wide = cuts.groupBy("query_id").agg(F.max(F.when(F.col("depth") == 8, F.col("shared"))).alias("shared_8"), F.max(F.when(F.col("depth") == 100, F.col("shared"))).alias("shared_100"))
    return differs.join(wide, "query_id").select("query_id", "shared_8", "shared_100", F.col("first_difference").isNull().alias("same_order"), "first_difference")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in `order` (say, newest first); cut to one per task before the shuffle."""
    return top_k(df, keys, order, 1, "__rn").drop("__rn")


def set_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (digest, n) of the set of distinct rows, whatever their order and partitions.

    Rows are hashed, and the digest is that of the sums of the hashes' eight 32-bit parts and of their number: sums don't
    depend on an order, so nothing is gathered. An empty table has the digest of zeros.
    """
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\u"))
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(escaped(c), F.lit("\\N")) for c in sorted(columns)]), 256)
    hashes = df.select(row.alias("h")).distinct()
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias(f"s{i}") for i in range(8)]
    sums = hashes.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws(" ", "n", *[f"s{i}" for i in range(8)]), 256).alias("digest"), "n")
