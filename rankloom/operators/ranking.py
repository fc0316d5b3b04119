"""Ranked lists as flat tables run(route, query_id, comment_id, rank, score): orders, normalisers, top-k, bands.

Every order is total: score falling, then id rising, unless an operator says otherwise. Null scores count as 0.0 in
`as_run`; null or empty ids are dropped; repeated pairs keep their best score; an empty table gives an empty run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import cut

KEYS = ["route", "query_id"]


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each task's groups to k before the shuffle (WindowGroupLimit), so a
    group of any size is never gathered."""
    return ranked(df, keys, order, name).filter(F.col(name) <= k)


def ranked_split(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """As `ranked`, for groups of any size: rows are dealt to tasks by ranges of keys and order, so that a large group lies
    in many tasks, and each counts on from the rows of its group in earlier ranges. The order must be total."""
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__held"), F.coalesce(before, F.lit(0)).alias("__b"))
    within = placed.withColumn(name, F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)))
    same = F.col("__range") == F.col("__held")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return within.join(counts, same).select(*df.columns, (F.col(name) + F.col("__b")).alias(name))


def as_run(df: DataFrame, route: Column, query: str, item: str, score: Column) -> DataFrame:
    """A canonical run: distinct pairs with their best score, ranked from 1."""
    value = F.coalesce(F.when(~F.isnan(score.cast("double")), score.cast("double")), F.lit(0.0))
    rows = df.filter(F.col(query).isNotNull() & (F.trim(F.col(item)) != "")).select(route.alias("route"), F.col(query).alias("query_id"), F.col(item).alias("comment_id"), value.alias("score"))
    best = rows.groupBy("route", "query_id", "comment_id").agg(F.max("score").alias("score"))
    return ranked(best, KEYS, [F.desc("score"), "comment_id"])


def _over(keys: list[str]) -> W:
    return W.partitionBy(*keys)


def minmax(value: Column, keys: list[str], constant: float = 1.0, least_span: float = 0.0) -> Column:
    """(v - lowest) / (highest - lowest) in the group; `constant` where the span is no more than `least_span`."""
    low, high = F.min(value).over(_over(keys)), F.max(value).over(_over(keys))
    return F.when(high - low <= least_span, F.lit(constant)).otherwise((value - low) / (high - low))


def zscore(value: Column, keys: list[str]) -> Column:
    """(v - mean) / population deviation; 0.0 where that is 0."""
    mean, deviation = F.avg(value).over(_over(keys)), F.stddev_pop(value).over(_over(keys))
    return F.when(deviation <= 0, F.lit(0.0)).otherwise((value - mean) / deviation)


def rank_percentile(value: Column, item: str, keys: list[str]) -> Column:
    """(place - 1) / (n - 1) by value and id rising; 1.0 for a single item. Ties have different places."""
    place = F.row_number().over(_over(keys).orderBy(value, F.col(item)))
    n = F.count(F.lit(1)).over(_over(keys))
    return F.when(n == 1, F.lit(1.0)).otherwise((place - 1) / (n - 1))


def normalized(value: Column, item: str, keys: list[str], method: str = "minmax", constant: float = 1.0) -> Column:
    if method == "minmax":
        return minmax(value, keys, constant)
    if method == "zscore":
        return zscore(value, keys)
    if method == "rank_percentile":
        return rank_percentile(value, item, keys)
    raise ValueError(f"unknown normalisation {method}")


def depth_percentile(rank: Column, depth: int) -> Column:
    """1 - (rank - 1) / (depth - 1); 0 for an absent rank, null for one outside 1 to depth."""
    return F.when(rank.isNull(), F.lit(0.0)).when(rank.between(1, depth), 1 - (rank - 1) / F.lit(float(depth - 1)))


def reciprocal_rank(rank: Column, k0: int = 60) -> Column:
    return F.when(rank > 0, 1 / (k0 + rank)).otherwise(F.lit(0.0))


def best_rank(*ranks: Column) -> Column:
    """The smallest rank that is not 0 or null; 9999 if there is none."""
    return F.coalesce(F.least(*[F.nullif(r, F.lit(0)) for r in ranks], F.lit(None).cast("int")), F.lit(9999))


def rank_band(rank: Column, bands: list[tuple[int, int, str]]) -> Column:
    """The label of the band (low, high, label) that holds the rank, else null."""
    out = None
    for low, high, label in bands:
        out = F.when(rank.between(low, high), label) if out is None else out.when(rank.between(low, high), label)
    return out


def average_rank(value: Column, keys: list[str]) -> Column:
    """Rank in which ties share their mean place."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*[F.col(k) for k in keys], value))
    return F.rank().over(_over(keys).orderBy(value)) + (ties - 1) / 2


#: Bytes of query vectors up to which they are sent to all tasks at once; more are sent in blocks of that size.
QUERY_BYTES = 64 << 20


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, item: str = "comment_id", vector: str = "vec") -> DataFrame:
    """Exact inner-product search: (query_id, item, score, rank).

    Queries are a stated set. They go to the tasks in blocks of bounded size, one pass over the corpus for each block;
    the corpus is not shuffled: each task multiplies its rows with the block and keeps k per query of every batch, and
    the window keeps k per query of a task before the shuffle. Null vectors match nothing. The corpus is a table of
    (item, vec), the queries one of (query_id, vec).
    """
    spark = corpus.sparkSession
    rows = queries.filter(F.col(vector).isNotNull()).select("query_id", vector)
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, -(-(shape[0] or 0) * (shape[1] or 1) * 8 // QUERY_BYTES))
    kind, qkind = dict(corpus.dtypes)[item], dict(queries.dtypes)["query_id"]
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = None
    for i in range(blocks):
        held = rows.filter(part == i).orderBy("query_id").collect()
        if not held and blocks > 1:
            continue
        shared = spark.sparkContext.broadcast(([r[0] for r in held], np.array([r[1] for r in held], dtype=np.float64).reshape(len(held), -1)))

        def multiply(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, m = shared.value
            for b in batches:
                if not len(b) or not names:
                    continue
                ids = b[item].to_numpy()
                scores = m @ np.array(list(b[vector]), dtype=np.float64).T
                for q, s in zip(names, scores):
                    order = np.lexsort((ids, -s))[:k]
                    yield pd.DataFrame({"query_id": [q] * len(order), item: ids[order], "score": s[order]})

        some = corpus.filter(F.col(vector).isNotNull()).select(item, vector).mapInPandas(multiply, f"query_id {qkind}, `{item}` {kind}, score double")
        found = some if found is None else found.unionByName(some)
    return top_k(found, ["query_id"], [F.desc("score"), item], k)


def cosine_votes(items: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """(query_id, label, votes): the label most frequent among the k labelled vectors nearest by cosine; ties go to the
    label met first in that order. `items` is a stated set of (query_id, vec), `labelled` has (comment_id, vec, label)."""
    near = dense_top_k(labelled.select("comment_id", "vec"), items, k).join(labelled.select("comment_id", "label"), "comment_id")
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    return top_k(votes, ["query_id"], [F.desc("votes"), "first"], 1).select("query_id", "label", "votes")


