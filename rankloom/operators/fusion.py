"""Fusion of runs by reciprocal rank or by convex combination of normalised scores.

Runs are tables run(route, query_id, comment_id, rank, score). Weights map routes to numbers; they are few and become
an expression, not a join. Empty runs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import normalized, ranked, top_k

PAIR = ["query_id", "comment_id"]


def weight_of(weights: dict[str, float] | None, default: float) -> Column:
    out = F.lit(default)
    for route, w in (weights or {}).items():
        out = F.when(F.col("route") == route, F.lit(float(w))).otherwise(out)
    return out


def rrf_scores(run: DataFrame, weights: dict[str, float] | None = None, k0: int = 60) -> DataFrame:
    """(query_id, comment_id, score): sum of weight / (k0 + rank); routes without a weight have 1."""
    return run.groupBy(*PAIR).agg(F.sum(weight_of(weights, 1.0) / (k0 + F.col("rank"))).alias("score"))


def cc_scores(run: DataFrame, weights: dict[str, float], normalization: str = "minmax") -> DataFrame:
    """(query_id, comment_id, score): sum of shares of weight times the score normalised in its route and query.

    Routes without a weight have 0, missing items add 0, and a total weight of 0 counts as 1.
    """
    total = sum(weights.values()) or 1.0
    value = normalized(F.col("score"), "comment_id", ["route", "query_id"], normalization)
    return run.withColumn("__n", value).groupBy(*PAIR).agg(F.sum(weight_of(weights, 0.0) / total * F.col("__n")).alias("score"))


def first_seen(run: DataFrame, routes: list[str]) -> DataFrame:
    """(query_id, comment_id, seen): the place at which a walk through the routes in order meets the item first."""
    place = F.lit(len(routes))
    for i, r in reversed(list(enumerate(routes))):
        place = F.when(F.col("route") == r, F.lit(i)).otherwise(place)
    return run.groupBy(*PAIR).agg(F.min(F.struct(place.alias("r"), F.col("rank"))).alias("seen"))


def fuse(run: DataFrame, routes: list[str], *, mode: str = "rrf", weights: dict[str, float] | None = None, k0: int = 60, k: int = 8, normalization: str = "minmax") -> DataFrame:
    """(query_id, comment_id, score, rank): the top k of the fused scores, rounded to 5 digits; ties keep the order in
    which a walk through `routes` meets them, not that of the ids."""
    scores = cc_scores(run, weights or {}, normalization) if mode == "cc" else rrf_scores(run, weights, k0)
    seen = scores.join(first_seen(run, routes), PAIR)
    return top_k(seen, ["query_id"], [F.desc("score"), "seen"], k).select(*PAIR, F.round("score", 5).alias("score"), "rank")


def fused_order(run: DataFrame, *, mode: str = "rrf", weights: dict[str, float] | None = None, k0: int = 60, normalization: str = "minmax") -> DataFrame:
    """The whole fused list in the total order (score, id)."""
    scores = cc_scores(run, weights or {}, normalization) if mode == "cc" else rrf_scores(run, weights, k0)
    return ranked(scores, ["query_id"], [F.desc("score"), "comment_id"])


def simplex(names: list[str], step: float) -> list[dict[str, float]]:
    """All weights over three names that are multiples of `step` and sum to 1, in order."""
    n = round(1 / step)
    return [dict(zip(names, (a / n, b / n, (n - a - b) / n))) for a in range(n + 1) for b in range(n + 1 - a)]


def tune_cc_weights(run: DataFrame, gold: DataFrame, routes: list[str], k: int = 8, step: float = 0.1, normalization: str = "minmax") -> DataFrame:
    """One row (grid, weights, value): the first weights of the grid with the largest mean nDCG@k over queries with gold.

    The grid is a small table of fixed size; normalised scores are computed once and pivoted to one row per pair, so that
    trying a grid point is one expression on it.
    """
    spark = run.sparkSession
    grid = [(i, *(w[r] for r in routes)) for i, w in enumerate(simplex(routes, step))]
    points = F.broadcast(spark.createDataFrame(grid, "grid int, " + ", ".join(f"w{i} double" for i in range(len(routes)))))
    value = run.withColumn("__n", normalized(F.col("score"), "comment_id", ["route", "query_id"], normalization))
    wide = value.groupBy(*PAIR).agg(*[F.coalesce(F.max(F.when(F.col("route") == r, F.col("__n"))), F.lit(0.0)).alias(f"n{i}") for i, r in enumerate(routes)])
    wide = wide.join(gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("golds")), "query_id")
    scored = wide.crossJoin(points).withColumn("score", sum((F.col(f"w{i}") * F.col(f"n{i}") for i in range(len(routes))), F.lit(0.0)))
    top = top_k(scored, ["grid", "query_id"], [F.desc("score"), "comment_id"], k)
    hits = top.join(gold.select(*PAIR).distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("golds", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = hits.groupBy("grid", "query_id").agg((F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)) / F.max(ideal)).alias("v"))
    means = per.groupBy("grid").agg(F.avg("v").alias("value")).join(points, "grid")
    return means.orderBy(F.desc(F.round("value", 9)), "grid").limit(1).select("grid", *[F.col(f"w{i}").alias(f"weight_{r}") for i, r in enumerate(routes)], "value")


def rank_prior(entry: DataFrame, model: DataFrame, mode: str, entry_weight: float) -> DataFrame:
    """Fusion of an entry order with a model's scores, weights entry_weight and 1 - entry_weight."""
    both = entry.withColumn("route", F.lit("entry")).unionByName(ranked(model.select(*PAIR, "score"), ["query_id"], [F.desc("score"), "comment_id"]).withColumn("route", F.lit("model")))
    return fused_order(both, mode=mode, weights={"entry": entry_weight, "model": 1 - entry_weight})


def protected_tail(head: DataFrame, extension: DataFrame, quota: int, k: int = 8) -> DataFrame:
    """(query_id, comment_id, rank): the first k - quota of `head`, then the best `quota` of `extension` by score."""
    kept = head.filter(F.col("rank") <= k - quota).select(*PAIR, F.lit(0).alias("part"), F.col("rank").alias("at"))
    fresh = extension.join(head.filter(F.col("rank") <= k - quota).select(*PAIR), PAIR, "left_anti")
    best = top_k(fresh, ["query_id"], [F.desc("score"), "comment_id"], quota, "at").select(*PAIR, F.lit(1).alias("part"), "at")
    return ranked(kept.unionByName(best), ["query_id"], ["part", "at"]).select(*PAIR, "rank")


def residual_slots(backbone: DataFrame, scores: DataFrame, k: int, budget: int) -> DataFrame:
    """Protects k - budget of the backbone, adds `budget` others by score, then the rest of the backbone up to k."""
    kept = backbone.filter(F.col("rank") <= k - budget).select(*PAIR, F.lit(0).alias("part"), F.col("rank").alias("at"))
    others = scores.join(kept.select(*PAIR), PAIR, "left_anti")
    best = top_k(others, ["query_id"], [F.desc("score"), "comment_id"], budget, "at").select(*PAIR, F.lit(1).alias("part"), "at")
    rest = backbone.filter(F.col("rank") > k - budget).select(*PAIR, F.lit(2).alias("part"), F.col("rank").alias("at"))
    first = kept.unionByName(best).unionByName(rest).groupBy(*PAIR).agg(F.min(F.struct("part", "at")).alias("o"))
    return top_k(first, ["query_id"], ["o"], k).select(*PAIR, "rank")


