"""Candidate pools: staged rules with provenance, matched budgets, and order-dependent merges of two lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import rrf_scores
from .ranking import ranked, top_k
from .setops import exclusives

PAIR = ["query_id", "comment_id"]


def staged_pool(stages: list[tuple[str, DataFrame]], size: int | None) -> DataFrame:
    """(query_id, comment_id, pos, rules): items in the order of the stages that first hold them, cut to `size`.

    Each stage is (rule, table of query_id, comment_id, at). `rules` names all stages that hold the item, joined by "|".
    """
    parts = [t.select(*PAIR, F.lit(i).alias("stage"), F.col("at").cast("int").alias("at"), F.lit(rule).alias("rule")) for i, (rule, t) in enumerate(stages)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    items = union.groupBy(*PAIR).agg(F.min(F.struct("stage", "at")).alias("o"), F.concat_ws("|", F.array_sort(F.collect_set("rule"))).alias("rules"))
    placed = ranked(items, ["query_id"], ["o", "comment_id"], "pos") if size is None else top_k(items, ["query_id"], ["o", "comment_id"], size, "pos")
    return placed.select(*PAIR, "pos", "rules")


def union_pool(run: DataFrame, routes: list[str], new_routes: list[str], size: int = 30, k: int = 5, exclusive_k: int = 3, depth: int = 20, k0: int = 60) -> DataFrame:
    """The top k of every route, then what the new routes alone find, then the fused order, cut to `size`.

    The order within a stage is by rank, then the route's place in `routes`. Labels are never read.
    """
    place = F.lit(len(routes))
    for i, r in reversed(list(enumerate(routes))):
        place = F.when(F.col("route") == r, F.lit(i)).otherwise(place)
    top = run.filter(F.col("route").isin(routes) & (F.col("rank") <= k)).groupBy(*PAIR).agg(F.min(F.col("rank") * len(routes) + place).alias("at"))
    stages = [("top", top)]
    for r in new_routes:
        alone = exclusives(run, r, exclusive_k, [x for x in routes if x != r], depth)
        stages.append((f"only_{r}", alone.withColumnRenamed("rank", "at")))
    fused = ranked(rrf_scores(run, None, k0), ["query_id"], [F.desc("score"), "comment_id"], "at")
    return staged_pool([*stages, ("rrf", fused)], size)


def disagreements(run: DataFrame, left: str, right: str, high: int = 10, low: int = 50) -> DataFrame:
    """(query_id, comment_id, at, kind): items among one route's first `high` that the other has beyond `low` or not."""
    a, b = (run.filter(F.col("route") == r).select(*PAIR, F.col("rank").alias(n)) for r, n in ((left, "ra"), (right, "rb")))
    both = a.join(b, PAIR, "full_outer")
    kind = F.when((F.col("ra") <= high) & (F.col("rb").isNull() | (F.col("rb") > low)), f"{left}_high").when((F.col("rb") <= high) & (F.col("ra").isNull() | (F.col("ra") > low)), f"{right}_high")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select(*PAIR, F.least(F.coalesce("ra", F.lit(9999)), F.coalesce("rb", F.lit(9999))).alias("at"), "kind")


def matched_pool(primary: DataFrame, extension: DataFrame, size: int, reserved: int) -> DataFrame:
    """size - reserved of the primary list, `reserved` of the extension, and the rest of the primary to fill up."""
    head = primary.filter(F.col("rank") <= size - reserved).select(*PAIR, F.col("rank").alias("at"))
    fresh = extension.join(head.select(*PAIR), PAIR, "left_anti")
    added = top_k(fresh.drop("rank"), ["query_id"], [F.desc("score"), "comment_id"], reserved, "at").select(*PAIR, "at")
    rest = primary.filter(F.col("rank") > size - reserved).select(*PAIR, F.col("rank").alias("at"))
    return staged_pool([("primary", head), ("extension", added), ("fill", rest)], size)


def round_robin(run: DataFrame, routes: list[str], excluded: DataFrame, budget: int) -> DataFrame:
    """(query_id, comment_id, pos, first_route): routes take turns in order; each gives its next item that is neither
    excluded nor taken, until `budget` items are taken.

    Whose turn takes an item depends on all earlier turns, so this is a grouped pandas function. A route needs no more
    than its first budget * routes items that are not excluded, and only those are grouped.
    """
    left = run.filter(F.col("route").isin(routes)).join(excluded.select(*PAIR).distinct(), PAIR, "left_anti")
    short = top_k(left.select("route", *PAIR, F.col("rank").alias("was")), ["route", "query_id"], ["was", "comment_id"], budget * len(routes))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        lists = [g[g["route"] == r].sort_values(["rank"])["comment_id"].tolist() for r in routes]
        at, taken = [0] * len(routes), {}
        while len(taken) < budget and any(a < len(x) for a, x in zip(at, lists)):
            for i, x in enumerate(lists):
                while at[i] < len(x) and x[at[i]] in taken:
                    at[i] += 1
                if at[i] < len(x) and len(taken) < budget:
                    taken[x[at[i]]] = routes[i]
                    at[i] += 1
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]] * len(taken), "comment_id": list(taken), "pos": range(1, len(taken) + 1), "first_route": list(taken.values())})

    kinds = dict(run.dtypes)
    return short.groupBy("query_id").applyInPandas(merge, f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, pos int, first_route string")


def interleave(run: DataFrame, first: str, second: str, share: float, size: int) -> DataFrame:
    """(query_id, comment_id, pos): draws from the list that is furthest behind its share (`share` for the first), each
    item once, up to `size`; a list that ends leaves the rest to the other. Ties go to the first."""
    short = run.filter(F.col("route").isin(first, second) & (F.col("rank") <= 2 * size)).select("route", *PAIR, "rank")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        lists = [g[g["route"] == r].sort_values("rank")["comment_id"].tolist() for r in (first, second)]
        at, counts, taken = [0, 0], [0, 0], {}
        while len(taken) < size:
            for i in (0, 1):
                while at[i] < len(lists[i]) and lists[i][at[i]] in taken:
                    at[i] += 1
            ready = [i for i in (0, 1) if at[i] < len(lists[i])]
            if not ready:
                break
            wanted = (share, 1 - share)
            n = len(taken) + 1
            i = max(ready, key=lambda i: (round(wanted[i] * n - counts[i], 9), -i))
            taken[lists[i][at[i]]] = None
            at[i] += 1
            counts[i] += 1
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]] * len(taken), "comment_id": list(taken), "pos": range(1, len(taken) + 1)})

    kinds = dict(run.dtypes)
    return short.groupBy("query_id").applyInPandas(merge, f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, pos int")
