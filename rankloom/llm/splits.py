"""Splits that keep related records together: components over shared entities, then hashed ranges of the shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.base import cut, lookup_skewed, unit_hash

#: Writings of "nobody" and accounts of machines, which tie nothing.
NOBODY = ["", "nan", "none", "null", "[deleted]", "[removed]", "automoderator", "b0trank", "repostsleuthbot"]


def canonical(name: Column) -> Column:
    """Lower case, no blanks around, no prefix (u/, t1_ to t6_) and no link around it; nobody is null."""
    x = F.lower(F.trim(F.regexp_replace(name, r"[\s ​﻿]+", " ")))
    x = F.regexp_replace(x, r"^(?:https?://)?[^\s/]+\.[^\s/]+/(?:.*/)?(?:comments|user|u)/([^/?#\s]+).*$", "$1")
    x = F.regexp_replace(x, r"^(?:https?://)?[^\s/]+\.[^\s/]+/([^/?#\s]+)/?(?:[?#].*)?$", "$1")
    x = F.regexp_replace(x, r"^/*(?:u|user)/+", "")
    x = F.trim(F.regexp_replace(x, r"^(?:/+|@|t[1-6]_)", ""))
    return F.when(~x.isin(NOBODY), x)


def entity_links(rows: DataFrame, key: str, entities: dict[str, list[str]]) -> DataFrame:
    """Distinct (id, entity): the entity is its kind and canonical name. `entities`: kind -> columns."""
    parts = [F.when(canonical(F.col(c)).isNotNull(), F.concat(F.lit(f"{kind}:"), canonical(F.col(c)))) for kind, columns in entities.items() for c in columns]
    return (
        rows.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("id"), F.explode(F.array_distinct(F.array(*parts))).alias("entity"))
        .filter(F.col("entity").isNotNull())
        .distinct()
    )


def _smallest(edges: DataFrame, at: str, other: str) -> DataFrame:
    """For each `at`, the smallest node among it and its neighbours, and its number of edges; partial sums come first."""
    return edges.groupBy(at).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", at))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of the undirected edges (a, b) by alternating large-star and small-star; component: smallest node.

    Each step computes minima per node by aggregation with partial sums and looks them up skew-safely, so that a node
    with a third of all edges is never gathered in one task. Ends when a round changes no edge (compared by count and
    sum of hashes); raises if it does not within `max_rounds`, rather than return a partial result.
    """
    # the larger end first
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lookup_skewed(both, _smallest(both, "u", "v"), "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(large.filter("u <> v").distinct())
        star = _smallest(e, "u", "v")
        small = lookup_skewed(e, star, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = now
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def related_groups(rows: DataFrame, key: str, entities: dict[str, list[str]]) -> DataFrame:
    """(id, group): one row per distinct non-null key; the group is the smallest key tied to it over any number of shared entities.

    Links are reduced to one edge from each record to the smallest record of the entity before components are sought, so
    no pairs within an entity arise. Null keys are left out; repeated rows count once; a record without entities is its
    own group; an empty table gives an empty result; other columns are ignored.
    """
    links = cut(entity_links(rows, key, entities))
    heads = links.groupBy("entity").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    edges = lookup_skewed(links, heads.filter("n > 1"), "entity", "n").select(F.col("id").alias("a"), F.col("head").alias("b"))
    components = connected_components(edges)
    # components are named by their smallest node, which is a record, as only records are nodes
    ids = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id")).distinct()
    return ids.join(components, ids.id == components.node, "left").select("id", F.coalesce("component", "id").alias("group"))


#: Steps of the hash at which ranges of splits may end; so many numbers reach the driver.
RANGES = 4096


def grouped_split(groups: DataFrame, shares: dict[str, float], giant: float = 0.01) -> DataFrame:
    """(id, group, split): every group lies in one split, and the splits are close to the shares.

    A group's hash falls into one of the splits' ranges of [0, 1). Groups of more than `giant` of all records (at most
    1/giant of them, so the driver can hold them) are placed first, each where most is missing. The ranges end where the
    other groups' records, counted by RANGES steps of the hash, come closest to the shares that are then left.
    """
    groups = cut(groups)
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = sizes.filter(F.col("n") > max(1.0, giant * total)).orderBy(F.desc("n"), "group").collect() if total else []
    left = {k: v / sum(shares.values()) * total for k, v in shares.items()}
    placed: dict[str, str] = {}
    for r in big:
        to = max(left, key=lambda k: left[k])
        placed[r["group"]] = to
        left[to] -= r["n"]
    rest = {k: max(0.0, v) for k, v in left.items()}
    whole = sum(rest.values()) or 1.0
    point = F.floor(unit_hash("group", F.lit("split")) * RANGES)
    steps = sizes.filter(~F.col("group").isin(list(placed))) if placed else sizes
    counts = np.zeros(RANGES)
    for r in steps.groupBy(point.alias("step")).agg(F.sum("n").alias("n")).collect() if total else []:
        counts[r["step"]] = r["n"]
    before = np.concatenate([[0.0], np.cumsum(counts)])
    start, wanted, split = 0, 0.0, None
    for name, missing in rest.items():
        wanted += missing / whole * before[-1]
        end = max(start, int(np.abs(before - wanted).argmin()))
        inside = (point >= start) & (point < end)
        split = F.when(inside, F.lit(name)) if split is None else split.when(inside, F.lit(name))
        start = end
    split = split.otherwise(F.lit(max(rest, key=lambda k: rest[k])))
    if placed:
        split = F.coalesce(F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])[F.col("group")], split)
    return groups.select("id", "group", split.alias("split"))
