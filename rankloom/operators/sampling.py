"""Samples, quotas, folds and splits by hash order: the same rows give the same sample on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from rankloom.base import lookup_skewed

from .ranking import ranked, ranked_split, top_k


def seeded(item: str, seed: int) -> Column:
    """A reproducible random order of the items: the first 15 hex digits of a digest of item and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", F.col(item), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def uniform(df: DataFrame, item: str, n: int, seed: int = 7) -> DataFrame:
    """n rows by seeded order (all, if there are fewer); null items are left out."""
    return df.filter(F.col(item).isNotNull()).orderBy(seeded(item, seed), item).limit(n)


def quota(df: DataFrame, strata: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each stratum."""
    return top_k(df, strata, order, n, "pick")


def balanced(df: DataFrame, strata: list[str], item: str, n: int, seed: int = 7) -> DataFrame:
    """n rows taken in turns from the strata: everyone's first in seeded order, then everyone's second, and so on."""
    placed = top_k(df.filter(F.col(item).isNotNull()), strata, [seeded(item, seed), item], n, "turn")
    return placed.orderBy("turn", *strata).limit(n)


def folds(df: DataFrame, item: str, n: int, repeats: int = 1, seed: int = 7) -> DataFrame:
    """(item, repeat, fold): in every repeat each distinct item is in one of n folds of nearly equal size."""
    items = df.filter(F.col(item).isNotNull()).select(item).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.conv(F.substring(F.md5(F.concat_ws("#", F.col(item), F.lit(str(seed)), F.col("repeat"))), 1, 15), 16, 10).cast("bigint")
    return items.select(item, "repeat", F.pmod(order, F.lit(n)).cast("int").alias("fold"))


def stratified_split(df: DataFrame, strata: list[str], item: str, share: float, seed: int = 7) -> DataFrame:
    """(item, strata, split): in each stratum the first round(share * size) items in seeded order are "holdout"."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    rows = df.select(item, *strata).withColumn("__o", seeded(item, seed))
    placed = ranked_split(rows, strata, ["__o", item], "__p").withColumn("__s", F.struct(*strata))
    placed = lookup_skewed(placed, sizes.select(F.struct(*strata).alias("__s"), "__n"), "__s", "__n")
    return placed.select(item, *strata, F.when(F.col("__p") <= F.round(F.col("__n") * share), "holdout").otherwise("train").alias("split"))


def slots(df: DataFrame, query: str, item: str, predicates: dict[str, Column], order: list[Column | str], per_query: int) -> DataFrame:
    """(query, item, slot): each slot takes its best item that no earlier slot took, then the best others fill up to
    `per_query`. Each slot is one anti-join and one top-1, so nothing is gathered per query."""
    taken = None
    for name, wanted in predicates.items():
        fresh = df.filter(wanted) if taken is None else df.filter(wanted).join(taken.select(query, item), [query, item], "left_anti")
        best = top_k(fresh, [query], order, 1, "__p").select(query, item, F.lit(name).alias("slot"))
        taken = best if taken is None else taken.unionByName(best)
    rest = df.join(taken.select(query, item), [query, item], "left_anti")
    more = ranked(rest, [query], order, "__p").select(query, item, F.lit("fill").alias("slot"), F.col("__p").alias("at"))
    counts = taken.groupBy(query).agg(F.count(F.lit(1)).alias("c"))
    fill = more.join(counts, query, "left").filter(F.col("at") + F.coalesce("c", F.lit(0)) <= per_query).select(query, item, "slot")
    return taken.unionByName(fill)


def tier_of(n: Column) -> Column:
    """Depth of a thread by its number of comments."""
    return F.when(n >= 16, "deep").when(n >= 4, "mid").when(n >= 1, "shallow").otherwise("none")


