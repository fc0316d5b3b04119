"""A varied subset by minimum-cost flow quotas over category combinations."""

from __future__ import annotations

import hashlib
import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import cut, unit_hash


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # to, capacity left, cost; arc i and i ^ 1 are a pair
        self.of: dict = {}

    def add(self, a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.of.setdefault(x, []).append(len(self.arcs))
            self.of.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def add_convex(self, a, b, free: int, capacity: int, unit: int, steps: int = 12) -> None:
        """An arc whose first `free` units cost nothing and further ones ever more, in `steps` growing segments."""
        self.add(a, b, min(free, capacity), 0)
        rest, width = capacity - free, max(1, -(-free // 4))
        for step in range(1, steps + 1):
            if rest <= 0:
                return
            w = rest if step == steps else min(rest, width)
            self.add(a, b, w, unit * (2 * step - 1))
            rest -= w
            width *= 1 if step < 6 else 4

    def push(self, source, sink, amount: int) -> int:
        """Sends up to `amount`; what was sent."""
        potential, sent = dict.fromkeys(self.of, 0), 0
        while sent < amount:
            far, via, heap = {source: 0}, {}, [(0, 0, source)]
            number, done = 0, set()
            while heap:
                d, _, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for i in self.of[x]:
                    y, c, w = self.arcs[i]
                    if c > 0 and y not in done and (e := d + w + potential[x] - potential[y]) < far.get(y, 1 << 60):
                        far[y], via[y] = e, i
                        number += 1
                        heapq.heappush(heap, (e, number, y))
            if sink not in far:
                break
            for x, d in far.items():
                potential[x] += d
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.arcs[via[x] ^ 1][0]
            w = min([amount - sent, *(self.arcs[i][1] for i in path)])
            for i in path:
                self.arcs[i][1] -= w
                self.arcs[i ^ 1][1] += w
            sent += w
        return sent


def balanced_quotas(counts: dict[tuple, int], size: int) -> dict[tuple, int]:
    """How many to take of each combination (a tuple of categories, one of each dimension), in all min(size, sum).

    Flow runs from a source through runs of neighbouring categories of the first dimension and those categories to the
    combinations, and on through the others' categories to a sink. Each run, category and combination has its share of
    the size as its target; what goes beyond costs ever more, so it is used only where others have no more records.
    Runs of neighbours spread sizes below the number of categories over the whole range.
    """
    combos = sorted((k for k in counts if counts[k] > 0), key=lambda k: hashlib.md5(repr(k).encode()).digest())
    size = min(size, sum(counts[k] for k in combos))
    if not size:
        return {}
    first = {k[0] for k in combos}
    rest = {k[1:] for k in combos}
    net = Flow()
    ordered = sorted(first, key=lambda a: (isinstance(a, str), a))
    width = math.isqrt(len(ordered) - 1) + 1
    for g in range(0, len(ordered), width):
        near = ordered[g : g + width]
        have = {a: sum(counts[k] for k in combos if k[0] == a) for a in near}
        share = -(-size * len(near) // len(ordered))
        net.add_convex("source", ("near", g), min(sum(have.values()), share), min(sum(have.values()), size), 256)
        for a in near:
            net.add_convex(("near", g), ("a", a), min(have[a], -(-size // len(first))), min(have[a], size), 64)
    for b in sorted(rest, key=repr):
        have = sum(counts[k] for k in combos if k[1:] == b)
        net.add_convex(("b", b), "sink", min(have, -(-size // len(rest))), min(have, size), 16)
    taken = {}
    for k in combos:
        net.add(("a", k[0]), ("in", k), min(counts[k], size), 0)
        net.add_convex(("in", k), ("out", k), min(counts[k], -(-size // len(combos))), min(counts[k], size), 4)
        taken[k] = net.add(("out", k), ("b", k[1:]), min(counts[k], size), 0)
    net.push("source", "sink", size)
    return {k: net.arcs[i ^ 1][1] for k, i in taken.items() if net.arcs[i ^ 1][1]}


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin, values outside in the outermost; -1 for null and NaN."""
    at = F.floor((x - low) / ((high - low) / bins))
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))).cast("int")


def varied_subset(rows: DataFrame, sizes: list[int], key: str, categories: dict[str, Column], cell: list[Column]) -> DataFrame:
    """(subset_size, key, categories, rank): for each size, min(size, number of keys) distinct keys, spread over the categories.

    `rows` is unique in `key`. `categories` are columns of few values (their product bounds what reaches the driver).
    `cell` are columns that are equal for records that hardly differ; within a combination every cell gives one record
    before any gives a second, and a hash of the key decides among equals, so the same rows give the same subset.
    Ranks within cells and combinations are cut to the quota before the shuffle, so large groups are never gathered.
    Null keys are left out; an empty table gives no rows; a size of 0 gives none.
    """
    names = list(categories)
    sizes = sorted({int(s) for s in sizes if s and s > 0})
    base = rows.filter(F.col(key).isNotNull()).select(key, *[c.alias(n) for n, c in categories.items()], F.xxhash64(*cell).alias("__cell"), unit_hash(key, F.lit("subset")).alias("__u"))
    most = max(sizes, default=0)
    by_cell = W.partitionBy(*names, "__cell").orderBy("__u", key)
    by_combo = W.partitionBy(*names).orderBy("__turn", "__u", key)
    ranked = (
        base.withColumn("__turn", F.row_number().over(by_cell)).filter(F.col("__turn") <= most)
        .withColumn("rank", F.row_number().over(by_combo)).filter(F.col("rank") <= most)
    )
    counts = {tuple(r[n] for n in names): r["n"] for r in base.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = rows.sparkSession
    quotas = [(size, *k, n) for size in sizes for k, n in balanced_quotas(counts, size).items()]
    kinds = dict(base.dtypes)
    schema = ", ".join(["subset_size int", *(f"`{n}` {kinds[n]}" for n in names), "__quota int"])
    plan = spark.createDataFrame(quotas, schema)
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"q.{n}")) for n in names]
    # one row for each size and combination: few, as the categories are
    picked = cut(ranked).alias("r").join(F.broadcast(plan).alias("q"), [*same, F.col("r.rank") <= F.col("q.__quota")])
    return picked.select("subset_size", key, *[F.col(f"r.{n}") for n in names], "rank")
