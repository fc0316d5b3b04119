"""Filling context windows with documents: hierarchical packing over a histogram of lengths."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import cut

_encoders: dict = {}


def encoder(vocabulary: str):
    """The byte-pair tokenizer of a .tiktoken file, once for each Python worker."""
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens): one row per distinct non-null key, the largest count of its rows; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(encode(t.encode("utf-8", "replace").decode())) if t else 0 for t in b[text]]})

    kind = dict(documents.dtypes)[key]
    rows = documents.filter(F.col(key).isNotNull()).select(key, text).mapInPandas(count, f"`{key}` {kind}, n_tokens bigint")
    return rows.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))


def pack_tiers(counts: dict[int, dict[int, int]]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Packs counts[tier][n] items of n <= tier tokens into windows of the tiers' sizes, from the longest tier to the
    shortest; rows (tier, n, first rank, items, items a window, window size, first window, offset).

    Items of a tier, from long to short, first fill the gaps of longer tiers' windows; only what fits in none of them goes
    into windows of its own tier. Both times the fullest windows that still hold an item take it (best fit). Windows that
    are filled alike are one class with a count; a class is split only where it runs out of items. A class holds
    consecutive window numbers, which count from 0 in each size.
    """
    plan, rooms, open_by_room = [], [], {}  # room -> (window size, first window, windows)

    def put(room: int, size: int, first: int, many: int) -> None:
        if many and room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((size, first, many))

    def fill(tier: int, n: int, rank: int, left: int) -> tuple[int, int]:
        while left and (at := bisect_left(rooms, n)) < len(rooms):
            room = rooms[at]
            size, first, have = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            each = min(room // n, left)
            many = min(have, left // each)
            plan.append((tier, n, rank, many * each, each, size, first, size - room))
            put(room - each * n, size, first, many)
            put(room, size, first + many, have - many)
            rank, left = rank + many * each, left - many * each
        return rank, left

    for tier in sorted(counts, reverse=True):
        rest = [(n, *fill(tier, n, 0, counts[tier][n])) for n in sorted((n for n in counts[tier] if 0 < n <= tier), reverse=True)]
        longer, windows = (rooms, open_by_room), 0
        rooms, open_by_room = [], {}
        for n, rank, left in rest:
            while left:
                rank, left = fill(tier, n, rank, left)
                if left:
                    each = min(tier // n, left)
                    many = left // each
                    plan.append((tier, n, rank, many * each, each, tier, windows, 0))
                    put(tier - each * n, tier, windows, many)
                    windows, rank, left = windows + many, rank + many * each, left - many * each
        for room in longer[0]:
            for size, first, many in longer[1][room]:
                put(room, size, first, many)
    return plan


def pack_histogram(counts: dict[int, int], capacity: int, tiers: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """`pack_tiers` with one size of windows; rows (n, first rank, items, items a window, first window, offset).

    That is best-fit decreasing. `tiers` change nothing, as lengths in decreasing order go from tier to tier anyway.
    """
    return [(n, rank, items, each, first, at) for _, n, rank, items, each, _, first, at in pack_tiers({capacity: counts})]


def pack(lengths: DataFrame, key: str, size: str, capacities: list[int], step_windows: int = 64, bucket_rows: int = 200_000) -> DataFrame:
    """(capacity_tokens, key, piece, n_tokens, window_id, start, step_group) for each capacity over all documents.

    `lengths` is unique in `key`. A document longer than the capacity is cut into whole windows and a rest (piece 0, 1,
    ...); no other is cut. Documents of 0 tokens take part with 0 tokens in window 0. Nothing but the histogram of
    lengths (no more numbers than the largest capacity has) reaches the driver; documents find their place from their
    rank among those of equal length, which is counted in hashed buckets of about `bucket_rows` pieces, so that no length,
    however common, and no document, however long, is gathered in one task. Windows are dealt to step groups of about `step_windows` in order of their
    fill, forwards and backwards in turn, so that all groups hold about the same number of tokens.
    """
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    every = F.explode(F.array(*[F.lit(c) for c in capacities])) if capacities else F.lit(None).cast("int")
    return _placed(lengths, key, size, every, lambda histogram: {c: _plan({c: histogram.get(c, {})}, step_windows) for c in capacities}, bucket_rows)


def tiered(lengths: DataFrame, key: str, size: str, tiers: list[int], step_windows: int = 64, bucket_rows: int = 200_000) -> DataFrame:
    """Each document once: routed to the shortest tier that holds it (the longest for longer ones), and packed from the
    longest tier to the shortest, gaps of longer tiers' windows first (`pack_tiers`).

    Same columns and cases as `pack`; capacity_tokens is the size of the window, which may be longer than the document's
    tier. Windows of all tiers are dealt to the same step groups.
    """
    tiers = sorted({int(t) for t in tiers if t and t > 0})
    routed = F.coalesce(*[F.when(F.col("__n") <= t, F.lit(t)) for t in tiers], F.lit(tiers[-1] if tiers else None).cast("int"))
    return _placed(lengths, key, size, routed, lambda histogram: dict.fromkeys(tiers, _plan({t: histogram.get(t, {}) for t in tiers}, step_windows)), bucket_rows)


def _placed(lengths: DataFrame, key: str, size: str, capacity: Column, plan: Callable[[dict], dict], bucket_rows: int) -> DataFrame:
    """The rows of `pack`. capacity: the tiers of a document of `__n` tokens; plan: from the lengths' counts by tier, each
    tier's `_plan`."""
    spark = lengths.sparkSession
    pieces = (
        lengths.filter(F.col(key).isNotNull())
        .select(key, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("__n"))
        .withColumn("capacity_tokens", capacity)
        .withColumn("__whole", F.floor(F.col("__n") / F.col("capacity_tokens")).cast("bigint"))
    )
    # the rest of each document, and apart from it the whole windows that only one document fills
    rest = pieces.select(key, "capacity_tokens", F.when(F.col("__n") % F.col("capacity_tokens") == 0, F.least(F.col("__n"), F.lit(0))).otherwise(F.col("__n") % F.col("capacity_tokens")).alias("n_tokens"), F.col("__whole").alias("piece"))
    rest = rest.filter((F.col("n_tokens") > 0) | (F.col("piece") == 0))
    full = pieces.filter("__whole > 0").select(key, "capacity_tokens", F.col("capacity_tokens").cast("bigint").alias("n_tokens"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__whole") - 1)).alias("piece"))
    items = cut(rest.unionByName(full))
    buckets = max(1, items.count() // bucket_rows)
    items = items.withColumn("__b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    cells = items.groupBy("capacity_tokens", "n_tokens", "__b").agg(F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("capacity_tokens", "n_tokens").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = W.partitionBy("capacity_tokens", "n_tokens", "__b").orderBy(key, "piece")
    ranked = items.withColumn("__r", F.row_number().over(within) - 1).join(cells, ["capacity_tokens", "n_tokens", "__b"])
    ranked = ranked.select("capacity_tokens", key, "piece", "n_tokens", (F.col("__r") + F.col("__before")).alias("__rank"))

    histogram: dict[int, dict[int, int]] = {}
    for r in items.groupBy("capacity_tokens", "n_tokens").agg(F.count(F.lit(1)).alias("c")).collect():
        histogram.setdefault(r["capacity_tokens"], {})[r["n_tokens"]] = r["c"]
    shared = spark.sparkContext.broadcast(plan(histogram))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tier = b["capacity_tokens"]
            b = b.assign(window_id=0, start=0, step_group=0)
            for c, part in b.groupby(tier, sort=False):
                p = shared.value[c]
                rows = p["rows"][c]
                n, rank = part["n_tokens"].to_numpy(), part["__rank"].to_numpy()
                ok = n > 0
                at = np.searchsorted(rows["order"], n[ok] * p["stride"] + rank[ok], side="right") - 1
                inside = rank[ok] - rows["rank"][at]
                window = rows["window"][at] + inside // rows["each"][at]
                w, s, g, size_of = *(np.zeros(len(n), dtype=np.int64) for _ in range(3)), np.full(len(n), c, dtype=np.int32)
                w[ok], s[ok], size_of[ok] = window - rows["base"][at], rows["start"][at] + inside % rows["each"][at] * n[ok], rows["size"][at]
                cls = np.searchsorted(p["class_first"], window, side="right") - 1
                fill_rank = p["class_rank"][cls] + window - p["class_first"][cls]
                groups = p["groups"]
                lap, place_in = fill_rank // groups, fill_rank % groups
                g[ok] = np.where(lap % 2 == 0, place_in, groups - 1 - place_in)
                b.loc[part.index, "window_id"], b.loc[part.index, "start"], b.loc[part.index, "step_group"], b.loc[part.index, "capacity_tokens"] = w, s, g, size_of
            yield b[["capacity_tokens", key, "piece", "n_tokens", "window_id", "start", "step_group"]]

    kind = dict(items.dtypes)[key]
    return ranked.mapInPandas(place, f"capacity_tokens int, `{key}` {kind}, piece bigint, n_tokens bigint, window_id bigint, start bigint, step_group bigint")


def _plan(counts: dict[int, dict[int, int]], step_windows: int) -> dict:
    """Where the items of each tier lie, and the order of all windows by fill; windows of all sizes are numbered in one row."""
    a = np.array(sorted(pack_tiers(counts)), dtype=np.int64).reshape(-1, 8)
    tier, n, rank, items, each, size, first, start = a.T
    stride = int(max([1, *(c for t in counts.values() for c in t.values())])) + 1
    base, windows = np.zeros(len(a), dtype=np.int64), 0
    for t in sorted(counts):
        base[size == t] = windows
        windows += int(max((first + items // each)[size == t], default=0))
    window = base + first
    edges = np.unique(np.concatenate([window, window + items // each]) if len(a) else np.zeros(1, dtype=np.int64))
    # tokens of the windows between two edges, which are all filled alike
    change = np.zeros(len(edges) + 1, dtype=np.int64)
    np.add.at(change, np.searchsorted(edges, window), n * each)
    np.add.at(change, np.searchsorted(edges, window + items // each), -n * each)
    fill, width = np.cumsum(change)[: len(edges)], np.diff(np.append(edges, edges[-1]))
    order = np.argsort(-fill, kind="stable")
    fill_rank = np.zeros(len(edges), dtype=np.int64)
    fill_rank[order] = np.concatenate([[0], np.cumsum(width[order])[:-1]])
    rows = {t: {"order": n[tier == t] * stride + rank[tier == t], "rank": rank[tier == t], "each": each[tier == t], "window": window[tier == t], "start": start[tier == t],
                "size": size[tier == t], "base": base[tier == t]} for t in counts}
    return {"rows": rows, "stride": stride, "class_first": edges, "class_rank": fill_rank, "groups": max(1, windows // step_windows)}
