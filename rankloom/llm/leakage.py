"""Held-out items inside a corpus: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.base import cut

from .normal import WordHashes, mixed, shingles, words

#: Words of a shingle; words of a segment of an item; the sizes (words) by which windows of documents are partitioned.
SHINGLE, SEGMENT, SIZES = 5, 16, (16, 32, 48)
#: Words of items in a block, whose index (some 16 bytes for each of 9 keys a word) goes to all tasks at once; and words of
#: documents that a task searches at once.
BLOCK_WORDS, CHUNK_WORDS = 100_000, 200_000

_word_hash = WordHashes()


def bands_of(size: int, contained: float, wanted: float = 0.97) -> int:
    """Number of one-row bands so that a segment of which `contained` is in a window of `size` words is met with chance `wanted`.

    Containment c of a set of q in one of u shingles means a Jaccard similarity of at least c / (u / q + 1 - c).
    """
    u, q = max(1, size - SHINGLE + 1), SEGMENT - SHINGLE + 1
    j = contained / (max(u, q) / q + 1 - contained)
    return int(np.ceil(np.log(1 - wanted) / np.log(1 - j)))


def windows_of(n: int) -> list[tuple[int, int, int]]:
    """(partition, start, end) of the windows over n words: a text that fits the smallest size is one, longer ones are cut
    into windows of the largest size that overlap by a segment, so that each segment lies whole in one."""
    for p, size in enumerate(SIZES):
        if n <= size:
            return [(p, 0, n)] if n else []
    size, step = SIZES[-1], SIZES[-1] - SEGMENT
    starts = [*range(0, n - size, step), n - size]
    return [(len(SIZES) - 1, s, s + size) for s in starts]


def segments_of(n: int) -> list[tuple[int, int]]:
    """Overlapping segments of an item's n words."""
    if n <= SEGMENT:
        return [(0, n)] if n else []
    return [(s, s + SEGMENT) for s in [*range(0, n - SEGMENT, SEGMENT // 2), n - SEGMENT]]


#: Odd factors of the hash functions, and what is added to a minimum by its partition and function, so that only minima of
#: the same function and partition of sizes meet.
_FACTORS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_SALTS = mixed(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(4, 256)


def band_keys(shingle: np.ndarray, starts: np.ndarray, ends: np.ndarray, partition: np.ndarray, bands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, stretch) of each band of each stretch shingle[start:end]: the minimum of one hash function over its shingles.

    A partition has bands[partition] of them. All stretches of many texts are reduced at once for each function.
    """
    keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    padded = np.append(shingle, np.uint64(0))
    order = np.argsort(partition, kind="stable")
    many = np.array(bands)[partition[order]]
    with np.errstate(over="ignore"):
        for f in range(max(bands, default=0)):
            some = order[many > f]
            if len(some):
                edges = np.stack([starts[some], ends[some]], axis=1).ravel()
                least = np.minimum.reduceat(padded * _FACTORS[f], edges)[::2]
                keys.append(mixed(least + _SALTS[partition[some], f]))
                owners.append(some)
    return np.concatenate(keys), np.concatenate(owners)


class Index:
    """The held-out items of one block: their words' shingles, and the keys of their segments under every partition, as the
    partition of the documents that hold an item isn't known. Shingles of several items aren't in the keys."""

    def __init__(self, items: list[tuple], common: set[int], contained: float) -> None:
        self.ids, self.bands = [i[0] for i in items], [bands_of(s, contained) for s in SIZES]
        self.parts = [[self._part(t.split(), common) for t in i[1:]] for i in items]
        keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for at, parts in enumerate(self.parts):
            for n, sh, own in parts:
                cuts = [(a, max(a + 1, b - SHINGLE + 1)) for a, b in segments_of(n)]
                kept = [sh[a:b][own[a:b]] for a, b in cuts]
                kept = [k for k in kept if len(k)]
                if kept:
                    ends = np.cumsum([len(k) for k in kept])
                    starts = ends - [len(k) for k in kept]
                    for p in range(len(SIZES)):
                        k, _ = band_keys(np.concatenate(kept), starts, ends, np.full(len(kept), p), self.bands)
                        keys.append(k)
                        owners.append(np.full(len(k), at))
        both = np.unique(np.stack([np.concatenate(keys).view(np.int64), np.concatenate(owners)]), axis=1)
        self.keys, self.owners = both[0].view(np.uint64), both[1]
        self.maybe: np.ndarray | None = None

    @staticmethod
    def _part(w: list[str], common: set[int]) -> tuple[int, np.ndarray, np.ndarray]:
        sh = shingles(_word_hash(w), SHINGLE)
        return len(w), sh, np.array([s not in common for s in sh.tolist()], dtype=bool)

    def met(self, keys: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, item) of the keys that items have too; a bit map sorts out nearly all others."""
        if self.maybe is None:
            self.maybe = np.zeros(1 << 22, dtype=bool)
            self.maybe[self.keys & np.uint64((1 << 22) - 1)] = True
        near = np.flatnonzero(self.maybe[keys & np.uint64((1 << 22) - 1)])
        keys, stretches = keys[near].view(np.int64), stretches[near]
        held = self.keys.view(np.int64)
        first, last = np.searchsorted(held, keys), np.searchsorted(held, keys, side="right")
        many = last - first
        at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(stretches, many), self.owners[at]

    def holds(self, item: int, document: np.ndarray, whole: float, part: float) -> bool:
        return any(coverage(n, np.isin(sh, document), own) >= least for (n, sh, own), least in zip(self.parts[item], (whole, part)))

    def search(self, texts: list[list[str]], whole: float, part: float) -> list[tuple[int, int]]:
        """(text, item) of the texts, as words, that hold an item."""
        if not len(self.keys):
            return []
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        hashes = _word_hash([x for w in texts for x in w])
        # shingles of all texts in one row; those that reach into the next text are not used
        wide = shingles(np.concatenate([hashes, np.zeros(SHINGLE - 1, dtype=np.uint64)]), SHINGLE)
        first = np.cumsum(lengths) - lengths
        owner, partition, starts, ends = [], [], [], []
        for t, n in enumerate(lengths.tolist()):
            if n < SHINGLE:
                continue
            for p, a, b in windows_of(n):
                owner.append(t)
                partition.append(p)
                starts.append(a)
                ends.append(b - SHINGLE + 1)
        owner = np.array(owner, dtype=np.int64)
        base = first[owner] if len(owner) else np.zeros(0, dtype=np.int64)
        keys, windows = band_keys(wide, base + np.array(starts, dtype=np.int64), base + np.array(ends, dtype=np.int64), np.array(partition, dtype=np.int64), self.bands)
        window, item = self.met(keys, windows)
        met = set(zip(owner[window].tolist(), item.tolist()))
        of = {t: np.unique(wide[first[t] : first[t] + lengths[t] - SHINGLE + 1]) for t in {t for t, _ in met}}
        out = [(t, i) for t, i in sorted(met) if self.holds(i, of[t], whole, part)]
        for t, n in enumerate(lengths.tolist()):  # texts shorter than a shingle can only be a short item as a whole
            if 0 < n < SHINGLE:
                s = shingles(hashes[first[t] : first[t] + n], SHINGLE)
                out += [(t, i) for i, parts in enumerate(self.parts) if any(m == n for m, _, _ in parts) and self.holds(i, s, whole, part)]
        return out


def coverage(n: int, held: np.ndarray, own: np.ndarray, gap: int = 2) -> float:
    """Share of an item's n words that lie in shingles which a document holds too, or in gaps of up to `gap` words between
    two such stretches (altered words). 0 unless one of them is the item's own, not one of several items."""
    if not n or not (held & own).any():
        return 0.0
    k = n - len(held) + 1
    hit = np.zeros(n, dtype=bool)
    for i in range(k):
        hit[i : i + len(held)] |= held
    at = np.flatnonzero(hit)
    for a, b in zip(at[:-1], at[1:]):
        if 1 < b - a <= gap + 1:
            hit[a:b] = True
    return float(hit.sum()) / n


def without_instruction(w: list[str], standing: list[list[str]]) -> list[str]:
    for s in standing:
        if w[: len(s)] == s and len(w) > len(s):
            return w[len(s) :]
    return w


def leaks(
    documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, question: str, passage: str,
    *, whole: float = 0.75, part: float = 1 / 3, contained: float = 0.4,
) -> DataFrame:
    """(doc_key, item_key): documents that hold `whole` of an item's question or `part` of its passage.

    Documents are cut into windows, partitioned by size; a window and a segment of an item meet if one of the MinHash
    bands (their number follows from the partition's size and `contained`) agrees. Each pair of document and item that
    meets is then decided exactly, over the whole document, from shingles of five words. The items are a stated query set:
    they go to the tasks in blocks of about BLOCK_WORDS words with their index, one pass over the documents for each
    block, in which documents are searched and decided where they are read; only found pairs are shuffled. Shingles that
    several items share are counted in Spark and left out of the index.
    Null keys and null or empty texts match nothing; items without words neither; repeated rows and ties give one row
    per pair; other columns are ignored.
    """
    questions = items.filter(F.col(item_key).isNotNull()).select(item_key, question, passage).distinct()
    standing = _standing(questions, question)

    def bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, p = [without_instruction(words(t or ""), standing) for t in b[question]], [words(t or "") for t in b[passage]]
            yield pd.DataFrame({item_key: b[item_key], "q": [" ".join(w) for w in q], "p": [" ".join(w) for w in p], "n": [len(x) + len(y) for x, y in zip(q, p)]})

    ikind, dkind = dict(items.dtypes)[item_key], dict(documents.dtypes)[doc_key]
    cleaned = cut(questions.mapInPandas(bare, f"`{item_key}` {ikind}, q string, p string, n bigint").filter("n > 0"))
    common = cut(_shared(cleaned, item_key))
    blocks = max(1, -(-(cleaned.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64(item_key), F.lit(blocks))
    docs = documents.filter(F.col(doc_key).isNotNull() & (F.length(doc_text) > 0)).select(doc_key, doc_text)
    schema = f"`{doc_key}` {dkind}, `{item_key}` {ikind}"
    found = documents.sparkSession.createDataFrame([], schema)
    for n in range(blocks):
        here = cleaned.filter(block == n)
        held = _item_shingles(here, item_key).select("s").distinct().join(common, "s", "left_semi")
        rows = [(r[item_key], r["q"], r["p"]) for r in here.orderBy(item_key, "q", "p").collect()]
        if not rows:
            continue
        index = Index(rows, {int(np.int64(r["s"]).view(np.uint64)) for r in held.collect()}, contained)
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys, texts, ready, size = b[doc_key].to_numpy(), b[doc_text], [], 0
                ds, is_, first = [], [], 0
                for at, t in enumerate(texts):
                    ready.append(words(t))
                    size += len(ready[-1])
                    if size > CHUNK_WORDS or at + 1 == len(texts):
                        pairs = shared.value.search(ready, whole, part)
                        ds += [keys[first + d] for d, _ in pairs]
                        is_ += [shared.value.ids[i] for _, i in pairs]
                        ready, size, first = [], 0, at + 1
                yield pd.DataFrame({doc_key: pd.Series(ds, dtype=b[doc_key].dtype), item_key: is_})

        found = found.unionByName(docs.mapInPandas(search, schema))
    return found.distinct()


def _standing(items: DataFrame, question: str, least: int = 5) -> list[list[str]]:
    """Openings shared by many questions, counted in Spark; few, as each must occur `least` times."""
    opening = F.trim(F.regexp_extract(question, r"(?s)^(.+?[.!:])(?=\s)", 1))
    rows = items.select(opening.alias("o")).filter("o <> ''").groupBy("o").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()
    return [words(r["o"]) for r in rows]


def _item_shingles(items: DataFrame, item_key: str) -> DataFrame:
    """(item_key, s): the shingles of question and passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [np.unique(np.concatenate([shingles(_word_hash(x.split()), SHINGLE) for x in (q, p)])).view(np.int64) for q, p in zip(b["q"], b["p"])]
            yield pd.DataFrame({item_key: b[item_key], "s": each})

    kind = dict(items.dtypes)[item_key]
    return items.mapInPandas(run, f"`{item_key}` {kind}, s array<bigint>").select(item_key, F.explode("s").alias("s"))


def _shared(items: DataFrame, item_key: str, least: int = 2) -> DataFrame:
    """(s): shingles that occur in at least `least` items, of question or passage."""
    return _item_shingles(items, item_key).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("s")
