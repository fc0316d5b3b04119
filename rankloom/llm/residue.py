"""Template residue, filler, error pages and script notices: character n-gram models and likelihood-ratio windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import residue_seeds as seeds
from .normal import plain

#: Slots of hashed n-grams by order, as short ones are few; and where each order begins in a row of all slots.
SLOTS = (1 << 12, 1 << 14, 1 << 16, 1 << 18, 1 << 18)
ORDER, FIRST = len(SLOTS), np.cumsum([0, *SLOTS])
CLASSES = ("template", "filler", "error", "script")
#: Least mean log ratio of a sentence, and of a window in a longer one, of filler, error or script notice.
UNIT_LEAST, SLIDE_LEAST = 0.45, 0.9
#: By what a ratio must be larger for a stretch to be left out of the data's prose, before which little prose is known.
SURE = 2.0
#: Characters that the data's prose counts for at most, so that the examples keep their weight against it in data of any
#: size: all texts are counted, and counts above that are scaled down.
MASS = 300_000
#: Characters of a window that slides over longer sentences, and slots of a block of counts on their way to the driver.
SLIDE, CHUNK = 48, 1 << 12
#: Characters of texts that are weighed at once.
CHARS = 1 << 16
#: Characters of a window that may hold part of a field, the least log ratio of its shape, and the least mean log ratio
#: of the words within so many characters around it.
WINDOW, MARK_LEAST, AROUND, AROUND_LEAST = 5, 3.0, 12, -1.0
#: Least characters of residue, by class, at which a text is excluded: more than one window of a field, or a few words. It is
#: a number, not a share, as a text that only contains residue among other text counts.
COVER = {"template": 6, "filler": 8, "error": 8, "script": 12}

UNIT = re.compile(r"(?<=[.!?:;>])\s+|\n+|\s{2,}|(?<=>)(?=\S)|(?=<(?!%)[a-z/])")


def reduced(text: str) -> str:
    """Lower case, digits as 0, every white space as a blank; as long as `plain` of the text."""
    text = re.sub(r"\d", "0", plain(text).lower())
    return text.replace("’", "'").replace("\t", " ")


_shapes: list[np.ndarray] = []


def skeleton(codes: np.ndarray) -> np.ndarray:
    """Code points with every letter as a and every digit as 0: what is left is how a field is written, not what it
    names. Signs beyond the basic plane stay."""
    if not _shapes:
        kinds = (ord("0") if c.isdecimal() else ord("a") if c.isalnum() else i for i, c in enumerate(map(chr, range(1 << 16))))
        _shapes.append(np.fromiter(kinds, dtype=np.uint32, count=1 << 16))
    return np.where(codes < 1 << 16, _shapes[0][np.minimum(codes, (1 << 16) - 1)], codes)


class Grams:
    """Counts of hashed n-grams of several models side by side, and the chances of a character after its forerunners,
    smoothed from order to order. A position's slots are looked up once for all models."""

    def __init__(self, names: tuple[str, ...]) -> None:
        self.names = names
        self.grams, self.contexts = ([np.zeros((n, len(names)), dtype=np.float32) for n in SLOTS] for _ in range(2))

    def add(self, name: str, codes: np.ndarray, weight: float) -> None:
        k = self.names.index(name)
        for n, (gram, context) in enumerate(hashes(codes)):
            self.grams[n][:, k] += weight * np.bincount(gram, minlength=SLOTS[n]).astype(np.float32)
            self.contexts[n][:, k] += weight * np.bincount(context, minlength=SLOTS[n]).astype(np.float32)

    def add_counts(self, name: str, grams: np.ndarray, contexts: np.ndarray) -> None:
        k = self.names.index(name)
        for n in range(ORDER):
            self.grams[n][:, k] += grams[FIRST[n] : FIRST[n + 1]].astype(np.float32)
            self.contexts[n][:, k] += contexts[FIRST[n] : FIRST[n + 1]].astype(np.float32)

    def ratios(self, slots: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log ratio of each other model's chance to the last model's, by model and position."""
        p = np.full((len(slots[0][0]), len(self.names)), 1 / 200.0, dtype=np.float32)
        for n, (gram, context) in enumerate(slots):
            strength = np.float32(1.0 + n)
            p *= strength
            p += self.grams[n].take(gram, axis=0)
            below = self.contexts[n].take(context, axis=0)
            below += strength
            p /= below
        p = np.ascontiguousarray(p.T)
        np.log(p, out=p)
        return p[:-1] - p[-1]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER line ends and the last before some too, and where each begins."""
    pad = "\n" * ORDER
    joined = np.frombuffer((pad + pad.join([*texts, ""])).encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return joined, ORDER + np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]).astype(np.int64)


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The reduced texts in lists of about CHARS characters."""
    held, size = [], 0
    for t in texts:
        held.append(reduced(t))
        size += len(held[-1])
        if size > CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashes(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the slots of each position's n-gram and of its context."""
    c = codes.astype(np.uint64)
    out = []
    context = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(ORDER):
            gram = (context * np.uint64(0x9E3779B1) + c + np.uint64(n + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            shift = np.uint64(64 - SLOTS[n].bit_length() + 1)
            out.append(((gram >> shift).view(np.int64), (context >> shift).view(np.int64)))
            if n + 1 < ORDER:  # the next order's context has one character more, further back
                shifted = np.zeros(len(c), dtype=np.uint64)
                shifted[n + 1 :] = c[: len(c) - n - 1]
                context = (context + (shifted + np.uint64(1)) * np.uint64(0x165667B19E3779F9 * (2 * n + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    return out


class Model:
    def __init__(self) -> None:
        self.words, self.shapes = Grams((*CLASSES, "prose")), Grams(("field", "plain"))
        fields = seeds.fields()
        lines: dict[str, list[str]] = {"template": [], "filler": [], "error": [], "script": [], "prose": []}
        for n, line in enumerate(seeds.TEMPLATE.strip().split("\n")):
            for k in range(60):
                at = iter(range(7 * n + 31 * k, 10**9, 13))
                lines["template"].append(re.sub("FIELD", lambda m: fields[next(at) % len(fields)], line))
        lines["template"] += fields
        lines["filler"] = seeds.FILLER.strip().split("\n") + pseudo_latin()
        for name in ("error", "script", "prose"):
            lines[name] = seeds.expand(getattr(seeds, name.upper()))
        for name, texts in lines.items():
            codes, _ = codes_of([reduced(t) for t in texts])
            self.words.add(name, codes, {"prose": 3.0, "template": 0.5}.get(name, 1.0))
            if name in ("template", "prose"):
                self.shapes.add("field" if name == "template" else "plain", skeleton(codes), 1.0)
            if name != "prose":  # what is said in the others' words is less telling
                self.words.add(name, codes_of([reduced(t).upper().lower().strip(".") for t in texts])[0], 0.5)

    def prose_counts(self, texts: list[str]) -> np.ndarray:
        """Counts of n-grams and contexts by (model, gram or context, slot of all orders in a row), which add up over any
        division of texts: all characters and the line end after each text count, but for stretches that the written
        examples alone surely find to be residue."""
        out = np.zeros((2, 2, FIRST[-1]), dtype=np.int64)
        kept: list = []
        for ready in portions(texts):
            codes, starts = codes_of(ready)
            both = hashes(codes), hashes(skeleton(codes))
            counted = np.zeros(len(codes) + 1, dtype=np.int8)
            counted[starts] += 1
            np.add.at(counted, starts + [len(t) + 1 for t in ready], -1)
            for s, found in zip(starts.tolist(), self._units(ready, codes, starts, both, SURE)):
                for a, b, _ in found:
                    counted[s + a] -= 1
                    counted[s + b] += 1
            left_out = np.flatnonzero(np.cumsum(counted[:-1]) <= 0)
            kept.append((both, left_out))
            if len(kept) == 8:
                self._tally(out, kept)
        self._tally(out, kept)
        return out

    @staticmethod
    def _tally(out: np.ndarray, kept: list) -> None:
        """Adds the counts of all positions less those that are left out, which are few."""
        for k in range(2):
            for n in range(ORDER if kept else 0):
                for side in range(2):
                    row = out[k, side, FIRST[n] : FIRST[n + 1]]
                    row += np.bincount(np.concatenate([both[k][n][side] for both, _ in kept]), minlength=SLOTS[n])
                    np.subtract.at(row, np.concatenate([both[k][n][side][some] for both, some in kept]), 1)
        kept.clear()

    def fit_prose(self, counts: np.ndarray) -> Model:
        """Adds the counts of the data's prose."""
        counts = counts * min(1.0, MASS / max(1, counts[0, 0, : SLOTS[0]].sum()))
        self.words.add_counts("prose", *counts[0])
        self.shapes.add_counts("plain", *counts[1])
        return self

    def units(self, ready: list[str], times: float = 1.0) -> list[list[tuple[int, int, str]]]:
        """(start, end, class) of the stretches of residue in each reduced text, in order and apart from each other.

        A sentence or line is one stretch if its mean log ratio is large; else windows that slide over it are joined where
        theirs is larger; else fields in it are looked for, each by its shape and the words around it. All sentences of
        the texts are weighed at once. `times`: by what the ratios of sentences and windows must be larger than usual.
        """
        if not ready:
            return []
        codes, starts = codes_of(ready)
        return self._units(ready, codes, starts, (hashes(codes), hashes(skeleton(codes))), times)

    def _units(self, ready: list[str], codes: np.ndarray, starts: np.ndarray, slots: tuple, times: float) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in ready]
        sums, shape = np.zeros((len(CLASSES), len(codes) + 1)), np.zeros(len(codes) + 1)
        np.cumsum(self.words.ratios(slots[0]), axis=1, dtype=np.float64, out=sums[:, 1:])
        np.cumsum(self.shapes.ratios(slots[1])[0], dtype=np.float64, out=shape[1:])
        owner, at, end = [], [], []
        for i, (t, s) in enumerate(zip(ready, starts.tolist())):
            edges = [0]
            for m in UNIT.finditer(t):
                edges += m.span()
            edges.append(len(t))
            at += [s + e for e in edges[::2]]
            end += [s + e for e in edges[1::2]]
            owner += [i] * (len(edges) // 2)
        at, end, owner = np.array(at), np.array(end), np.array(owner)
        long = end - at >= 3
        total = (sums[:, end] - sums[:, at])[1:]
        whole = long & (total.max(axis=0) >= times * np.maximum(UNIT_LEAST * (end - at), 6))
        found = [(int(u), int(at[u]), int(end[u]), CLASSES[1 + int(total[:, u].argmax())]) for u in np.flatnonzero(whole)]
        done = whole | ~long

        window = sums[1:, SLIDE:] - sums[1:, :-SLIDE]
        hits = np.flatnonzero(np.maximum.reduce(window) >= times * SLIDE_LEAST * SLIDE)
        unit = np.searchsorted(at, hits, side="right") - 1
        inside = (unit >= 0) & (hits + SLIDE <= end[unit]) & (end[unit] - at[unit] > SLIDE) & ~done[unit]
        hits, unit = hits[inside], unit[inside]
        runs = np.split(np.arange(len(hits)), np.flatnonzero((np.diff(hits) >= SLIDE) | (np.diff(unit) > 0)) + 1) if len(hits) else []
        for r in runs:
            best = window[:, hits[r]]
            found.append((int(unit[r[0]]), int(hits[r[0]]), int(hits[r[-1]]) + SLIDE, CLASSES[1 + int(best[:, best.max(axis=0).argmax()].argmax())]))
        done[unit] = True

        marks = np.flatnonzero(shape[WINDOW:] - shape[:-WINDOW] >= MARK_LEAST)
        unit = np.searchsorted(at, marks + 1, side="right") - 1
        inside = (unit >= 0) & (marks < np.maximum(at[unit], end[unit] - WINDOW + 1)) & ~done[unit]
        marks, unit = marks[inside], unit[inside]
        low, high = np.maximum(at[unit], marks - AROUND), np.minimum(end[unit], marks + WINDOW + AROUND)
        near = sums[0, high] - sums[0, low] >= AROUND_LEAST * (high - low)
        begin, stop, unit = np.maximum(at[unit], marks)[near], np.minimum(end[unit], marks + WINDOW)[near], unit[near]
        for k, u in enumerate(unit.tolist()):
            if k and found[-1][0] == u and found[-1][3] == "template" and begin[k] <= found[-1][2]:
                found[-1] = (u, found[-1][1], int(stop[k]), "template")
            else:
                found.append((u, int(begin[k]), int(stop[k]), "template"))
        for u, a, b, kind in sorted(found):
            s = int(starts[owner[u]])
            out[owner[u]].append((a - s, b - s, kind))
        return out


def pseudo_latin(lines: int = 60) -> list[str]:
    """Made-up words of the usual filler's syllables, in a fixed order."""
    syllables = "lo rem ip sum do lor sit am et con sec te tur ad ip is cing el it sed ei us mod tem por in ci di dunt ut la bo re mag na al iq ua en im mi nim ve ni am qu is nos trud ul la mco vol up tat fu gi at nul pa ri atur mol lit an cul pa fer ne cum do por vi na ti que pul mit ver".split(" ")
    out, state = [], 1
    for _ in range(lines):
        words = []
        for _ in range(14):
            word = ""
            for _ in range(2 + state % 3):
                state = (state * 1103515245 + 12345) % (1 << 31)
                word += syllables[(state >> 8) % len(syllables)]
            words.append(word)
        out.append(" ".join(words) + ".")
    return out


def excluded(found: list[tuple[int, int, str]]) -> bool:
    """Whether the stretches of one class cover enough of a text to exclude it."""
    cover = dict.fromkeys(CLASSES, 0)
    for a, b, kind in found:
        cover[kind] += b - a
    return any(cover[k] >= COVER[k] for k in CLASSES)


def fitted(replies: DataFrame, text: str) -> Model:
    """The model with prose from all distinct texts. Each task counts in fixed slots, blocks of slots are summed in Spark,
    and the sums, whose size does not depend on the data, reach the driver."""
    model = Model()
    shared = replies.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2, FIRST[-1]), dtype=np.int64)
        for b in batches:
            total += shared.value.prose_counts(list(b[text]))
        blocks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 64)):
            yield pd.DataFrame({"block": part, "counts": [blocks[i].tobytes() for i in part]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, dtype=np.int64)
        for x in g["counts"]:
            total += np.frombuffer(x, dtype=np.int64)
        return pd.DataFrame({"block": [g["block"].iloc[0]], "counts": [total.tobytes()]})

    schema = "block long, counts binary"
    rows = replies.filter(F.length(text) > 0).select(text).distinct().mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema)
    counts = np.zeros((4 * FIRST[-1] // CHUNK, CHUNK), dtype=np.int64)
    for r in rows.toLocalIterator():
        counts[r["block"]] = np.frombuffer(r["counts"], dtype=np.int64)
    shared.destroy()  # the examples' model is not needed on the executors again
    return model.fit_prose(counts.reshape(2, 2, -1))


def residue(replies: DataFrame, model: Model, text: str, carry: list[str]) -> DataFrame:
    """The columns `carry`, spans (start, end, kind; in the text with compatibility forms folded), coverage (share of the
    characters) and excluded, for every row. Null and empty texts have no spans."""
    shared = replies.sparkSession.sparkContext.broadcast(model)
    kinds = dict(replies.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b[text]]
            found = [f for ready in portions(texts) for f in shared.value.units(ready)]
            out = b[carry].copy()
            out["spans"] = [[{"start": a, "end": e, "kind": k} for a, e, k in f] for f in found]
            out["coverage"] = [sum(e - a for a, e, _ in f) / max(1, len(t)) for f, t in zip(found, texts)]
            out["excluded"] = [excluded(f) for f in found]
            yield out

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "spans array<struct<start:int,end:int,kind:string>>", "coverage double", "excluded boolean"])
    return replies.select(*carry, text).mapInPandas(run, schema)
