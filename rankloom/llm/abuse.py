"""Abusive, hateful or sexual content: a linear-chain conditional random field over tokens, trained here.

Emission scores are sums of features of the tokens at offsets -2 to 2 and of pairs of neighbours; each distinct token's
part is computed once, so scoring a text is a few array look-ups and a forward-backward pass over many texts at once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.base import unit_hash

from . import abuse_seeds as seeds
from .normal import ENTITY, LOOKALIKES, Aligned, plain

OFFSETS = (-2, -1, 0, 1, 2)
PAIRS = 1 << 16
#: The least score of a document at which it is reviewed, and at which it is excluded.
REVIEW, EXCLUDE = 0.5, 0.9
#: Bound on the rated comments that are used in training.
RATED = 6_000

TOKEN = re.compile(r"[^\W_](?:[\w@$*!|+'’\-]*[\w@$*|+])?|[@$*][\w@$*!|+]+|[.!?,;:\n…()]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·])[^\W_](?:\1[^\W_]){1,40}(?![^\W_])")
LEET = str.maketrans("013457@$!|+", "oieastasilt")
RUNS = re.compile(r"([^\W\d_])\1{2,}")
DOUBLES = re.compile(r"(.)\1+")


def prepared(text: str) -> str:
    """The text as it is tokenised; spelled-out words are joined by dropping the signs between their letters."""
    if not text.isascii():
        text = plain(text)
        if not text.isascii() and any("Ͱ" <= c <= "ӿ" for c in text):
            text = text.translate(LOOKALIKES)
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return SPACED.sub(lambda m: _split_known(m[0].replace(m[1], "")), text.lower())


def aligned(text: str) -> Aligned:
    """`prepared` text with the places of its characters in the stored text."""
    a = Aligned(text)
    if not text.isascii():
        a = a.plain()
        if not a.text.isascii() and any("Ͱ" <= c <= "ӿ" for c in a.text):
            a = a.translate(LOOKALIKES)
    if "&" in a.text:
        a = a.sub(ENTITY, lambda m: html.unescape(m[0]))

    def joined(m: re.Match) -> list[tuple[str, int, int]]:
        places = [i for i in range(m.start(), m.end()) if m.string[i] != m[1]]
        parts, k = [], 0
        for c in _split_known(m[0].replace(m[1], "")):
            at = places[min(k, len(places) - 1)]
            parts.append((c, at, at + 1))
            k += c != " "
        return parts

    return a.lower().sub(SPACED, joined)


_lexicon: dict[str, str] = {}
_by_start: dict[str, list[str]] = {}


def lexicon() -> dict[str, str]:
    """word -> class; the classes of a word that has several are joined by a plus sign."""
    if not _lexicon:
        for name, entries in seeds.CLASSES.items():
            for w in entries.split():
                _lexicon[w] = f"{_lexicon[w]}+{name}" if w in _lexicon else name
        for w in _lexicon:
            _by_start.setdefault(w[0], []).append(w)
    return _lexicon


def _split_known(t: str) -> str:
    """Letters joined into words of the classes (and "a") with blanks between, if they are nothing else."""
    known = lexicon()
    if t in known:
        return t
    ways: list[list[str] | None] = [[]] + [None] * len(t)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - 14), end):
            w = t[start:end]
            if ways[start] is not None and (w == "a" or len(w) > 2 and w in known) and (ways[end] is None or len(ways[start]) + 1 < len(ways[end])):
                ways[end] = [*ways[start], w]
    return " ".join(ways[-1] or [t])


def bare_letters(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def normal_token(t: str) -> str:
    """Undoes stretched letters, letters written as digits or signs, and starred-out letters of known words."""
    known = lexicon()
    if t.isdigit():
        return "0"
    if t in known:
        return t
    if not t.isalpha():
        x = t.strip("'’-!")
        if "*" in x and sum(c.isalpha() for c in x) >= 2:
            # a star stands for one letter, or for some
            for each in ("[^ ]", "[^ ]{0,3}"):
                shape = re.compile("".join(each if c == "*" else re.escape(c.translate(LEET)) for c in x))
                for w in _by_start.get(x[0], []):
                    if len(w) >= 4 and shape.fullmatch(w):
                        return w
        if any(c.isalpha() for c in x):
            x = re.sub(r"['’\-]", "", x)
            for y in (x, x.translate(LEET), x.replace("1", "l").translate(LEET)):
                if y in known:
                    return y
                y = RUNS.sub(r"\1", y)
                if y in known:
                    return y
            if any(c in "@$" for c in x) or 0 < sum(c.isdigit() for c in x) * 2 <= len(x):
                t = x.translate(LEET)
    if RUNS.search(t):
        for y in (RUNS.sub(r"\1", t), RUNS.sub(r"\1\1", t)):
            if y in known:
                return y
        t = RUNS.sub(r"\1", t)
    if len(t) > 4 and t not in known:
        t = t if t.isascii() else bare_letters(t)
        y = DOUBLES.sub(r"\1", t)
        if len(y) > 4 and y in known:
            return y
    return t


def features(t: str) -> list[str]:
    """Of a token, without its offset."""
    n = normal_token(t)
    out = ["any", "w:" + n]
    kind = lexicon().get(n)
    if kind:
        out += ["c:" + k for k in kind.split("+")]
        if n != t and set(kind.split("+")) & seeds.HARSH:
            out.append("disguised")
    elif n.isalpha() and len(n) > 4:
        out += ["s:" + n[-3:], "p:" + n[:4]]
    return out


def code_of(t: str) -> int:
    """Stands for the token in pairs: its class, else itself. Never 0, which is the gap between texts."""
    n = normal_token(t)
    return (xxhash.xxh3_64_intdigest(lexicon().get(n) or n) >> 34) | 1


class Ids(dict):
    """token -> number; makes the rows of a token when it is first met."""

    def __init__(self, model: Model) -> None:
        super().__init__({"": 0})
        self.model = model

    def __missing__(self, t: str) -> int:
        m, i = self.model, len(self)
        self[t] = i
        if i >= len(m.codes):
            m.rows, m.codes = np.concatenate([m.rows, np.zeros_like(m.rows)]), np.concatenate([m.codes, np.zeros_like(m.codes)])
        at = [m.index[f] for f in features(t) if f in m.index]
        m.rows[i] = m.weights[:, at].sum(axis=1) if at else 0
        m.codes[i] = code_of(t)
        return i


class Batch:
    """Texts as one array of token numbers with gaps between them, and their order by length for the recursions."""

    def __init__(self, texts: list[list[str]], number) -> None:
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat: list[int] = [0, 0]
        for t in texts:
            flat += map(number, t)
            flat += (0, 0)
        self.ids = np.array(flat, dtype=np.int64)
        self.starts = 2 + np.concatenate([[0], np.cumsum(self.lengths + 2)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        self.first = self.starts[order]
        self.sorted_lengths = self.lengths[order]
        steps = np.arange(int(self.lengths.max(initial=0)))
        #: number of texts that have a token at each step, in the order by length
        self.alive = np.searchsorted(-self.sorted_lengths, -(steps + 1), side="right")

    def sums(self, rows: np.ndarray, codes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        ids = self.ids
        s = rows[ids, 2].astype(np.float64)
        for o, k in enumerate(OFFSETS):  # column o holds what a token adds to the position that sees it at offset k
            if k < 0:
                s[-k:] += rows[ids[:k], o]
            elif k > 0:
                s[:-k] += rows[ids[k:], o]
        code = codes[ids]
        slot, real = self.pair_slots(code)
        s[1:] += pairs[0, slot] * real
        s[:-1] += pairs[1, slot] * real
        return s

    def pair_slots(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (code[:-1] * 31 + code[1:] * 17) % PAIRS, (code[:-1] != 0) & (code[1:] != 0)

    def odds(self, s: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the forward and the backward messages at each position. chain: enter, leave, stay."""
        e01, e10, e11 = np.exp(chain)
        a, b = np.zeros(len(s)), np.zeros(len(s))
        if len(self.alive):
            prev = s[self.first[: self.alive[0]]] + chain[0]
            a[self.first[: self.alive[0]]] = prev
            for t in range(1, len(self.alive)):
                at = self.first[: self.alive[t]] + t
                u = np.exp(np.clip(prev[: len(at)], -40, 40))
                prev = s[at] + np.log((e01 + e11 * u) / (1 + e10 * u))
                a[at] = prev
            nxt = np.zeros(0)
            for t in range(len(self.alive) - 2, -1, -1):
                at = self.first[: self.alive[t + 1]] + t
                # texts that end at t + 1 have no later message
                later = np.zeros(len(at))
                later[: len(nxt)] = nxt
                u = np.exp(np.clip(s[at + 1] + later, -40, 40))
                nxt = np.log((e10 + e11 * u) / (1 + e01 * u))
                b[at] = nxt
        return a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray, chain: np.ndarray) -> None:
        self.index, self.weights, self.pairs, self.chain = index, weights, pairs, chain
        self.reset()

    def reset(self) -> None:
        self.rows, self.codes = np.zeros((4096, len(OFFSETS))), np.zeros(4096, dtype=np.int64)
        self.ids = Ids(self)

    def __reduce__(self):
        return Model, (self.index, self.weights, self.pairs, self.chain)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Chance of the toxic tag for each token of each text."""
        if len(self.ids) > 300_000:
            self.reset()
        batch = Batch(texts, self.ids.__getitem__)
        a, b = batch.odds(batch.sums(self.rows, self.codes, self.pairs), self.chain)
        p = sigmoid(a + b)
        return [p[i : i + n] for i, n in zip(batch.starts, batch.lengths)]


def fit(texts: list[list[str]], tags: list[np.ndarray], rounds: int = 60, ridge: float = 0.02, start: Model | None = None) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam steps over all sentences at once."""
    numbers: dict[str, int] = {"": 0}
    for t in texts:
        for x in t:
            numbers.setdefault(x, len(numbers))
    batch = Batch(texts, numbers.__getitem__)
    y = np.zeros(len(batch.ids))
    real = np.zeros(len(batch.ids), dtype=bool)
    for i, n, tag in zip(batch.starts, batch.lengths, tags):
        y[i : i + n] = tag
        real[i : i + n] = True
    index: dict[str, int] = dict(start.index) if start else {}
    token, feature = [], []
    for x, i in numbers.items():
        if x:
            for f in features(x):
                token.append(i)
                feature.append(index.setdefault(f, len(index)))
    token, feature = np.array(token), np.array(feature)
    codes = np.array([0] + [code_of(x) for x in numbers if x], dtype=np.int64)
    weights, pairs, chain = np.zeros((len(OFFSETS), len(index))), np.zeros((2, PAIRS)), np.array([-1.5, -1.5, 0.0])
    if start:
        weights[:, : start.weights.shape[1]], pairs, chain = start.weights, start.pairs.copy(), start.chain.copy()
    slot, inside = batch.pair_slots(codes[batch.ids])
    used = np.unique(slot[inside])
    params = [weights, pairs, chain]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    follows = real[:-1] & real[1:]
    shift = {0: 2, 1: 1, 2: 0, 3: -1, 4: -2}
    for step in range(1, rounds + 1):
        rows = np.zeros((len(numbers), len(OFFSETS)))
        for o in range(len(OFFSETS)):
            rows[:, o] = np.bincount(token, weights=weights[o, feature], minlength=len(numbers))
        s = batch.sums(rows, codes, pairs)
        a, b = batch.odds(s, chain)
        p = np.where(real, sigmoid(a + b), 0)
        g = y - p
        grad_w = np.zeros_like(weights)
        for o, k in shift.items():  # the token at position i acts on position i + k
            at = np.zeros(len(g))
            at[max(0, -k) : len(g) - max(0, k)] = g[max(0, k) : len(g) + min(0, k)]
            per_token = np.bincount(batch.ids, weights=at, minlength=len(numbers))
            grad_w[o] = np.bincount(feature, weights=per_token[token], minlength=len(index))
        grad_p = np.zeros_like(pairs)
        grad_p[0] = np.bincount(slot, weights=g[1:] * inside, minlength=PAIRS)
        grad_p[1] = np.bincount(slot, weights=g[:-1] * inside, minlength=PAIRS)
        # both tags of neighbours: proportional to forward(i) * step(i, j) * emission(j) * backward(j)
        x, z = a[:-1], s[1:] + b[1:]
        w01, w10, w11 = np.exp(np.clip(chain[0] + z, -60, 60)), np.exp(np.clip(chain[1] + x, -60, 60)), np.exp(np.clip(chain[2] + x + z, -60, 60))
        total = 1 + w01 + w10 + w11
        y0, y1 = y[:-1], y[1:]
        # staying has weight 0 in both tags: how likely a tag is without any sign is for the emissions to say
        grad_c = np.array([(((1 - y0) * y1 - w01 / total) * follows).sum(), ((y0 * (1 - y1) - w10 / total) * follows).sum(), 0.0])
        grad_c[0] += (y - p)[batch.starts[batch.lengths > 0]].sum()
        for k, (param, grad) in enumerate(zip(params, (grad_w, grad_p, grad_c))):
            grad = grad - ridge * param * 10
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            param += 0.12 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-3)
    keep = np.zeros_like(pairs)
    keep[:, used] = pairs[:, used]
    return Model(index, weights, keep, chain)


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence; the sign or line end that ends a sentence belongs to it."""
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(prepared(text)):
        out[-1].append(t)
        if t in ".!?…\n":
            out.append([])
    return [s for s in out if any(x[0].isalnum() for x in s)]


def _seed_examples() -> tuple[list[list[str]], list[np.ndarray]]:
    """Labelled sentences alone and between clean ones, with and without the sign at the end."""
    toxic, clean = ([TOKEN.findall(prepared(s)) for s in seeds.expand(x)] for x in (seeds.TOXIC, seeds.CLEAN))
    texts, tags = [], []
    for n, s in enumerate(toxic):
        before, after = clean[n % len(clean)] + ["."], clean[(3 * n + 1) % len(clean)]
        more = clean[(7 * n + 3) % len(clean)] + ["."] + before
        texts += [s, before + s + ["."] + after, s + ["!"], more + s + ["."]]
        tags += [np.ones(len(s)), np.r_[np.zeros(len(before)), np.ones(len(s) + 1), np.zeros(len(after))], np.ones(len(s) + 1), np.r_[np.zeros(len(more)), np.ones(len(s) + 1)]]
    for n, s in enumerate(clean):
        joined = s + ["."] + clean[(5 * n + 2) % len(clean)]
        texts += [s, joined]
        tags += [np.zeros(len(s)), np.zeros(len(joined))]
    for n in range(0, len(clean), 2):  # longer ones, as most text is clean
        joined = sum((clean[(n + 7 * k) % len(clean)] + ["."] for k in range(8)), [])
        texts.append(joined)
        tags.append(np.zeros(len(joined)))
    return texts, tags


def train(rated: list[tuple[str, bool | None]]) -> Model:
    """From the seeds and rated texts. A rating holds for a text as a whole, so the tokens of an abusive text get their
    tags from its sentences: those not made of phrases of clean texts and that the model of the round before finds likeliest."""
    texts, tags = _seed_examples()
    model = fit(texts, tags)
    clean, sure = [sentences(t) for t, bad in rated if not bad], [bad is not None for _, bad in rated if not bad]
    bad = [sentences(t) for t, is_bad in rated if is_bad]
    in_clean, in_bad = (Counter(g for t in part for g in {g for s in t for g in _trigrams(s)}) for part in (clean, bad))
    usual = 0.005 * len(clean)
    # a phrase of clean texts is about as common in both; one that bad texts have more often is odd
    odd_share = lambda s: np.mean([in_bad[g] > 2 * in_clean[g] or in_clean[g] < 2 for g in _trigrams(s)])
    for _ in range(2):
        more, more_tags = [], []
        chances = iter(model.marginals([s for t in clean for s in t]))
        for t, rated_clean in zip(clean, sure):
            p = [float(next(chances).mean()) for _ in t]
            if any(x >= (0.5 if rated_clean else 0.05) and np.mean([in_bad[g] > 2 * in_clean[g] or not rated_clean and in_clean[g] < usual for g in _trigrams(s)]) >= 0.5 for s, x in zip(t, p)):
                continue  # a wrong rating, or an unrated text that may well be abusive
            if t:
                more.append(sum(t, []))
                more_tags.append(np.zeros(len(more[-1])))
        chances = iter(model.marginals([s for t in bad for s in t]))
        for t in bad:
            p = [float(next(chances).mean()) for _ in t]
            odd = [odd_share(s) >= 0.6 for s in t]
            p = [x if o else min(x, 0.1) for x, o in zip(p, odd)]
            odd = [o and _has_class(s) for o, s in zip(odd, t)]
            if not t or max(p) < 0.15 and sum(odd) != 1:
                continue  # a wrong rating, or nothing that can be told apart
            best = max(p) if max(p) >= 0.15 else p[odd.index(True)]
            mark = [x >= 0.5 or x == best for x in p]
            more.append(sum(t, []))
            more_tags.append(np.concatenate([np.full(len(s), float(k)) for s, k in zip(t, mark)]))
        model = fit(texts + more, tags + more_tags, rounds=60, start=model)
    return model


def _has_class(sentence: list[str]) -> bool:
    known = lexicon()
    return any(k != "me" for x in sentence for k in known.get(normal_token(x), "me").split("+"))


def _trigrams(sentence: list[str]) -> list[tuple[str, ...]]:
    w = ["0" if x.isdigit() else x for x in sentence if x[0].isalnum()]
    return [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def rated_sample(comments: DataFrame, ratings: DataFrame, most: int = RATED) -> list[tuple[str, bool | None]]:
    """Texts with the majority of their ratings, at most `most` comments (a third of them abusive), chosen by hash.

    Where fewer are rated, unrated comments fill up the rest with None as their rating; most texts are clean, and
    training leaves out those that may not be. Null ratings and ties are left out. The bound holds whatever the tables'
    size.
    """
    votes = (
        ratings.filter(F.col("is_abusive").isin(0, 1) & F.col("comment_id").isNotNull()).groupBy("comment_id")
        .agg(F.avg("is_abusive").alias("v")).filter("v <> 0.5").select("comment_id", (F.col("v") > 0.5).alias("bad"))
    )
    order = unit_hash("comment_id", F.lit("rated"))
    chosen = votes.filter("bad").orderBy(order, "comment_id").limit(most // 3).unionByName(votes.filter("not bad").orderBy(order, "comment_id").limit(most - most // 3))
    held = comments.filter(F.length("comment_text") > 0).select("comment_id", "comment_text")
    texts = held.join(F.broadcast(chosen), "comment_id")
    rows = texts.groupBy("comment_id").agg(F.max_by("comment_text", F.length("comment_text")).alias("t"), F.first("bad").alias("bad")).orderBy("comment_id").collect()
    out = [(r["t"], r["bad"]) for r in rows]
    if len(out) < most:
        unrated = held.join(F.broadcast(chosen), "comment_id", "left_anti").orderBy(order, "comment_id", "comment_text").limit(most - len(out)).select("comment_text").collect()
        out += [(r[0], None) for r in unrated]
    return out


def score_of(p: np.ndarray) -> float:
    """Of a text, from its tokens' marginals: the largest mean over three neighbours (over all, if there are fewer)."""
    n = len(p)
    if n <= 3:
        return float(p.mean()) if n else 0.0
    return float((p[:-2] + p[1:-1] + p[2:]).max() / 3)


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the offending stretches in the stored text, from the marginals of its tokens."""
    ready, out = aligned(text), []
    running = False
    for m, x in zip(TOKEN.finditer(ready.text), p):
        if x >= least:
            start, end = ready.stored(*m.span())
            if running:
                out[-1][1] = end
            else:
                out.append([start, end])
        running = x >= least
    return [(a, b) for a, b in out]


def scored(comments: DataFrame, model: Model, text: str, carry: list[str], offsets: bool = False) -> DataFrame:
    """The columns `carry`, score, and with `offsets` the offending stretches of the stored text, for every row.

    Null and empty texts have score 0 and no stretches.
    """
    shared = comments.sparkSession.sparkContext.broadcast(model)
    kinds = dict(comments.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = shared.value
        for b in batches:
            ready = [prepared(t) if t else "" for t in b[text]]
            p = tagger.marginals([TOKEN.findall(t) for t in ready])
            out = b[carry].assign(score=[score_of(x) for x in p])
            if offsets:
                out["spans"] = [[{"start": a, "end": e} for a, e in spans_of(t, x)] if s >= REVIEW else [] for t, x, s in zip(b[text], p, out["score"])]
            yield out

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "score double", *["spans array<struct<start:int,end:int>>"] * offsets])
    return comments.select(*carry, text).mapInPandas(run, schema)
