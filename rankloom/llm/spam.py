"""Keyword-stuffed and link-list pages: block-wise compression ratios against a baseline, confirmed by missing sentences."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.base import cut

from .normal import plain

#: Characters of a block; blocks end at line ends or blanks.
BLOCK = 600

#: Usual ratio of prose by length class and its usual spread, which stand for so many blocks where a class has few.
USUAL, USUAL_SPREAD, PRIOR = (0.80, 0.68, 0.62, 0.58, 0.565, 0.555), 0.02, 20

URL = re.compile(r"\[[^\]\n]{0,200}\]\((?:https?://|www\.)[^)\s]*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|info|biz|shop|example|test|invalid)(?:/\S*)?", re.I | re.S)
DOMAIN = re.compile(r"\.(?:com|net|org|info|biz|shop|example|test|invalid)")
HASHTAG = re.compile(r"#\w+")
GLUED = re.compile(r"\w+_\w+|[^\W\u0370-\uffff]{15,}")
APART = re.compile(r"(?:(?<=\s)|^)(?:\w (?=\w )){4,}\w(?=\s|$)", re.M)
DIGITS = re.compile(r"\d")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ENDS = re.compile(r"[.!?…]+[\"'”’)*_]*(?=\s|$)|[。．！？｡।॥؟۔։።]+")

#: Scripts other than Latin by their code points, with the usual ratio as a part of that of Latin letters, as
#: theirs take more bytes.
SCRIPTS = {"greek": (r"\u0370-\u03ff", 0.8), "cyrillic": (r"\u0400-\u052f", 0.8), "hebrew": (r"\u0590-\u05ff", 0.8), "arabic": (r"\u0600-\u06ff\u0750-\u077f", 0.8), "indic": (r"\u0900-\u0dff", 0.65), "thai": (r"\u0e00-\u0eff", 0.65), "han": (r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af", 0.7)}
_FOREIGN = {k: re.compile(f"[{v[0]}]") for k, v in SCRIPTS.items()}

#: Frequent words of sentences, which lists of keywords lack.
STOPS = {
    "en": "the a an and or but is are was were be been am i you he she it we they my your his her our their me him them this that these those of to in on at for with from by as not no do does did has have had will would can could should if when then than because so what who how there here all too very just before after into out up about until while which one some any",
    "de": "der die das und oder aber ist sind war ich du er sie es wir ihr mein meine dein sein mich mir dir dich nicht kein keine ein eine einen einem einer zu in im am auf für mit von bei als wie wenn dann dass weil so was wer hier alle auch nur noch nach vor wieder immer hat habe",
    "fr": "le la les un une des et ou mais est sont était je tu il elle nous vous ils mon ma mes ton ta son sa ses me moi te se ne pas de du au aux à en dans sur pour avec par ce cette ces que qui quand si comme plus très tout y a ai d l j n c s qu",
    "es": "el la los las un una unos y o pero es son era yo tú él ella nosotros mi mis tu su sus me te se no de del al a en con por para como que quien cuando si lo le más muy todo ya hay ha he esta este esto",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOPS.items()}
_LANGUAGES = {w: tuple(k for k, v in _STOPS.items() if w in v) for v in _STOPS.values() for w in v}
_ANY = frozenset().union(*_STOPS.values())

MEASURES = ["lang", "bucket", "chars", "ratio", "stops", "repeat", "prose"]


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """Stretches of the whole text: paragraphs, short ones joined up to a third of `size`, long ones cut at line ends or
    blanks into pieces of at most `size` characters."""
    out, held = [], ""
    for part in re.split(r"(?<=\n)\s*\n", text):
        held += part + "\n"
        if len(held) < size // 3:
            continue
        while len(held) > size * 4 // 3:
            end = held.rfind("\n", size // 2, size)
            end = end if end > 0 else held.rfind("</a>", size // 2, size - 4) + 3
            end = end if end > 2 else held.rfind(" ", size // 2, size)
            end = end + 1 if end > 0 else size
            out.append(held[:end])
            held = held[end:]
        out.append(held)
        held = ""
    if held.strip():
        out.append(held)
    return [b for b in out if b.strip()]


def reduced(text: str) -> str:
    """Links, tags, glued words and numbers as one sign each, so that lists of them compress to next to nothing."""
    parts = text.split()
    if sum(len(p) == 1 for p in parts) > 4:
        text = APART.sub(lambda m: m[0].replace(" ", ""), text)
        parts = text.split()
    low = text.lower()
    if "://" in low or "www." in low or "](" in low or "<a" in low or DOMAIN.search(low):
        text = URL.sub(" ¤ ", text)
    if "#" in text:
        text = HASHTAG.sub("¤", text)
    if "_" in text or max(map(len, parts), default=0) > 14:
        text = GLUED.sub("¤", text)
    return DIGITS.sub("0", text).lower()


def script(text: str) -> str | None:
    """The script, other than Latin, of more than half of the letters; None if there is none."""
    if text.isascii() or 2 * sum(c > "\u036f" for c in text) < sum(map(str.isalpha, text)):
        return None
    counts = {k: len(x.findall(text)) for k, x in _FOREIGN.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if 2 * counts[best] > sum(map(str.isalpha, text)) else None


def language(words: list[str]) -> str:
    """By frequent words; "xx" where there are hardly any."""
    counts = dict.fromkeys(_STOPS, 0)
    for w in words:
        for k in _LANGUAGES.get(w, ()):
            counts[k] += 1
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] * 20 >= len(words) and counts[best] else "xx"


def measures(block: str) -> tuple:
    """lang, length bucket, characters, compressed size of the reduced block by its length, share of frequent words
    among words and signs,    share of the words that repeat one three-word phrase, and sentence ends by words."""
    folded = plain(block)
    small = reduced(folded)
    words = WORD.findall(small)
    signs = small.count("¤")
    n = len(words) + signs
    ratio = len(zlib.compress(small.encode("utf-8", "replace"), 6)) / max(1, len(folded.encode("utf-8", "replace")))
    stops = sum(w in _ANY for w in words) / n if n else 0.0
    pairs = Counter(zip(words, words[1:], words[2:])) if n > 5 else Counter()
    repeat = 3 * sum(c for p, c in pairs.items() if c >= 3 and not all(w in _ANY for w in p)) / n if n else 0.0
    prose = len(ENDS.findall(small)) / n if n else 0.0
    bucket = min(5, len(folded) // 150)
    return script(small) or language(words), bucket, len(block), ratio, stops, min(1.0, repeat), prose


def is_spam(z, stops, repeat, prose):
    """Whether a block's redundancy (z: deviations under its baseline) is extreme and its sentences are missing or empty.

    Takes numbers or columns. Redundancy is needed in every case; few sentence ends and frequent words only confirm it.
    Sentences that only repeat a phrase are far more redundant than refrains among others.
    """
    listed = (z > 3.0) & (prose < 0.03) & (stops < 0.15)
    return listed | ((z > 8.0) & (repeat > 0.45) & (stops < 0.38))


def spam_pages(documents: DataFrame, key: str, text: str, least: float = 0.4) -> DataFrame:
    """(key, share): documents of which at least the share `least` of all characters lies in spam blocks
    (less than half, as a block in which an honest opening meets the list counts as honest).

    The baseline of a block's compression ratio is the median, and its spread the way to the 90th percentile, over all
    blocks of all documents of its language (or script, where that is not Latin) and length class (across languages of Latin
    letters where none is recognised), pulled to usual values where a class has few blocks: a table of fixed size, which
    is broadcast. Rows of one key count together; null keys, null and empty texts give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *measures(x)) for k, t in zip(b[key], b[text]) for x in blocks(t)]
            yield pd.DataFrame(rows, columns=[key, *MEASURES])

    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, lang string, bucket int, chars bigint, ratio double, stops double, repeat double, prose double"
    parts = cut(documents.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, text).mapInPandas(run, schema))
    foreign = F.col("lang").isin(list(SCRIPTS))
    classes = parts.filter("lang <> 'xx'").withColumn("lang", F.explode(F.when(foreign, F.array("lang")).otherwise(F.array("lang", F.lit("xx")))))
    usual_part = F.lit(1.0)
    for name, (_, part) in SCRIPTS.items():
        usual_part = F.when(F.col("lang") == name, part).otherwise(usual_part)
    middle, high, n = F.percentile_approx("ratio", 0.5, 1000), F.percentile_approx("ratio", 0.9, 1000), F.count(F.lit(1))
    usual = F.element_at(F.array(*[F.lit(x) for x in USUAL]), F.col("bucket") + 1) * usual_part
    baseline = classes.groupBy("lang", "bucket").agg(n.alias("n"), middle.alias("m"), F.greatest((high - middle) / 1.2816, F.lit(0.01)).alias("s"))
    pulled = lambda c, to: (F.col("n") * F.col(c) + PRIOR * to) / (F.col("n") + PRIOR)
    baseline = baseline.select("lang", "bucket", pulled("m", usual).alias("median"), pulled("s", F.lit(USUAL_SPREAD)).alias("spread"))
    z = (F.col("median") - F.col("ratio")) / F.col("spread")
    judged = parts.join(F.broadcast(baseline), ["lang", "bucket"], "left").withColumn("spam", is_spam(F.coalesce(z, F.lit(0.0)), F.col("stops"), F.col("repeat"), F.col("prose")))
    share = F.sum(F.when(F.col("spam"), F.col("chars")).otherwise(0)) / F.sum("chars")
    return judged.groupBy(key).agg(share.alias("share")).filter(F.col("share") >= least)
