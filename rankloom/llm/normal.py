"""Text folding shared by the operators: character forms, look-alikes, spelling tricks, words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абвгеёзиіјкмнорстухԁѕԛԝһъьАВЕЅЗІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειοντυρκ",
    "aбbreeзиijkmhopctyxdsqwhъьABESЗIJKMHOPCTYXABEZHIKMNOPTYXaeiovtupk",
)
#: Signs without width, which split words for a machine but not for a reader.
UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
TAGS = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
ENTITY = re.compile(r"&(#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});")
WORDS = re.compile(r"[^\W_]+")
BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")


def plain(text: str) -> str:
    """Compatibility forms folded, unseen signs dropped; case and layout stay."""
    if text.isascii():
        return text
    return UNSEEN.sub("", unicodedata.normalize("NFKC", text))


def folded(text: str) -> str:
    """As `plain`, and lower case, no accents, look-alikes as Latin letters, no tags or entities, broken words joined."""
    text = plain(text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = BROKEN.sub("", text)
    if "&" in text:
        import html

        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = TAGS.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


class Aligned:
    """A text that is being folded, and of each of its characters the stretch first:last of the stored text it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def plain(self) -> Aligned:
        """As `plain`, letter by letter with the signs that combine with it."""
        if self.text.isascii():
            return self
        return self._rebuilt((unicodedata.normalize("NFKC", m[0]), m.start(), m.end()) for m in LETTER.finditer(self.text)).sub(UNSEEN, lambda m: "")

    def translate(self, table: dict) -> Aligned:
        return self._rebuilt((c.translate(table), i, i + 1) for i, c in enumerate(self.text))

    def lower(self) -> Aligned:
        return self._rebuilt((c.lower(), i, i + 1) for i, c in enumerate(self.text))

    def sub(self, pattern: re.Pattern, make) -> Aligned:
        """As pattern.sub. make(match): a string, all of which stands for the match, or parts (string, start, end)."""
        parts, at = [], 0
        for m in pattern.finditer(self.text):
            parts += [(c, at + i, at + i + 1) for i, c in enumerate(self.text[at : m.start()])]
            made = make(m)
            parts += [(made, m.start(), m.end())] if isinstance(made, str) else made
            at = m.end()
        return self if not at else self._rebuilt([*parts, *((c, at + i, at + i + 1) for i, c in enumerate(self.text[at:]))])

    def _rebuilt(self, parts) -> Aligned:
        out, first, last = [], [], []
        for made, a, b in parts:
            out.append(made)
            first += [self.first[a]] * len(made)
            last += [self.last[b - 1]] * len(made)
        new = Aligned("")
        new.text, new.first, new.last = "".join(out), first, last
        return new

    def stored(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the stored text that start:end of this text stands for."""
        return self.first[start], max(self.last[start:end])


#: A letter with the signs that combine with it.
LETTER = re.compile("(?s).[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]*")


def words(text: str) -> list[str]:
    return WORDS.findall(folded(text))


class WordHashes:
    """64-bit hashes of words, remembered for each Python worker up to a size."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        except KeyError:
            import xxhash

            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))
            return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of k words, in order; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = mixed(out * MIX + hashes[i : i + n] + np.uint64(i + 1))
    return out
