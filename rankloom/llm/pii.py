"""Personal information in free text: patterns propose spans, checksums confirm them, words around them adjust the score."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_words as V
from .normal import ENTITY, UNSEEN, Aligned

TYPES = ("email", "phone", "id_number", "address", "person_name")
#: The least score of a span.
LEAST = 0.5


DASHES = dict.fromkeys(range(0x2010, 0x2016), "-") | {0x2212: "-"}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def readable(text: str) -> str:
    """The text in which spans are found: compatibility forms folded, unseen signs dropped, entities resolved."""
    if not text.isascii():
        import unicodedata

        text = UNSEEN.sub("", unicodedata.normalize("NFKC", text)).translate(DASHES)
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return text


def aligned(text: str) -> Aligned:
    """`readable` text with the places of its characters in the stored text."""
    a = Aligned(text)
    if not text.isascii():
        a = a.plain().translate(DASHES)
    return a.sub(ENTITY, lambda m: html.unescape(m[0])) if "&" in a.text else a


# checksums


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Of an international account number: rearranged and read as a number, it leaves 1."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11(digits: str) -> bool:
    """Of ten digits weighted from 10 down; the last is the check digit."""
    check = 11 - sum(int(c) * (10 - i) for i, c in enumerate(digits[:9])) % 11
    return check % 11 == int(digits[9]) and check != 10


def mod23(text: str) -> bool:
    """Of eight digits and a letter; X, Y and Z stand for a leading digit."""
    number = text[:-1].translate(str.maketrans("XYZ", "012"))
    return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == text[-1]


def iso7064(digits: str) -> bool:
    """Modulus 11, 10 over eleven digits."""
    product = 10
    for c in digits[:-1]:
        s = (int(c) + product) % 10 or 10
        product = s * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


# e-mail

_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
MAIL = re.compile(r"[\w][\w.+\-']*\s?(?:@|\[@\]|\(@\))\s?(" + _LABEL + r"(?:\.[^\W\d_][\w\-]*)+)", re.U)
_DOT = r"(?:\[\s*(?:dot|punkt|point|punto)\s*\]|\(\s*(?:dot|punkt|point|punto)\s*\)|\{\s*dot\s*\}|\s(?:dot|punkt|point|punto)\s)"
_NAME_AT = r"(?<![\w.])\w[\w.+\-]*\s*"
MAIL_WORDS = [
    re.compile(_NAME_AT + r"(?:\[\s*(?:at|ät|arroba)\s*\]|\(\s*(?:at|ät|arroba)\s*\)|\{\s*at\s*\}|<\s*at\s*>|\sarroba\s|@)\s*[^\W_][\w\-]*(?:\s*(?:" + _DOT + r"|\.)\s*[^\W\d_]{2,}[\w\-]*)+", re.I),
    re.compile(_NAME_AT + r"\s(?:at|chez|ät)\s+[^\W_][\w\-]*(?:\s*" + _DOT + r"\s*[^\W\d_]{2,}[\w\-]*)+", re.I),
]
_DOT_WORDS = frozenset("dot punkt punto point arroba".split())
SPACED_MAIL = re.compile(r"(?<!\w)(?:[\w.+\-] ){2,40}@ (?:[\w.\-] ){3,40}[\w](?!\w)")


def emails(text: str, low: str, tokens: set[str]) -> list[Span]:
    out = []
    if "@" in text:
        for m in MAIL.finditer(text):
            name, _, last = m[1].rpartition(".")
            if len(last) >= 2 and not name.replace(".", "").isdigit():
                out.append(Span(m.start(), m.end(), "email", 0.95))
        out += [Span(m.start(), m.end(), "email", 0.8) for m in SPACED_MAIL.finditer(text)]
    if not tokens.isdisjoint(_DOT_WORDS) or "[at" in low or "(at" in low:
        out += [Span(m.start(), m.end(), "email", 0.85) for x in MAIL_WORDS for m in x.finditer(text)]
    return out


# numbers

FIVE = re.compile(r"\d\D{0,3}\d\D{0,3}\d\D{0,3}\d\D{0,3}\d")
NUMBER = re.compile(r"(?<![\w.#$€£+/-])(?:\+\s?|\(\s?\+?|00)?\d(?:[ \t ]?[().\-/–][ \t ]?[()]?|[ \t ()]{0,2})(?:\d(?:[ \t ]?[().\-/–][ \t ]?[()]?|[ \t ()]{0,2})){5,16}\d(?![\w])")
ID_CONTEXT = re.compile(r"(?<![\w])(?:" + V.ID_WORDS + r")(?![\w])(?:\s*(?:number|no\.?|nr\.?|nummer|card|is|was|ist|es|est|:|#|=|-|\())*\s*((?=[\w\- ./]{0,24}\d[\w\- ./]{0,3}\d)[A-Za-z]{0,6}[ \-]?\d(?:[ \-./]?[A-Za-z0-9])*)", re.I)
ID_SHAPES = [
    (re.compile(r"(?<![\w-])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![\w-])", re.I), 0.9),  # national insurance
    (re.compile(r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"), 0.85),  # social security
    (re.compile(r"(?<![\w-])(?:\d{8}|[XYZ]-?\d{7})-?[A-Z](?![\w-])", re.I), 0.0),  # confirmed by mod23
    (re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), 0.0),  # confirmed by mod97
]
OTHER = re.compile(r"(?:\b(?:" + V.OTHER_WORDS + r")\b[^.!?\n]{0,14}|#\s?|[$€£]\s?|\bSN-?)$", re.I)
PHONE_NEAR = re.compile(r"\b(?:" + V.PHONE_WORDS + r")\b[^\n]{0,24}$", re.I)
OFFICE = re.compile(r"\b(?:" + V.OFFICE_WORDS + r")\b", re.I)
DATE = re.compile(r"^(?:\d{4}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{4})(?:\D+\d{1,2}.*)?$")
YEARS = re.compile(r"^(?:19|20)\d\d\s?[-–/]\s?(?:19|20)\d\d$")
_WORD = "|".join(sorted(V.DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(r"(?<!\w)(?:plus[ ,-]+)?(?:(?:double|triple)[ -]+)?(?:" + _WORD + r")(?:[ ,\-]+(?:(?:double|triple)[ -]+)?(?:" + _WORD + r")){6,16}(?!\w)", re.I)


def phone_shape(raw: str, digits: str) -> float:
    """How much a number alone looks like a telephone number."""
    n = len(digits)
    if raw.lstrip("( ").startswith("+") and 8 <= n <= 15:
        return 0.95
    if raw.startswith("00") and 10 <= n <= 16:
        return 0.7
    national = digits[1:] if n == 11 and digits[0] == "1" else digits
    apart = bool(re.search(r"[()\-./ ]", raw))
    if len(national) == 10 and national[0] in "23456789" and national[3] in "23456789" and (n == 10 or apart):
        return 0.8 if apart else 0.5
    if digits[0] == "0" and 9 <= n <= 12:
        return 0.75
    if n == 7 and re.fullmatch(r"\d{3}[ .\-]\d{4}", raw):
        return 0.55
    if n in (8, 9, 10, 11) and apart and not re.fullmatch(r"\d{4}[ .\-]\d{4}", raw):
        return 0.35
    return 0.1


def number_of(text: str) -> str:
    """The leading words that make up a number: those with digits, letters before the first, a last single letter."""
    out: list[str] = []
    digits = False
    for w in text.split(" "):
        has = any(c.isdigit() for c in w)
        if not (has or not digits and len(out) < 1 and len(w) <= 6 or digits and len(w) == 1 and w.lower() not in "ai"):
            break
        out.append(w)
        digits = digits or has
        if digits and not has:
            break
    return " ".join(out).rstrip(" -./")


def numbers(text: str, low: str) -> list[Span]:
    out: list[Span] = []
    for m in ID_CONTEXT.finditer(text):
        value = number_of(m[1])
        if sum(c.isdigit() for c in value) >= 4:
            out.append(Span(m.start(1), m.start(1) + len(value), "id_number", 0.9))
    for shape, score in ID_SHAPES:
        for m in shape.finditer(text):
            value = re.sub(r"[ \-]", "", m[0]).upper()
            s = score or (0.85 if len(value) == 9 and mod23(value) or len(value) >= 15 and mod97(value) else 0.0)
            if s and not OTHER.search(text[max(0, m.start() - 30) : m.start()]):
                out.append(Span(m.start(), m.end(), "id_number", s))
    for m in NUMBER.finditer(text):
        raw = m[0].strip()
        digits = re.sub(r"\D", "", raw)
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
        if DATE.match(raw) or YEARS.match(raw) or OTHER.search(before[-30:]) or re.match(r"^-\d|^\s?(?:mg|mcg|ml|g|kg|km|euros?|dollars?|pounds?|people|times|pages)\b", after):
            continue
        near = bool(PHONE_NEAR.search(before)) or bool(re.match(r"^\s*(?:is my|after|evenings|and ask for me|if you need)", after, re.I))
        office = bool(OFFICE.search(re.split(r"[.!?\n]\s", before)[-1])) or bool(OFFICE.search(re.split(r"[.!?\n]", after)[0]))
        phone = phone_shape(raw, digits) + 0.3 * near - 0.35 * (office and not near)
        valid = len(digits) == 10 and mod11(digits) or len(digits) == 11 and digits[0] != "0" and iso7064(digits) or len(digits) == 9 and luhn(digits)
        ident = 0.15 + 0.45 * office + 0.2 * valid - 0.4 * near + (0.1 if len(digits) in (9, 10, 11) and raw.isdigit() else 0.0) - 0.6 * raw.startswith("+")
        if len(digits) == 9 and re.fullmatch(r"\d{9}|\d{3}[ -]\d\d[ -]\d{4}", raw):
            ident += 0.2
        kind, score = max(("phone", phone), ("id_number", ident), key=lambda x: x[1])
        out.append(Span(m.start(), m.start() + len(raw), kind, min(1.0, score)))
    return out


def spelled(text: str) -> list[Span]:
    out = []
    for m in SPELLED.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        office = re.search(r"(?:" + V.ID_WORDS + r")\W*$", before, re.I)
        out.append(Span(m.start(), m.end(), "id_number" if office else "phone", 0.75))
    return out


# addresses

_AFTER, _BEFORE, _END = (r"(?:" + "|".join(re.escape(w) for w in sorted(x.split(), key=len, reverse=True)) + ")" for x in (V.STREET_AFTER, V.STREET_BEFORE, V.STREET_END))
_NAME = r"(?:[^\W\d_]{1,2}\.|[^\W\d_][\w'’\-]*)"
ADDRESS = [
    re.compile(r"(?<![\w#])\d{1,5}\s?[a-h]?(?:/\d+)?,? (?:(?:n|s|e|w|north|south|east|west)\.? )?" + _NAME + r"(?: " + _NAME + r"){0,2} " + _AFTER + r"\b\.?", re.I),
    re.compile(r"(?<!\w)" + _NAME + r" " + _AFTER + r"\b\.?,? (?:apt|apartment|flat|unit|suite|no|nr|#)\.? ?\d+\w?", re.I),
    re.compile(r"(?<!\w)[^\W\d_]\w{2,}(?:[ \-])?" + _END + r" ?\d{1,4} ?[a-h]?\b", re.I),
    re.compile(r"(?<![\w#])\d{1,4}(?: ?(?:bis|ter))?,? " + _BEFORE + r" (?:(?:de|du|des|de la|de l['’]|d['’]|la|le) ?)?" + _NAME, re.I),
    re.compile(r"(?<!\w)(?:" + _BEFORE[3:-1] + r"|c/) (?:(?:de|del|de la|di) )?" + _NAME + r"(?: " + _NAME + r"){0,2},? (?:n[º°o]\.? ?)?\d{1,4}\b", re.I),
    re.compile(r"(?<!\w)(?:p\.? ?o\.? ?box|post(?:al)? box|post office box|postfach|apartado(?: de correos)?|bo[iî]te postale|b\.?p\.?|casilla(?: postal)?) ?(?:no\.? ?|nr\.? ?|#)?\d{2,6}\b", re.I),
    re.compile(r"(?<!\w)[A-Z][\w'’\-]+ (?:" + "|".join(w.capitalize() for w in V.HOUSES.split()) + r"), (?:\d{1,4}\w? )?[A-Z][\w'’\-]+"),
]
_ADDRESS_WORDS = frozenset(f"{V.STREET_AFTER} {V.STREET_BEFORE} {V.HOUSES} box postfach apartado postale postal casilla bp c".split())
_ENDING = re.compile(r"(?:e|g|z|ng|mm|r|d|\.) ?\d")  # of a glued street word before its number
_GLUED = re.compile(_END + r" ?\d", re.I)
WORK_BEFORE = re.compile(r"\b(?:" + V.WORKS.replace(" ", "|") + r")\s+(?:on\s+|no\.?\s*|#)?(?:level\s+)?$", re.I)
PLACE_BEFORE = re.compile(r"\b(?:at|to|in|address|place|live|lives|moved|letter|wohne|habite|vivo|au|en)\b\W{0,3}(?:\w+\W+)?$", re.I)
TAIL = re.compile(r"^,? (?:[A-Z][a-z]+ )?[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b|^,? \d{5}(?: [A-Z][a-zß-ü]+)?|^, [A-Z][a-z]+(?: [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}| \d{5})?\b")
#: Phrases in which a number and a street word are no address.
NO_STREET = re.compile(r"^\d+\s?\w? (?:of|to|in|on|at|for|and|or|a|the|minutes?|hours?|days?|weeks?|months?|years?|times?|mg|people|percent|am|pm|x|st|nd|rd|th|steps?|miles?|km|more|other|different)\b", re.I)


def addresses(text: str, low: str, tokens: set[str]) -> list[Span]:
    out = []
    if not tokens.isdisjoint(_ADDRESS_WORDS) or _ENDING.search(low) and _GLUED.search(low):
        for pattern in ADDRESS:
            for m in pattern.finditer(text):
                before = text[max(0, m.start() - 32) : m.start()]
                if NO_STREET.match(m[0]) or WORK_BEFORE.search(before):
                    continue
                if m[0] == m[0].lower() and low != text and not PLACE_BEFORE.search(before):
                    continue
                end = m.end()
                tail = TAIL.match(text[end : end + 60])
                out.append(Span(m.start(), end + (tail.end() if tail else 0), "address", 0.8))
    return out


# names

LETTERS = re.compile(r"[^\W\d_]+")
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)*"
_TITLE = r"(?:" + "|".join(sorted(V.TITLES, key=len, reverse=True)) + ")"
TITLED = re.compile(r"(?<![\w.])" + _TITLE + r"\.?[ \t]+((?:[^\W\d_]\.[ \t]?)*[^\W\d_][\w'’\-]{2,})((?:[ \t]+[^\W\d_][\w'’\-]{2,})?)", re.I)
RUN = re.compile(r"(?<![\w@.+])[^\W\d_][\w'’\-]*(?:(?:[ \t]+|(?<=[^\W\d_])\.[ \t]*)[^\W\d_][\w'’\-]*)*")
TURNED = re.compile(r"(?<![\w@.+\-])([^\W\d_][\w'’\-]{2,}), (?=([^\W\d_]\w+)(?![\w@+]))")
CUE = re.compile(
    r"(?:[Mm]y name is|MY NAME IS|[Ii] am called|[Aa]sk for|[Ss]poke (?:to|with)|[Tt]alked to|[Rr]egards,|[Ss]incerely,|[Bb]est,|[Cc]heers,|[Ss]igned,?|[Yy]ours,|anybody seen|anyone seen|[Ss]ee you,|[Dd]octor is|[Tt]herapist is|[Pp]sychiatrist(?: is)?|"
    r"heißt|heisst|[Mm]ein Name ist|Gruß,?|Grüße,?|se llama|[Mm]e llamo|[Mm]i nombre es|[Ss]aludos,|s['’]appelle|[Jj]e m['’]appelle|[Mm]on nom est|[Cc]ordialement,)\s+(" + CAP + r"(?: (?:[A-Z]\. ?)?" + CAP + r"){1,2})"
)
#: A person's relation to the writer before a name, or what people do after it; both only count with two capital words.
RELATED = re.compile(r"(?<!\w)(?i:" + V.POSSESSIVES + r")\s+(?:[a-zß-ÿ]+\s+)?(?i:" + V.RELATIONS + r")(?:\s+(?i:is|was|called|named|heißt|ist|se llama|est|,))?,?\s+(" + CAP + r"(?: (?:[A-Z]\. ?)?" + CAP + r"){1,2})")
ACTING = re.compile(r"(?<![\w'’])(" + CAP + r"(?: [A-Z]\.)? " + CAP + r")\s+(?i:" + V.ACTS + r")(?!\w)")
CUE_GATE = ("name is", "ask for", "spoke", "talked to", "regards", "best,", "sincerely", "cheers", "signed", "yours", "seen", "psychiatrist", "therapist", "doctor is", "heißt", "heisst", "name ist", "gruß", "grüße", "llam", "nombre", "saludos", "appelle", "nom est", "cordialement")
_STREETS = frozenset(f"{V.STREET_AFTER} {V.STREET_BEFORE} {V.HOUSES}".split())
_TITLES = frozenset(V.TITLES)


def family(word: str, cased: bool) -> bool:
    """Whether a word can be a family name. cased: the text writes names with capitals."""
    w = word.lower().strip("'’.")
    w = w[:-2] if w.endswith(("'s", "’s")) else w
    return len(w) >= 3 and w not in V.COMMON and w not in V.FIGURATIVE and w not in V.GIVEN and w not in _STREETS and w not in _TITLES and (word[0].isupper() or not cased)


def names(text: str, low: str, tokens: set[str]) -> list[Span]:
    out: list[Span] = []
    upper = sum(map(str.isupper, text))
    cased = 0 < upper < 0.6 * sum(map(str.isalpha, text))
    if not tokens.isdisjoint(_TITLES):
        for m in TITLED.finditer(text):
            word = m[1].split(".")[-1].strip()
            title = m[0].split()[0].rstrip(".").lower()
            end = m.end(1)
            if title in ("dr", "st") and re.search(r"\d\w? [\w'’]+ $", text[max(0, m.start() - 30) : m.start()]):
                continue  # a street
            if m[2] and family(m[2].strip(), cased) and (word.lower() in V.GIVEN or cased and word[0].isupper()):
                end = m.end()
            elif not family(word, cased):
                if not (word.lower() in V.GIVEN and m[2] and family(m[2].strip(), cased)):
                    continue
                end = m.end()
            if title in ("doctor", "nurse", "sir", "don", "fr", "hr", "miss", "sr", "dame") and not (cased and word[0].isupper()):
                continue
            out.append(Span(m.start(), end, "person_name", 0.85 if cased else 0.7))
    if not tokens.isdisjoint(V.GIVEN):
        for m in RUN.finditer(text):
            words = [(w.group(), m.start() + w.start()) for w in re.finditer(r"[^\W\d_][\w'’\-]*", m[0])]
            i = 0
            while i < len(words):
                w, at = words[i]
                if w.lower() in V.GIVEN and (w[0].isupper() or not cased):
                    j = i + 1
                    while j < len(words) and words[j][0].lower() in V.GIVEN and (words[j][0][0].isupper() or not cased):
                        j += 1
                    while j < len(words) and len(words[j][0]) == 1 and words[j][0].isalpha() and text[words[j][1] + 1 : words[j][1] + 2] == ".":
                        j += 1
                    if j < len(words) and family(words[j][0], cased):
                        last, start = words[j]
                        last = re.sub(r"['’]s$", "", last)
                        out.append(Span(at, start + len(last), "person_name", 0.8 if cased else 0.6))
                        i = j + 1
                        continue
                    i = j
                    continue
                i += 1
        for m in TURNED.finditer(text):
            if m[2].lower() in V.GIVEN and family(m[1], cased) and (m[2][0].isupper() or not cased):
                out.append(Span(m.start(), m.end(2), "person_name", 0.7 if cased else 0.5))
    if cased and any(c in low for c in CUE_GATE):
        for m in CUE.finditer(text):
            words = m[1].split(" ")
            if all(family(w, True) or w.lower() in V.GIVEN for w in words) and not text[m.end() : m.end() + 2].strip(" ").startswith("@"):
                out.append(Span(m.start(1), m.end(1), "person_name", 0.75))
    if cased and not tokens.isdisjoint(_PEOPLE):
        for pattern, score in ((RELATED, 0.7), (ACTING, 0.55)):
            for m in pattern.finditer(text):
                if all(family(w, True) or w.lower() in V.GIVEN for w in re.findall(r"[^\W\d_][\w'’\-]+", m[1])):
                    out.append(Span(m.start(1), m.end(1), "person_name", score))
    return out


def spans(text: str) -> list[Span]:
    """Disjoint spans in `readable` text, in order. Where proposals overlap, the higher score stays, then the longer."""
    low = text.lower()
    tokens = set(LETTERS.findall(low))
    found = emails(text, low, tokens) + addresses(text, low, tokens)
    if FIVE.search(text):
        found += numbers(text, low)
    if len(tokens & _SPELLED) >= 2:
        found += spelled(text)
    if not tokens.isdisjoint(_NAME_GATE) or not tokens.isdisjoint(_PEOPLE) or any(c in low for c in CUE_GATE):
        found += names(text, low, tokens)
    if not found:
        return []
    kept: list[Span] = []
    for s in sorted((s for s in found if s.score >= LEAST), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept)


_SPELLED = frozenset(V.DIGIT_WORDS)
_NAME_GATE = V.GIVEN | _TITLES
_PEOPLE = frozenset(f"{V.RELATIONS}|{V.ACTS}".split("|"))


def replaced(text: str) -> tuple[str, int]:
    """The stored text with a placeholder for each span, and their number; all else stays as it is stored."""
    ready = readable(text)
    found = spans(ready)
    if not found:
        return text, 0
    places = aligned(text)
    if places.text != ready:  # signs that only combine across letters
        found = spans(places.text)
    out, at = [], 0
    for s in found:
        start, end = places.stored(s.start, s.end)
        if start >= at:
            out += [text[at:start], f"[{s.kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]]), len(found)


def found_types(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, pii_type): each type of each key once; null keys and null or empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, types = [], []
            for k, t in zip(b[key], b[text]):
                for kind in {s.kind for s in spans(readable(t))}:
                    keys.append(k)
                    types.append(kind)
            yield pd.DataFrame({"row_key": pd.Series(keys, dtype=object), "pii_type": pd.Series(types, dtype=object)})

    some = rows.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("string").alias(key), text)
    return some.mapInPandas(run, "row_key string, pii_type string").distinct()


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """The same rows with placeholders like [PHONE] in `text` and the number of replacements in n_replaced; texts without
    a span stay as they are, null and empty ones too."""
    schema = T.StructType([*rows.drop("n_replaced").schema.fields, T.StructField("n_replaced", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, counts = [], []
            for t in b[text]:
                new, n = replaced(t) if t else (t, 0)
                out.append(new)
                counts.append(n)
            yield b.assign(**{text: out, "n_replaced": counts})

    return rows.drop("n_replaced").mapInPandas(run, schema)
