"""Text as tokens, weights, digests and redactions. Null texts give null or empty results, never errors."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.base import cut, lookup_skewed

#: English stop words of the lexical features.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()

LINK_ONLY = r"^\s*https?://\S+\s*$"
TOMBSTONES = ["", "[deleted]", "[removed]"]


#: What lower-case letters fold to in comparisons without case, where it is not one letter of its own.
FOLDS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn", "ſ": "s", "ς": "σ"}


def casefolded(text: Column) -> Column:
    """For comparing without case. (The upper case of sharp s is ss, but Catalyst drops upper inside lower.)"""
    out = F.lower(text)
    for letter, folded in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def canonical(text: Column) -> Column:
    """No white space around, runs of it (of any script) as one blank, case folded."""
    return casefolded(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def text_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def bare_id(c: Column) -> Column:
    """Without the prefix of comments and posts."""
    return F.regexp_replace(c, r"^t[13]_", "")


def stem(c: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def words3(text: Column) -> Column:
    """Runs of three or more letters a to z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]{3,})"), F.lit(1))


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of two or more letters, digits and underscores of any script, lower case, without the stop words; repeats
    stay. `stop` may be another list, such as a longer one or one of another language."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def split_labels(c: Column) -> Column:
    """Parts between bars, trimmed, without empty ones, "nan" and "none"."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin("", "nan", "none"))


def join_labels(c: Column) -> Column:
    return F.concat_ws("|", F.array_distinct(c))


def primary_label(c: Column, default: str) -> Column:
    return F.coalesce(F.get(split_labels(c), F.lit(0)), F.lit(default))


def role_prefixed(c: Column, role: str) -> Column:
    """With "query: " or "passage: " in front, once."""
    return F.when(c.startswith(f"{role}: "), c).otherwise(F.concat(F.lit(f"{role}: "), c))


def term_matches(text: Column, terms: list[str]) -> Column:
    """The first of the terms in the text as a whole word, whatever its case; null if there is none."""
    pattern = r"(?iU)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def host_in(host: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith(f".{d}")
    return out


# weights over a corpus


def document_frequencies(corpus: DataFrame, item: str, text: str) -> DataFrame:
    """(term, df): in how many items each term occurs, with partial counts before the shuffle."""
    terms = corpus.select(F.explode(token_set(F.col(text))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(corpus: DataFrame, item: str, text: str) -> DataFrame:
    """(term, df, idf): ln((n + 1) / (df + 1)) + 1."""
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    return document_frequencies(corpus, item, text).crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def lexical_features(pairs: DataFrame, queries: DataFrame, item_text: str, query_text: str, weights: DataFrame) -> DataFrame:
    """The pairs without item_text, with shared (terms), overlap (share of the query's idf that the item covers) and rare
    (shared terms of idf at or above the third quartile of the query's). Terms without a weight count 0.

    pairs has a query_id, queries are unique in it. A query's terms become one map from term to idf, which meets its pairs
    once; item texts aren't copied by term. Queries without terms, unknown ones and null texts share nothing.
    """
    terms = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(token_set(F.col(query_text))).alias("term"))
    known = terms.groupBy("term").agg(F.count(F.lit(1)).alias("__c")).join(weights.select("term", "idf"), "term", "left")
    weighed = lookup_skewed(terms, known, "term", "__c").select("query_id", "term", F.coalesce("idf", F.lit(0.0)).alias("w"))
    maps = weighed.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("__q"), F.percentile("w", 0.75).alias("__cut"), F.sum("w").alias("__all"))
    wanted = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n")).join(maps, "query_id", "left")
    both = lookup_skewed(pairs.select(*[c for c in pairs.columns if c != item_text], token_set(F.col(item_text)).alias("__i")), wanted, "query_id", "__n", "left")
    hits = F.coalesce(F.transform(F.array_intersect(F.map_keys("__q"), F.col("__i")), lambda t: F.col("__q")[t]), F.array().cast("array<double>"))
    out = both.withColumn("__w", hits)
    got = F.aggregate("__w", F.lit(0.0), lambda s, w: s + w)
    return out.select(*[c for c in pairs.columns if c != item_text], F.size("__w").alias("shared"), F.when(F.col("__all") > 0, got / F.col("__all")).otherwise(F.lit(0.0)).alias("overlap"), F.size(F.filter("__w", lambda w: w >= F.col("__cut"))).alias("rare"))


#: Queries that go to all tasks at once with their terms' weights; more are asked in blocks of that number.
ASKED = 4096
#: Sums of a text and a query that a task holds at once.
BM25_CELLS = 1 << 19


def bm25(corpus: DataFrame, queries: DataFrame, item: str, text: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, item, score, rank): the k best items by BM25 (Robertson's idf, not below 0).

    Queries are a stated set. Document frequencies of their terms are counted over the whole corpus with partial sums.
    Then the weighted terms of a block of ASKED queries meet the corpus in one pass that shuffles nothing: each task adds
    up weights for a few texts and all queries at a time, and keeps what reaches the k best of a query that it has seen, so
    that k rows per query and task are shuffled. The corpus is tokenised once.
    Texts without a term of a query do not appear under it; null texts have no terms; ties go to the smaller id.
    """
    from rankloom.operators.ranking import top_k

    q = queries.filter(F.col("query_id").isNotNull()).select("query_id", F.explode(token_set(F.col(query_text))).alias("term")).distinct()
    wanted = q.select("term").distinct()
    docs = cut(corpus.filter(F.col(item).isNotNull()).select(item, tokens(F.col(text)).alias("__t")))
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("__t"))).first()
    df = docs.select(F.explode(F.array_distinct("__t")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    terms = cut(q.join(df, "term").withColumn("w", weight).filter("w > 0"))
    blocks = max(1, -(-terms.agg(F.count_distinct("query_id")).first()[0] // ASKED))
    kind, qkind = dict(corpus.dtypes)[item], dict(queries.dtypes)["query_id"]
    schema = f"query_id {qkind}, `{item}` {kind}, score double"
    found = corpus.sparkSession.createDataFrame([], schema)
    for i in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("term", "query_id").collect()
        if not rows:
            continue
        names = sorted({r["query_id"] for r in rows})
        place = {x: j for j, x in enumerate(names)}
        vocabulary = {t: j for j, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
        first = np.searchsorted(np.array([vocabulary[r["term"]] for r in rows]), np.arange(len(vocabulary) + 1))
        shared = corpus.sparkSession.sparkContext.broadcast((names, vocabulary, first, np.array([place[r["query_id"]] for r in rows]), np.array([r["w"] for r in rows])))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked, known, start, whose, weights = shared.value
            asked, width = np.array(asked, dtype=object), len(asked)
            step = max(1, BM25_CELLS // width)
            least, held, names_of = np.zeros(width), [], {}

            def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """(query, doc, total): the k best of each query so far; the last of them is what later ones have to reach."""
                query, doc, total = (np.concatenate(x) for x in zip(*held))
                own, at = np.unique(doc, return_inverse=True)
                place = np.empty(len(own), dtype=np.int64)
                place[np.argsort(np.array([names_of[x] for x in own.tolist()], dtype=object), kind="stable")] = np.arange(len(own))
                order = np.lexsort((place[at], -np.round(total, 9), query))
                query, doc, total = query[order], doc[order], total[order]
                turn = np.arange(len(query)) - np.searchsorted(query, query)
                least[query[turn == k - 1]] = np.round(total[turn == k - 1], 9)
                return query[turn < k], doc[turn < k], total[turn < k]

            seen = waiting = 0
            for batch in batches:
                ids, words_of = batch[item].to_numpy(), batch["__t"].to_numpy()
                for at in range(0, len(ids), step):
                    length, row, term, tf = np.array([len(t) for t in words_of[at : at + step]], dtype=float), [], [], []
                    for r, words in enumerate(words_of[at : at + step]):
                        counts = Counter(j for w in words if (j := known.get(w)) is not None)
                        row += [r] * len(counts)
                        term += counts
                        tf += counts.values()
                    if not row:
                        continue
                    row, term, tf = np.array(row), np.array(term), np.array(tf, dtype=float)
                    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / max(mean, 1e-12)))
                    many = start[term + 1] - start[term]
                    place = np.arange(many.sum()) + np.repeat(start[term] - np.cumsum(many) + many, many)
                    cells = np.bincount(np.repeat(row * width, many) + whose[place], weights=np.repeat(part, many) * weights[place], minlength=len(length) * width).reshape(-1, width)
                    doc, query = np.nonzero((cells >= least - 1e-9) & (cells > 0))
                    if len(doc):
                        held.append((query, doc + seen + at, np.round(cells[doc, query], 12)))
                        names_of.update((seen + at + x, ids[at + x]) for x in np.unique(doc).tolist())
                        waiting += len(doc)
                    if waiting > BM25_CELLS:
                        held = [best()]
                        used = set(np.unique(held[0][1]).tolist())
                        names_of, waiting = {x: v for x, v in names_of.items() if x in used}, 0
                seen += len(ids)
            if held:
                query, doc, total = best()
                for at in range(0, len(query), 10_000):
                    own = slice(at, at + 10_000)
                    yield pd.DataFrame({"query_id": asked[query[own]], item: [names_of[x] for x in doc[own].tolist()], "score": total[own]})

        found = found.unionByName(docs.mapInPandas(score, schema))
    return top_k(found, ["query_id"], [F.desc(F.round("score", 9)), item], k)


def tfidf(corpus: DataFrame, item: str, text: str, weights: DataFrame) -> DataFrame:
    """(item, term, value): (1 + ln tf) * idf, of length 1 per item."""
    tf = corpus.select(item, F.explode(tokens(F.col(text))).alias("term")).groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(weights.select("term", "idf"), "term").select(item, "term", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    length = raw.groupBy(item).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return raw.join(length, item).select(item, "term", (F.col("v") / F.col("l")).alias("value"))


# normalisation and placeholders that no expression has


def ascii_normal(text: Column) -> Column:
    """Typographic signs as plain ones, compatibility forms taken apart, all else that is not ASCII dropped."""
    return F.pandas_udf(_ascii_normal, "string")(text)


def _ascii_normal(s: pd.Series) -> pd.Series:
    signs = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " "})
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.translate(signs)).encode("ascii", "ignore").decode())


#: Kinds of links by words of their host or path, in order.
LINK_KINDS = [
    ("video", r"youtu|vimeo|video"), ("image", r"imgur|\.(?:png|jpe?g|gif)\b|image"), ("study", r"pubmed|doi\.org|arxiv|journal|library"),
    ("shop", r"amazon|shop|store|buy|product"), ("guide", r"guide|wiki|help|letters|notes"), ("forum", r"reddit|forum|comments"),
]


def link_kind(link: Column) -> Column:
    """The first kind whose words the link has, else "other"."""
    out = None
    for kind, words in LINK_KINDS:
        hit = F.lower(link).rlike(words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def links(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s)\]>]+)"), F.lit(1))


def redacted(text: Column) -> Column:
    """Mail addresses, links, user and community names and long numbers as placeholders, in that order."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"https?://[^\s)\]>]+", "[URL]")
    t = F.regexp_replace(t, r"(?i)(?<![\w/])/?u/[A-Za-z0-9_-]+", "[USER]")
    t = F.regexp_replace(t, r"(?i)(?<![\w/])/?r/[A-Za-z0-9_]+", "[COMMUNITY]")
    return F.regexp_replace(t, r"(?<!\d)\+?\d(?:[ ().-]{0,2}\d){6,14}(?!\d)", "[NUMBER]")


def redaction_counts(text: Column) -> Column:
    """A struct of how often each placeholder stands in redacted text."""
    return F.struct(*[F.regexp_count(text, F.lit(rf"\[{k}\]")).alias(k.lower()) for k in ("EMAIL", "URL", "USER", "COMMUNITY", "NUMBER")])
