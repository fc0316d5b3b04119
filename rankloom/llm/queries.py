"""The queries of this subpackage, under production parameters over their whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import cut, table

from . import abuse, leakage, packing, pii, residue, spam, splits, subset

TOKENIZERS = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")


def _params(spark: SparkSession, d: str, purpose: str) -> list[tuple[str, float]]:
    """Of the table of parameters, which has a fixed number of rows."""
    rows = table(spark, d, "run_params").filter((F.col("purpose") == purpose) & F.col("param_value").isNotNull()).orderBy("param_id")
    return [(r["param_name"], r["param_value"]) for r in rows.collect()]


# 1


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        pii.found_types(table(spark, d, name), key, text).select(F.lit(name).alias("table_name"), "row_key", "pii_type")
        for name, key, text in (("comments", "comment_id", "comment_text"), ("queries", "query_id", "query_text"))
    ]
    return parts[0].unionByName(parts[1])


def p1_comments(spark: SparkSession, d: str) -> DataFrame:
    """All stored comments with placeholders."""
    return pii.redacted(table(spark, d, "comments"), "comment_text")


def p1_queries(spark: SparkSession, d: str) -> DataFrame:
    """All stored queries with placeholders."""
    return pii.redacted(table(spark, d, "queries"), "query_text")


# 2


def _comment_scores(spark: SparkSession, d: str, offsets: bool = False) -> DataFrame:
    """Scores of all stored rows."""
    comments = table(spark, d, "comments").filter(F.col("comment_id").isNotNull())
    model = abuse.train(abuse.rated_sample(comments, table(spark, d, "moderation_labels")))
    return abuse.scored(comments, model, "comment_text", ["comment_id", "source"], offsets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _comment_scores(spark, d).filter(F.col("score") >= abuse.REVIEW).select("comment_id").distinct()


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of each comment the score of its worst stored row, with that row's offending stretches."""
    worst = _comment_scores(spark, d, offsets=True).groupBy("comment_id").agg(F.max(F.struct("score", "spans")).alias("w"))
    action = F.when(F.col("w.score") >= abuse.EXCLUDE, "exclude").when(F.col("w.score") >= abuse.REVIEW, "review").otherwise("keep")
    return worst.select("comment_id", F.col("w.score").alias("score"), F.col("w.spans").alias("spans"), action.alias("action"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the distinct comments and the share of them that are to be reviewed."""
    per = _comment_scores(spark, d).groupBy("source", "comment_id").agg(F.max("score").alias("s"))
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("comments"), F.avg((F.col("s") >= abuse.REVIEW).cast("double")).alias("rate"), F.avg("s").alias("mean_score"))


# 3


def candidate_categories() -> dict:
    return {
        "similarity_bin": subset.bin_of(F.col("d8_max"), 0.0, 1.0, 20),
        "length_bin": subset.bin_of(F.col("length_log"), 0.0, 6.0, 4),
        "overlap_bin": subset.bin_of(F.col("overlap"), 0.0, 0.8, 4),
    }


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per comment_id: the same comment under several queries is one candidate, with the largest of each of its features."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return (
        table(spark, d, "candidate_features").filter(F.col("comment_id").isNotNull()).groupBy("comment_id")
        .agg(
            F.max(known("candidate_to_d8_max_similarity")).alias("d8_max"), F.max(known("candidate_to_d8_mean_similarity")).alias("d8_mean"),
            F.max(known("comment_length_log")).alias("length_log"), F.max(known("idf_weighted_lexical_overlap")).alias("overlap"),
        )
    )


def p3_subset(spark: SparkSession, d: str) -> DataFrame:
    cell = [F.floor(F.col(c) * 50) for c in ("d8_max", "d8_mean", "length_log")]
    return subset.varied_subset(candidates(spark, d), [v for _, v in _params(spark, d, "subset")], "comment_id", candidate_categories(), cell)


# 4


def _query_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "queries"), "query_id", {"author": ["author"], "post": ["post_id", "crosspost_parent"]})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _query_groups(spark, d).filter(F.col("group") != F.col("id")).select(F.col("group").alias("first_query_id"), F.col("id").alias("query_id"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    shares = {k.removesuffix("_share"): v for k, v in _params(spark, d, "split")}
    return splits.grouped_split(_query_groups(spark, d), shares).select(F.col("id").alias("query_id"), F.col("group").alias("first_query_id"), "split")


# 5


def _judged_replies(spark: SparkSession, d: str) -> DataFrame:
    """One row per stored reply with its spans of residue."""
    rows = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r"))
    replies = rows.select("query_id", F.col("r.reply_id").alias("reply_id"), F.col("r.text").alias("text"))
    return residue.residue(replies, residue.fitted(replies, "text"), "text", ["query_id", "reply_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged_replies(spark, d).filter(F.col("excluded") & F.col("reply_id").isNotNull()).select("query_id", "reply_id").distinct()


def p5_references(spark: SparkSession, d: str) -> DataFrame:
    """The references (each stored row once) without the excluded replies; all have their row, if with an empty array."""
    out = p5_found(spark, d).groupBy("query_id").agg(F.collect_set("reply_id").alias("gone"))
    rows = table(spark, d, "reply_references").distinct()
    gone = F.coalesce("gone", F.array().cast("array<string>"))
    kept = F.filter("replies", lambda r: r["reply_id"].isNull() | ~F.array_contains(gone, r["reply_id"]))
    return rows.join(out, "query_id", "left").select("query_id", kept.alias("replies"), "fetched_at", F.size(gone).alias("n_excluded"))


# 6


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_lengths(spark, d), "doc_id", "n_tokens", [int(v) for _, v in _params(spark, d, "packing")])


def p6_tiered(spark: SparkSession, d: str) -> DataFrame:
    return packing.tiered(_lengths(spark, d), "doc_id", "n_tokens", [int(v) for _, v in _params(spark, d, "packing")])


# 7


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "question", "passage")


# 8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_comments": p1_comments,
    "p1_queries": p1_queries,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p2_rates": p2_rates,
    "p3_subset": p3_subset,
    "p4_found": p4_found,
    "p4_split": p4_split,
    "p5_found": p5_found,
    "p5_references": p5_references,
    "p6_pack": p6_pack,
    "p6_tiered": p6_tiered,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

_TIES = r"""WITH RECURSIVE named AS (SELECT query_id, 'a:' || e AS entity FROM (SELECT query_id, regexp_replace(lower(trim(author)), '^/*u/', '') AS e FROM queries) WHERE e NOT IN ('', 'nan', 'none', 'null', '[deleted]', '[removed]', 'automoderator', 'b0trank', 'repostsleuthbot')
UNION SELECT query_id, 'p:' || e FROM (SELECT query_id, trim(regexp_replace(regexp_replace(lower(trim(p)), '^https?://[^/]+/comments/([^/]+)/?$', '\1'), '^t[1-6]_', '')) AS e FROM (SELECT query_id, unnest([post_id, crosspost_parent]) AS p FROM queries)) WHERE e NOT IN ('', 'nan', 'none', 'null', '[deleted]', '[removed]')),
ties AS (SELECT DISTINCT a.query_id AS a, b.query_id AS b FROM named a JOIN named b USING (entity)),
reached AS (SELECT DISTINCT query_id AS a, query_id AS b FROM queries WHERE query_id IS NOT NULL UNION SELECT r.a, t.b FROM reached r JOIN ties t ON r.b = t.a)
SELECT min(b) AS first_query_id, a AS query_id FROM reached GROUP BY a HAVING min(b) <> a"""

#: The driver's SQL: components as the closure of ties. The other operators rest on hashes, flows, models and character
#: tricks that SQL does not have; they are held against brute force, held-out accuracy and planted cases in the tests.
ORACLE: dict[str, str] = {"p4_found": _TIES}
