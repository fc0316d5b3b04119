"""The library's tables as the queries use them, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.operators import ranking, setops

LABELS = ["label_relevance", "label_usefulness", "label_novelty", "label_actionability", "label_resonance", "label_safety"]
PAIR = ["query_id", "comment_id"]
GOOD = 4.5


def run(spark: SparkSession, d: str) -> DataFrame:
    """The stored runs of both backends as run(route, query_id, comment_id, score, rank)."""
    return ranking.as_run(table(spark, d, "retrieval_runs"), F.col("backend"), "query_id", "comment_id", F.col("score"))


def number(c: str):
    return F.when(~F.isnan(F.col(c)), F.col(c))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair of the candidate features; repeated rows count once, NaN is null."""
    cols = {"sbert": "query_candidate_sbert_similarity", "lexical": "idf_weighted_lexical_overlap", "length": "comment_length_log", "percentile": "candidate_dense_percentile", "d8_max": "candidate_to_d8_max_similarity", "d8_mean": "candidate_to_d8_mean_similarity", "novelty": "candidate_novelty_relative_to_d8"}
    rows = table(spark, d, "candidate_features").filter("query_id IS NOT NULL AND comment_id IS NOT NULL")
    return rows.groupBy(*PAIR).agg(F.max("source_pool").alias("source_pool"), F.min("dense_rank").cast("int").alias("dense_rank"), *[F.max(number(c)).alias(n) for n, c in cols.items()])


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Three routes over the candidate pool: by similarity, lexical overlap and length."""
    p = pool(spark, d)
    each = p.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.col(r).alias("score")) for r in ("sbert", "lexical", "length")])).alias("x")).select("x.route", *PAIR, F.coalesce("x.score", F.lit(0.0)).alias("score"))
    return ranking.ranked(each, ranking.KEYS, [F.desc("score"), "comment_id"])


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The last judgment of each pair: by time, then the larger utility and labels."""
    rows = table(spark, d, "qrels").filter("query_id IS NOT NULL AND comment_id IS NOT NULL")
    return setops.latest(rows, PAIR, [F.desc_nulls_last(c) for c in ("judged_at", "utility", *LABELS, "judge_model", "judge_version", "validation_status")])


def gold(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).filter(F.col("utility") >= GOOD).select(*PAIR)


def posts(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each post."""
    return setops.latest(table(spark, d, "submissions").filter("post_id IS NOT NULL"), ["post_id"], [F.desc_nulls_last(c) for c in ("ingested_at", "n_comments", "selftext", "subreddit", "author")])


def comments(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each comment."""
    return setops.latest(table(spark, d, "comments").filter("comment_id IS NOT NULL"), ["comment_id"], [F.desc_nulls_last(c) for c in ("ingested_at", "score", "comment_text", "link_id", "parent_id", "author", "source", "created_utc")])


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query_text): of each query the last delivery's text."""
    rows = table(spark, d, "queries").filter("query_id IS NOT NULL")
    return setops.latest(rows, ["query_id"], [F.desc_nulls_last(c) for c in ("ingested_at", "query_text", "post_id", "author", "crosspost_parent")])


_RANK = "row_number() OVER (PARTITION BY route, query_id ORDER BY score DESC, comment_id)"
_LAST = ", ".join(f"{c} DESC NULLS LAST" for c in ("judged_at", "utility", *LABELS, "judge_model", "judge_version", "validation_status"))


def _newest(name: str, keys: str, order: tuple[str, ...]) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in order)}) AS rn FROM {name} WHERE {keys.split(',')[0]} IS NOT NULL) WHERE rn = 1"


#: Common table expressions by name, in an order in which each uses only earlier ones.
CTES = {
    "run": f"SELECT *, {_RANK} AS rank FROM (SELECT backend AS route, query_id, comment_id, max(CASE WHEN score IS NULL OR isnan(score) THEN 0.0 ELSE score END) AS score FROM retrieval_runs WHERE query_id IS NOT NULL AND trim(comment_id) <> '' GROUP BY ALL)",
    "pool": "SELECT query_id, comment_id, max(source_pool) AS source_pool, min(dense_rank) AS dense_rank, "
    + ", ".join(f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {n}" for n, c in (("sbert", "query_candidate_sbert_similarity"), ("lexical", "idf_weighted_lexical_overlap"), ("length", "comment_length_log"), ("percentile", "candidate_dense_percentile"), ("d8_max", "candidate_to_d8_max_similarity"), ("d8_mean", "candidate_to_d8_mean_similarity"), ("novelty", "candidate_novelty_relative_to_d8")))
    + " FROM candidate_features WHERE query_id IS NOT NULL AND comment_id IS NOT NULL GROUP BY ALL",
    "routes": f"SELECT *, {_RANK} AS rank FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS route, query_id, comment_id, coalesce({r}, 0.0) AS score FROM pool" for r in ("sbert", "lexical", "length")) + ")",
    "judged": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, comment_id ORDER BY {_LAST}) AS rn FROM qrels WHERE query_id IS NOT NULL AND comment_id IS NOT NULL) WHERE rn = 1",
    "gold": f"SELECT query_id, comment_id FROM judged WHERE utility >= {GOOD}",
    "posts": _newest("submissions", "post_id", ("ingested_at", "n_comments", "selftext", "subreddit", "author")),
    "notes": _newest("comments", "comment_id", ("ingested_at", "score", "comment_text", "link_id", "parent_id", "author", "source", "created_utc")),
    "texts": _newest("queries", "query_id", ("ingested_at", "query_text", "post_id", "author", "crosspost_parent")),
}
NEEDS = {"routes": ["pool"], "gold": ["judged"]}


def sql(select: str, *names: str, **more: str) -> str:
    """The SELECT after the named common tables and further ones given as name=query."""
    wanted = {x for n in names for x in (*NEEDS.get(n, []), n)}
    parts = [f"{n} AS ({q})" for n, q in CTES.items() if n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
