"""Queries of filters, guards, lookups and set operations that a study checks its inputs with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.functions import text as tx
from rankloom.operators import guards, ranking, sampling, selection, setops

from . import tables as t
from .record_queries import BOTS, TERMS, year_of
from .record_queries import _YEAR as YEAR_SQL
from .scan_queries import _GRAPH, GRAPH, big, graph_run, one_row, own_links, r6, raises
from .tables import PAIR, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def count_by(df: DataFrame, **columns) -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in columns.items()]).agg(F.count(F.lit(1)).alias("n"))


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# filters


@query("b3_thread_tiers", sql("SELECT tier, count(*) AS threads, CAST(sum(n) AS BIGINT) AS comments FROM (SELECT n, CASE WHEN n >= 16 THEN 'deep' WHEN n >= 4 THEN 'mid' WHEN n >= 1 THEN 'shallow' ELSE 'none' END AS tier FROM (SELECT post_id, count(comment_id) AS n FROM posts LEFT JOIN notes ON link_id = 't3_' || post_id GROUP BY 1)) GROUP BY 1", "posts", "notes"))
def b3(spark: SparkSession, d: str) -> DataFrame:
    """Posts by how many comments they have, those without any included."""
    n = t.comments(spark, d).groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    per = t.posts(spark, d).select(F.concat(F.lit("t3_"), "post_id").alias("link_id")).join(n, "link_id", "left").fillna(0, ["n"])
    return per.groupBy(sampling.tier_of(F.col("n")).alias("tier")).agg(F.count(F.lit(1)).alias("threads"), F.sum("n").alias("comments"))


@query("b5_candidate_bands", sql("SELECT source_pool, CASE WHEN r <= 10 THEN '1-10' WHEN r <= 20 THEN '11-20' WHEN r IS NOT NULL THEN '21+' END AS band, count(*) AS n FROM (SELECT p.source_pool, coalesce(p.dense_rank, o.rank) AS r FROM pool p LEFT JOIN (SELECT * FROM routes WHERE route = 'lexical') o USING (query_id, comment_id)) GROUP BY ALL", "routes"))
def b5(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the band of their dense rank, or of their lexical one where that is missing."""
    other = t.routes(spark, d).filter("route = 'lexical'").select(*PAIR, "rank")
    r = F.coalesce("dense_rank", "rank")
    return count_by(t.pool(spark, d).join(other, PAIR, "left"), source_pool=F.col("source_pool"), band=ranking.rank_band(r, [(1, 10, "1-10"), (11, 20, "11-20"), (21, 1 << 30, "21+")]))


_TERM = "nullif(regexp_extract({c}, '(?i)\\b(" + "|".join(TERMS) + ")\\b', 1), '')"


@query("b9_first_terms", sql("SELECT doc_id, m AS match FROM (SELECT DISTINCT doc_id, " + _TERM.format(c="text") + " AS m FROM documents) WHERE m IS NOT NULL"))
def b9(spark: SparkSession, d: str) -> DataFrame:
    """The first term of a list in each document, as it is written there."""
    return table(spark, d, "documents").select("doc_id", tx.term_matches(F.col("text"), TERMS).alias("match")).filter("match IS NOT NULL").distinct()


@query("b10_queries_without_terms", sql("SELECT m IS NULL AS kept, lower(m) AS match, count(*) AS n FROM (SELECT " + _TERM.format(c="query_text") + " AS m FROM texts) GROUP BY ALL", "texts"))
def b10(spark: SparkSession, d: str) -> DataFrame:
    """Queries that a list of terms keeps and those it leaves out, by term; null texts are kept."""
    m = tx.term_matches(F.col("query_text"), TERMS)
    return count_by(t.texts(spark, d), kept=m.isNull(), match=F.lower(m))


_WRITINGS = [("1.5",), ("-2e3",), ("nan",), ("NaN",), ("inf",), ("-Infinity",), ("abc",), ("",), (None,), ("0",)]


@query("b14_finite_numbers", "SELECT s, CASE WHEN isfinite(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END AS number FROM (SELECT unnest(['1.5', '-2e3', 'nan', 'NaN', 'inf', '-Infinity', 'abc', '', NULL, '0']) AS s UNION ALL SELECT CAST(param_id AS VARCHAR) FROM run_params)")
def b14(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from text: what is none, NaN or infinite is null."""
    s = values(spark, "s string", *_WRITINGS).unionByName(table(spark, d, "run_params").select(F.col("param_id").cast("string").alias("s")))
    return s.select("s", guards.finite(F.col("s")).alias("number"))


_FEATURES = ["query_candidate_sbert_similarity", "candidate_dense_percentile", "comment_length_log", "idf_weighted_lexical_overlap", "candidate_to_d8_max_similarity", "candidate_novelty_relative_to_d8", "utility"]


@query("b15_finite_features", sql("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (isfinite({c})) AS {c}" for c in _FEATURES) + " FROM candidate_features"))
def b15(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each feature are finite."""
    return table(spark, d, "candidate_features").agg(F.count(F.lit(1)).alias("n"), *[F.count(guards.finite(F.col(c))).alias(c) for c in _FEATURES])


@query("b16_strictly_native", sql("SELECT query_id, comment_id FROM g WHERE NOT fallback AND NOT padding AND NOT same_thread AND (fact IS NOT NULL OR passage IS NOT NULL)", *GRAPH, g=_GRAPH))
def b16(spark: SparkSession, d: str) -> DataFrame:
    """Graph candidates with a native score, neither by fallback nor padding nor of the query's own thread."""
    return graph_run(spark, d).filter(~F.col("fallback") & ~F.col("padding") & ~F.col("same_thread") & (F.size("native") > 0)).select(*PAIR)


@query("b17_eligible_rows", sql("SELECT source_pool, query_id, count(*) AS n FROM pool WHERE source_pool IN ('graph4', 'rrf3') AND dense_rank IS NULL AND query_id IN (SELECT query_id FROM texts WHERE tier = 'deep') GROUP BY ALL", "pool", "texts"))
def b17(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of chosen pools outside the dense list, for a cohort of queries."""
    cohort = t.texts(spark, d).filter("tier = 'deep'").select("query_id")
    rows = t.pool(spark, d).filter(F.col("source_pool").isin("graph4", "rrf3") & F.col("dense_rank").isNull()).join(cohort, "query_id", "left_semi")
    return count_by(rows, source_pool=F.col("source_pool"), query_id=F.col("query_id"))


_SLOTS = {
    "both_routes": "dense_rank IS NOT NULL AND lexical > 0", "dense_only": "dense_rank IS NOT NULL AND coalesce(lexical, 0) = 0", "graph_only": "source_pool = 'graph4' AND dense_rank IS NULL", "useful": "utility >= 5",
    "borderline": "utility BETWEEN 3.5 AND 4.5", "harmless_low": "utility < 3", "novel": "novelty >= 0.5", "unjudged": "utility IS NULL",
}


@query("b18_slot_candidates", sql("SELECT slot, count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT query_id, unnest([" + ", ".join(f"CASE WHEN {c} THEN '{s}' END" for s, c in _SLOTS.items()) + "]) AS slot FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id)) WHERE slot IS NOT NULL GROUP BY 1", "pool", "judged"))
def b18(spark: SparkSession, d: str) -> DataFrame:
    """Which of eight named slots each candidate may fill."""
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    slots = F.array_compact(F.array(*[F.when(F.expr(c), s) for s, c in _SLOTS.items()]))
    return rows.select("query_id", F.explode(slots).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"))


@query("b19_complete_lists", sql("SELECT route, query_id, count(DISTINCT comment_id) = 8 AND count(utility) = 8 AS complete FROM run LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL", "run", "judged"))
def b19(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first eight of each stored list are eight different judged items."""
    top = t.run(spark, d).filter("rank <= 8").join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return top.groupBy(*ranking.KEYS).agg(((F.count_distinct("comment_id") == 8) & (F.count("utility") == 8)).alias("complete"))


@query("b21_forbidden_fields", "SELECT * FROM (VALUES ('comments', 'author'), ('documents', 'author'), ('moderation_labels', 'rater'), ('queries', 'author'), ('reply_references', 'replies.text'), ('submissions', 'author')) x(\"table\", path)")
def b21(spark: SparkSession, d: str) -> DataFrame:
    """Fields, however nested, whose names must not leave a study; found in the schemas."""
    names = {"author", "rater"}
    found = [(n, p) for n in ("comments", "documents", "moderation_labels", "qrels", "queries", "submissions") for p in guards.forbidden_fields(table(spark, d, n).schema, names)]
    found += [("reply_references", p) for p in guards.forbidden_fields(table(spark, d, "reply_references").schema, {"text"})]
    return values(spark, "`table` string, path string", *found)


@query("b22_query_contract", sql("SELECT count(*) AS n, count(DISTINCT query_id) AS ids, true AS guarded FROM queries"))
def b22(spark: SparkSession, d: str) -> DataFrame:
    """A query table whose number of rows and ids are locked: the true numbers pass, others stop."""
    q = table(spark, d, "queries")
    n, ids = q.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    guards.verify_artifact(q, rows=n, ids=("query_id", ids))
    guarded = raises(lambda: guards.verify_artifact(q, rows=n + 1)) and raises(lambda: guards.verify_artifact(q, ids=("query_id", ids - 1)))
    return one_row(spark, n=n, ids=ids, guarded=guarded)


_PATHS = ["queries_validation.json", "queries_test200.json", "HeldOut/q.json", "heldout_run.jsonl", "runs/dense.jsonl"]


def _rejected(spark: SparkSession, *words: str) -> DataFrame:
    return values(spark, "path string, rejected boolean", *[(p, raises(lambda p=p: guards.reject_path(p, words))) for p in _PATHS])


_REJECTED = "SELECT path, regexp_matches(lower(regexp_replace(path, '^.*/', '')), '{w}') AS rejected FROM (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PATHS) + "]) AS path)"


@query("b23_adapter_names", _REJECTED.format(w="test"))
def b23(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, "test")


@query("b25_held_out_names", _REJECTED.format(w="test|heldout"))
def b25(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, "test", "heldout")


@query("b24_configured_paths", "SELECT * FROM (VALUES ('runs.graph.path', 'graph_test.jsonl'), ('qrels', 'heldout/qrels_test.jsonl')) x(key, path)")
def b24(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a nested configuration that name held-out files."""
    config = {"runs": {"dense": {"path": "dense.jsonl", "k": 100}, "graph": {"path": "graph_test.jsonl"}}, "qrels": "heldout/qrels_test.jsonl", "seed": 7, "labels": ["a", "b"]}

    def walk(x, at: str):
        for k, v in x.items():
            if isinstance(v, dict):
                yield from walk(v, f"{at}{k}.")
            elif isinstance(v, str) and raises(lambda v=v: guards.reject_path(v)):
                yield f"{at}{k}", v

    return values(spark, "key string, path string", *walk(config, ""))


@query("b26_blind_payloads", sql("SELECT fault, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(query_text, '')) IN ('', '[deleted]', '[removed]') THEN 'no query text' WHEN trim(coalesce(comment_text, '')) IN ('', '[deleted]', '[removed]') THEN 'no comment text' WHEN regexp_matches(comment_text, '^\\s*https?://\\S+\\s*$') THEN 'link only' ELSE 'fit' END AS fault FROM pool JOIN texts USING (query_id) JOIN notes USING (comment_id)) GROUP BY 1", "pool", "texts", "notes"))
def b26(spark: SparkSession, d: str) -> DataFrame:
    """Which of the pool's pairs may go to a judge, who sees the two texts and nothing else."""
    q, c = t.texts(spark, d).select("query_id", "query_text"), t.comments(spark, d).select("comment_id", "comment_text")
    rows = t.pool(spark, d).select(*PAIR).join(q, "query_id").join(c, "comment_id")
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))).isin(tx.TOMBSTONES)
    return count_by(rows, fault=F.when(none("query_text"), "no query text").when(none("comment_text"), "no comment text").when(F.col("comment_text").rlike(tx.LINK_ONLY), "link only").otherwise("fit"))


@query("b27_exact_pairs", sql("SELECT name, count(*) AS n, count(*) FILTER (query_id IS NULL OR comment_id IS NULL) AS nameless, count(*) - count(DISTINCT (query_id, comment_id)) AS repeated FROM (SELECT 'qrels' AS name, query_id, comment_id FROM qrels UNION ALL SELECT 'candidate_features', query_id, comment_id FROM candidate_features UNION ALL SELECT 'retrieval_runs', query_id, comment_id FROM retrieval_runs WHERE backend = 'dense') GROUP BY 1"))
def b27(spark: SparkSession, d: str) -> DataFrame:
    """Identities of pairs that are missing or repeated, by table."""
    out = None
    for name in ("qrels", "candidate_features", "retrieval_runs"):
        rows = table(spark, d, name)
        rows = rows.filter("backend = 'dense'") if name == "retrieval_runs" else rows
        per = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("c"))
        part = per.agg(F.lit(name).alias("name"), F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("query_id").isNull() | F.col("comment_id").isNull(), F.col("c"))), F.lit(0)).alias("nameless"), (F.sum("c") - F.count(F.lit(1))).alias("repeated"))
        out = part if out is None else out.unionByName(part)
    return out


_LOCKED = {"queries": "query_id", "comments": "comment_id", "documents": "doc_id", "eval_items": "item_id", "run_params": "param_id"}


@query("b30_locked_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, count(DISTINCT {k}) AS ids, count(*) = count(DISTINCT {k}) AS is_key FROM {n}" for n, k in _LOCKED.items()))
def b30(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct ids of each table, as a lock would hold them."""
    out = None
    for n, k in _LOCKED.items():
        part = table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("is_key", F.col("n") == F.col("ids"))


@query("b31_shared_posts", sql("SELECT post, count(DISTINCT query_id) AS queries, count(DISTINCT comment_id) AS comments FROM (SELECT own AS post, query_id, comment_id FROM (SELECT query_id, lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) AS own FROM texts) JOIN (SELECT comment_id, regexp_replace(link_id, '^t[13]_', '') AS post FROM notes SEMI JOIN (SELECT comment_id FROM pool WHERE source_pool = 'graph4') USING (comment_id)) ON own = post) GROUP BY 1", "pool", "texts", "notes"))
def b31(spark: SparkSession, d: str) -> DataFrame:
    """Posts of queries that also lend comments to the graph candidates: held-out posts must not."""
    used = t.pool(spark, d).filter("source_pool = 'graph4'").select("comment_id").distinct()
    c = t.comments(spark, d).join(used, "comment_id", "left_semi").groupBy("link_id").agg(F.count_distinct("comment_id").alias("comments"))
    q = own_links(spark, d).groupBy("link_id").agg(F.count_distinct("query_id").alias("queries"))
    return q.join(c, "link_id").select(tx.bare_id(F.col("link_id")).alias("post"), "queries", "comments")


@query("b32_pool_inputs", sql("SELECT query_id, count(*) AS candidates, count(utility) AS judged, count(DISTINCT source_pool) AS sources, count(*) >= 8 AND count(utility) >= 4 AS usable FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) GROUP BY 1", "pool", "judged"))
def b32(spark: SparkSession, d: str) -> DataFrame:
    """Whether a query's pool is large and judged enough to select from."""
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    n, j = F.count(F.lit(1)), F.count("utility")
    return rows.groupBy("query_id").agg(n.alias("candidates"), j.alias("judged"), F.count_distinct("source_pool").alias("sources"), ((n >= 8) & (j >= 4)).alias("usable"))


_FOLD = "CAST(CAST(('0x' || substr(md5(query_id || '#7#' || repeat), 1, 15)) AS BIGINT) % 5 AS BIGINT)"


@query("b33_training_contract", sql(f"SELECT repeat, fold, count(*) FILTER (f = fold) AS held, count(*) FILTER (f <> fold) AS trained, CAST(0 AS BIGINT) AS both FROM (SELECT query_id, CAST(repeat AS BIGINT) AS repeat, {_FOLD} AS f FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL), (SELECT unnest(range(2)) AS repeat)), (SELECT unnest(range(5)) AS fold) GROUP BY ALL"))
def b33(spark: SparkSession, d: str) -> DataFrame:
    """Training and held-out queries of each fold, and those that are both."""
    f = sampling.folds(table(spark, d, "qrels"), "query_id", 5, 2).withColumnRenamed("fold", "f").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    roles = f.select("repeat", "fold", "query_id", F.when(F.col("f") == F.col("fold"), "held").otherwise("trained").alias("role"))
    leaks = guards.fold_leaks(roles).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("both"))
    n = roles.groupBy("repeat", "fold").agg(F.count_if(F.col("role") == "held").alias("held"), F.count_if(F.col("role") == "trained").alias("trained"))
    return n.join(leaks, ["repeat", "fold"], "left").select(*big("repeat", "fold"), "held", "trained", F.coalesce("both", F.lit(0)).cast("bigint").alias("both"))


@query("b34_fold_identity", sql(f"SELECT repeat, fold, count(*) AS queries, count(DISTINCT query_id) AS ids FROM (SELECT query_id, CAST(repeat AS BIGINT) AS repeat, {_FOLD} AS fold FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL), (SELECT unnest(range(5)) AS repeat)) GROUP BY ALL"))
def b34(spark: SparkSession, d: str) -> DataFrame:
    """Five repeats of five folds, in each of which every query lies once."""
    f = sampling.folds(table(spark, d, "qrels"), "query_id", 5, 5)
    return f.groupBy(*[F.col(c).cast("bigint").alias(c) for c in ("repeat", "fold")]).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("query_id").alias("ids"))


@query("b35_pool_audit", sql("SELECT source_pool, count(*) AS queries, count(*) FILTER (n = 5) AS of_size, count(*) FILTER (j = n) AS judged, count(*) FILTER (r = n) AS ranked FROM (SELECT source_pool, query_id, count(*) AS n, count(utility) AS j, count(dense_rank) AS r FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) GROUP BY ALL) GROUP BY 1", "pool", "judged"))
def b35(spark: SparkSession, d: str) -> DataFrame:
    """Pools by how many queries have the right number of candidates, all of them judged and ranked."""
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    per = rows.groupBy("source_pool", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("utility").alias("j"), F.count("dense_rank").alias("r"))
    return per.groupBy("source_pool").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") == 5).alias("of_size"), F.count_if(F.col("j") == F.col("n")).alias("judged"), F.count_if(F.col("r") == F.col("n")).alias("ranked"))


# lookups


_FIT = "trim(coalesce(comment_text, '')) NOT IN ('', '[deleted]', '[removed]')"


@query("c2_comments_of_stratified_posts", sql(f"SELECT subreddit, year, count(*) AS posts, CAST(sum(n) AS BIGINT) AS comments, CAST(max(n) AS BIGINT) AS largest FROM (SELECT lower(p.subreddit) AS subreddit, {YEAR_SQL.replace('created_utc', 'p.created_utc')} AS year, count(c.comment_id) AS n FROM posts p JOIN notes c ON c.link_id = 't3_' || p.post_id WHERE {_FIT} AND coalesce(c.author, '') NOT IN ({', '.join(repr(b) for b in BOTS)}) GROUP BY p.post_id, 1, 2) GROUP BY ALL", "posts", "notes"))
def c2(spark: SparkSession, d: str) -> DataFrame:
    """Posts with comments at any level, by community and year."""
    c = t.comments(spark, d).filter(~F.trim(F.coalesce("comment_text", F.lit(""))).isin(tx.TOMBSTONES) & ~F.coalesce("author", F.lit("")).isin(BOTS)).groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    p = t.posts(spark, d).select(F.lower("subreddit").alias("subreddit"), year_of("created_utc").alias("year"), F.concat(F.lit("t3_"), "post_id").alias("link_id"))
    return p.join(c, "link_id").groupBy("subreddit", "year").agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("comments"), F.max("n").alias("largest"))


@query("c3_labels_with_first_text", sql("SELECT query_id, scenario, length(query_text) AS chars FROM (SELECT query_id, query_text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at NULLS FIRST, query_text) AS n FROM queries WHERE query_id IS NOT NULL AND trim(query_text) NOT IN ('', '[deleted]', '[removed]')) WHERE n = 1) JOIN (SELECT query_id, scenario FROM texts WHERE scenario IS NOT NULL) USING (query_id)", "texts"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries with the first text that was ever delivered for them."""
    rows = table(spark, d, "queries").filter(F.col("query_id").isNotNull() & ~F.trim("query_text").isin(tx.TOMBSTONES))
    first = setops.latest(rows, ["query_id"], [F.asc_nulls_first("ingested_at"), F.asc("query_text")]).select("query_id", "query_text")
    return t.texts(spark, d).filter("scenario IS NOT NULL").select("query_id", "scenario").join(first, "query_id").select("query_id", "scenario", F.length("query_text").cast("bigint").alias("chars"))


@query("c4_export", sql("SELECT query_id, count(*) AS golds, count(*) FILTER (chars IS NULL) AS without_text, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT query_id, unnest(string_split(ids, '|')) AS comment_id FROM (SELECT query_id, string_agg(comment_id, '|' ORDER BY comment_id) AS ids FROM gold GROUP BY 1)) LEFT JOIN (SELECT comment_id, max(length(comment_text)) AS chars FROM comments WHERE trim(comment_text) NOT IN ('', '[deleted]', '[removed]') GROUP BY 1) USING (comment_id) GROUP BY 1", "gold"))
def c4(spark: SparkSession, d: str) -> DataFrame:
    """Gold comments, stored as ids joined by bars, with the longest text that was delivered for each."""
    stored = t.gold(spark, d).groupBy("query_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("comment_id"))).alias("ids"))
    text = table(spark, d, "comments").filter(~F.trim("comment_text").isin(tx.TOMBSTONES)).groupBy("comment_id").agg(F.max(F.length("comment_text")).cast("bigint").alias("chars"))
    rows = stored.select("query_id", F.explode(F.split("ids", r"\|")).alias("comment_id")).join(text, "comment_id", "left")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("golds"), F.count_if(F.col("chars").isNull()).alias("without_text"), F.sum("chars").alias("chars"))


@query("c7_route_fields", sql("SELECT query_id, comment_id, CAST(r AS BIGINT) AS bm25_rank, round(s, 6) AS bm25_score, round(v, 6) AS bm25_scaled FROM pool LEFT JOIN (SELECT query_id, comment_id, rank AS r, score AS s, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM run WHERE route = 'bm25' WINDOW w AS (PARTITION BY query_id)) USING (query_id, comment_id)", "pool", "run"))
def c7(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's place, score and scaled score in another route's list; null where it is not there."""
    run = t.run(spark, d).filter("route = 'bm25'").select(*PAIR, "rank", "score", ranking.minmax(F.col("score"), ["query_id"], 0.0).alias("v"))
    return t.pool(spark, d).select(*PAIR).join(run, PAIR, "left").select(*PAIR, F.col("rank").cast("bigint").alias("bm25_rank"), r6("score", "bm25_score"), r6("v", "bm25_scaled"))


_LOPO = "SELECT route, query_id, comment_id, rank, CASE WHEN NOT same THEN row_number() OVER (PARTITION BY route, query_id, same ORDER BY rank) END AS lopo FROM (SELECT r.route, r.query_id, r.comment_id, r.rank, coalesce(n.post = x.own, false) AS same FROM run r LEFT JOIN (SELECT comment_id, regexp_replace(link_id, '^t[13]_', '') AS post FROM notes) n USING (comment_id) LEFT JOIN (SELECT query_id, lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) AS own FROM texts) x USING (query_id))"


def lopo_run(spark: SparkSession, d: str) -> DataFrame:
    """The stored runs with each item's place among those that are not of the query's own post, null for the others."""
    posts = t.comments(spark, d).select("comment_id", "link_id")
    own = own_links(spark, d).withColumnRenamed("link_id", "own")
    rows = t.run(spark, d).join(posts, "comment_id", "left").join(own, "query_id", "left")
    rows = rows.withColumn("same", F.coalesce(tx.bare_id(F.col("link_id")) == tx.bare_id(F.col("own")), F.lit(False)))
    placed = ranking.ranked(rows, ["route", "query_id", "same"], ["rank"], "place")
    return placed.select("route", *PAIR, "rank", "score", F.when(~F.col("same"), F.col("place")).alias("lopo"))


@query("c11_raw_and_other_posts", sql("SELECT query_id, comment_id, coalesce(string_agg(route, '|' ORDER BY route) FILTER (rank <= 8), '') AS raw_routes, coalesce(string_agg(route, '|' ORDER BY route) FILTER (lopo <= 8), '') AS other_post_routes FROM l WHERE rank <= 8 OR lopo <= 8 GROUP BY ALL", "run", "notes", "texts", l=_LOPO))
def c11(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the raw lists' first eight and of those without the query's own post, with the routes of either."""
    rows = lopo_run(spark, d).filter("rank <= 8 OR lopo <= 8")
    named = lambda c: F.concat_ws("|", F.array_sort(F.collect_set(F.when(F.col(c) <= 8, F.col("route")))))
    return rows.groupBy(*PAIR).agg(named("rank").alias("raw_routes"), named("lopo").alias("other_post_routes"))


@query("c12_registry_with_new_rows", sql("SELECT batch, count(*) AS n, round(avg(utility), 6) AS utility FROM (SELECT CASE WHEN n > 1 THEN 'again' WHEN judge_model IS NULL THEN 'unknown' ELSE 'first' END AS batch, utility FROM judged JOIN (SELECT query_id, comment_id, count(*) AS n FROM qrels GROUP BY ALL) USING (query_id, comment_id)) GROUP BY 1", "judged"))
def c12(spark: SparkSession, d: str) -> DataFrame:
    """A registry into which later judgments were merged, by the batch a row comes from."""
    n = table(spark, d, "qrels").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    batch = F.when(F.col("n") > 1, "again").when(F.col("judge_model").isNull(), "unknown").otherwise("first")
    return t.judged(spark, d).join(n, PAIR).groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("utility"), "utility"))


@query("c13_systems_of_pairs", sql("SELECT systems, count(*) AS pairs FROM (SELECT string_agg(route, '+' ORDER BY route) AS systems FROM routes WHERE rank <= 8 GROUP BY query_id, comment_id) GROUP BY 1", "routes"))
def c13(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the systems whose first eight hold them."""
    m = setops.memberships(t.routes(spark, d), 8)
    return m.groupBy(F.concat_ws("+", "routes").alias("systems")).agg(F.count(F.lit(1)).alias("pairs"))


_L = "SELECT p.*, utility FROM pool p JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR)


@query("c19_pair_weights", sql("SELECT query_id, n AS pairs, round(1.0 / (count(*) OVER () * n), 9) AS weight FROM (SELECT a.query_id, count(*) AS n FROM l a JOIN l b ON a.query_id = b.query_id AND CAST(round(a.utility * 10000) AS BIGINT) - CAST(round(b.utility * 10000) AS BIGINT) >= 10000 GROUP BY 1)", "pool", "judged", l=_L))
def c19(spark: SparkSession, d: str) -> DataFrame:
    """How many ordered pairs a query gives a pairwise fit, and the weight of each, so that all queries count alike.

    Pairs are counted, not made: for each item those of its query that are at least 1 worse, by a range frame.
    """
    from pyspark.sql import Window as W

    below = F.count(F.lit(1)).over(W.partitionBy("query_id").orderBy("u").rangeBetween(W.unboundedPreceding, -10_000))
    per = labelled(spark, d).select("query_id", F.round(F.col("utility") * 10_000).cast("bigint").alias("u")).withColumn("c", below).groupBy("query_id").agg(F.sum("c").alias("pairs")).filter("pairs > 0")
    total = per.agg(F.count(F.lit(1)).alias("q"))
    return per.crossJoin(F.broadcast(total)).select("query_id", "pairs", F.round(1 / (F.col("q") * F.col("pairs")), 9).alias("weight"))


_SIDES = "SELECT a.query_id, a.utility - b.utility AS du, a.sbert - b.sbert AS ds FROM l a JOIN l b ON a.query_id = b.query_id AND a.source_pool = 'graph4' AND b.source_pool = 'dense50' AND b.dense_rank >= 3 AND abs(a.utility - b.utility) >= 1"


def graph_against_tail(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, du, ds): graph candidates against the tail of the dense list of the same query, which both are a few."""
    l = labelled(spark, d)
    a = l.filter("source_pool = 'graph4'").select("query_id", F.col("utility").alias("ua"), F.col("sbert").alias("sa"))
    b = l.filter("source_pool = 'dense50' AND dense_rank >= 3").select("query_id", F.col("utility").alias("ub"), F.col("sbert").alias("sb"))
    return a.join(b, "query_id").select("query_id", (F.col("ua") - F.col("ub")).alias("du"), (F.col("sa") - F.col("sb")).alias("ds")).filter("abs(du) >= 1")


@query("c20_contest_differences", sql("SELECT query_id, count(*) AS pairs, round(avg(du), 6) AS utility_gap, round(avg(ds), 6) AS similarity_gap FROM s GROUP BY 1", "pool", "judged", l=_L, s=_SIDES))
def c20(spark: SparkSession, d: str) -> DataFrame:
    return graph_against_tail(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("du"), "utility_gap"), r6(F.avg("ds"), "similarity_gap"))


@query("c22_contest_accuracy", sql("SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS pairs, round(avg(a), 6) AS accuracy FROM (SELECT query_id, count(*) AS n, avg(CASE WHEN du * ds > 0 THEN 1.0 ELSE 0.0 END) AS a FROM s GROUP BY 1)", "pool", "judged", l=_L, s=_SIDES))
def c22(spark: SparkSession, d: str) -> DataFrame:
    """How often similarity tells which of a graph and a tail candidate is better, first within queries."""
    per = graph_against_tail(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("du") * F.col("ds") > 0, 1.0).otherwise(0.0)).alias("a"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("pairs"), r6(F.avg("a"), "accuracy"))


_ACTIONS = "SELECT query_id, replaced || '>' || candidate AS action_id, candidate, replaced, cr, br, (uc - ub) / 8 AS reward FROM (SELECT query_id, comment_id AS candidate, place AS cr, utility AS uc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 8 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) LEFT JOIN judged USING (query_id, comment_id) WHERE place <= 4) JOIN (SELECT query_id, comment_id AS replaced, rank AS br, utility AS ub FROM routes LEFT JOIN judged USING (query_id, comment_id) WHERE route = 'sbert' AND rank <= 8) USING (query_id)"


def swap_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    run = t.routes(spark, d)
    return run.filter("route = 'sbert' AND rank <= 8"), setops.exclusives(run, "lexical", 4, ["sbert"], 8), t.judged(spark, d).select(*PAIR, "utility")


@query("c24_action_rows", sql("SELECT query_id, action_id, CAST(cr AS BIGINT) AS candidate_place, CAST(br AS BIGINT) AS replaced_rank, round(reward, 6) AS reward FROM a UNION ALL SELECT DISTINCT query_id, 'NOOP', NULL, NULL, 0.0 FROM routes", "routes", "judged", a=_ACTIONS))
def c24(spark: SparkSession, d: str) -> DataFrame:
    """Every swap of four candidates for eight items, with both places, and doing nothing."""
    base, fresh, judged = swap_inputs(spark, d)
    a = selection.one_swap_actions(base, fresh, judged)
    c = fresh.select("query_id", F.col("comment_id").alias("candidate_id"), F.col("rank").cast("bigint").alias("candidate_place"))
    b = base.select("query_id", F.col("comment_id").alias("replaced_id"), F.col("rank").cast("bigint").alias("replaced_rank"))
    return a.join(c, ["query_id", "candidate_id"], "left").join(b, ["query_id", "replaced_id"], "left").select("query_id", "action_id", "candidate_place", "replaced_rank", r6("reward", "reward"))


@query("c25_action_pools", sql("SELECT pool, count(*) AS actions, count(reward) AS judged, round(max(reward), 6) AS best FROM (SELECT 'any' AS pool, reward FROM a UNION ALL SELECT 'last', reward FROM a WHERE br = 8 UNION ALL SELECT 'first', reward FROM a WHERE cr = 1) GROUP BY 1", "routes", "judged", a=_ACTIONS))
def c25(spark: SparkSession, d: str) -> DataFrame:
    """The same actions in three pools: any, those that replace the last item, those of the first candidate."""
    a = QUERIES["c24_action_rows"](spark, d).filter("action_id <> 'NOOP'")
    pools = F.array_compact(F.array(F.lit("any"), F.when(F.col("replaced_rank") == 8, "last"), F.when(F.col("candidate_place") == 1, "first")))
    return a.select(F.explode(pools).alias("pool"), "reward").groupBy("pool").agg(F.count(F.lit(1)).alias("actions"), F.count("reward").alias("judged"), F.max("reward").alias("best"))


# sets


@query("d2_stable_unique_pool", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, comment_id) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, min(coalesce(dense_rank, 1000)) AS p FROM candidate_features WHERE comment_id IS NOT NULL GROUP BY ALL)"))
def d2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_features").withColumn("at", F.coalesce("dense_rank", F.lit(1000)))
    return setops.stable_unique(rows, ["query_id"], "comment_id", "at").select(*PAIR, *big("rank"))


@query("d8_label_coverage", sql("SELECT label, count(*) AS pairs, count(u) AS known, count(*) - count(u) AS missing FROM (SELECT DISTINCT 'run8' AS label, query_id, comment_id FROM run WHERE rank <= 8 UNION ALL SELECT DISTINCT 'run20', query_id, comment_id FROM run WHERE rank <= 20 UNION ALL SELECT 'pool', query_id, comment_id FROM pool) LEFT JOIN (SELECT query_id, comment_id, 1 AS u FROM judged WHERE utility IS NOT NULL) USING (query_id, comment_id) GROUP BY 1", "run", "pool", "judged"))
def d8(spark: SparkSession, d: str) -> DataFrame:
    """Of three sets of pairs how many have a known utility."""
    run, known = t.run(spark, d), t.judged(spark, d).filter("utility IS NOT NULL")
    sets = run.filter("rank <= 8").select(F.lit("run8").alias("label"), *PAIR).unionByName(run.filter("rank <= 20").select(F.lit("run20").alias("label"), *PAIR)).unionByName(t.pool(spark, d).select(F.lit("pool").alias("label"), *PAIR))
    return setops.coverage(sets, known, ["label"]).select("label", "pairs", F.col("judged").alias("known"), "missing")


_G4 = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, comment_id) AS place FROM (SELECT query_id, comment_id, greatest(coalesce(fact, 0), coalesce(passage, 0)) AS s FROM g)"


@query("d10_graph_views", sql(f"SELECT 'fixed' AS view, query_id, comment_id, CAST(place AS BIGINT) AS place FROM ({_G4}) WHERE place <= 4 UNION ALL SELECT 'residual', query_id, comment_id, CAST(place AS BIGINT) FROM ({_G4.replace('FROM g)', 'FROM g2)')}) WHERE place <= 4", "routes", *GRAPH, g=_GRAPH, g2="SELECT * FROM g ANTI JOIN (SELECT query_id, comment_id FROM routes WHERE route = 'sbert' AND rank <= 4) USING (query_id, comment_id)"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    """Four graph candidates of each query, and four of those that the dense list's head does not have."""
    g = graph_run(spark, d).select(*PAIR, F.greatest(F.coalesce(F.col("native")["fact"], F.lit(0.0)), F.coalesce(F.col("native")["passage"], F.lit(0.0))).alias("score"))
    head = t.routes(spark, d).filter("route = 'sbert' AND rank <= 4").select(*PAIR)
    views = {"fixed": g, "residual": g.join(head, PAIR, "left_anti")}
    out = None
    for name, v in views.items():
        part = ranking.top_k(v, ["query_id"], [F.desc("score"), "comment_id"], 4, "place").select(F.lit(name).alias("view"), *PAIR, *big("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query("d11_coverage_by_band", sql("SELECT route, band, count(*) AS pairs, count(j) AS judged FROM (SELECT route, query_id, comment_id, CASE WHEN rank <= 8 THEN 'head' WHEN rank <= 20 THEN 'middle' ELSE 'deep' END AS band FROM run WHERE rank <= 50) LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) GROUP BY ALL", "run", "judged"))
def d11(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs of each route by the band of their rank."""
    rows = t.run(spark, d).filter("rank <= 50").withColumn("band", ranking.rank_band(F.col("rank"), [(1, 8, "head"), (9, 20, "middle"), (21, 50, "deep")]))
    return setops.coverage(rows, t.judged(spark, d), ["route", "band"]).select("route", "band", "pairs", "judged")


@query("d14_residual_by_scope", sql("SELECT scope, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM (SELECT DISTINCT unnest(['all', route]) AS scope, query_id, comment_id FROM run WHERE rank <= 20 AND (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM judged)) GROUP BY 1", "run", "judged"))
def d14(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged pairs of the first twenty, by route and over all, each once."""
    rows = t.run(spark, d).filter("rank <= 20").join(t.judged(spark, d).select(*PAIR), PAIR, "left_anti")
    scoped = rows.select(F.explode(F.array(F.lit("all"), F.col("route"))).alias("scope"), *PAIR).distinct()
    return scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("queries"))


@query("d15_residual_rows", sql("SELECT query_id, comment_id, length(query_text) AS query_chars, length(comment_text) AS comment_chars FROM pool ANTI JOIN (SELECT query_id, comment_id FROM judged) USING (query_id, comment_id) LEFT JOIN texts USING (query_id) LEFT JOIN notes USING (comment_id)", "pool", "judged", "texts", "notes"))
def d15(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged candidates with the sizes of the texts that a judge would read."""
    q, c = t.texts(spark, d).select("query_id", "query_text"), t.comments(spark, d).select("comment_id", "comment_text")
    rows = setops.residual(t.pool(spark, d), t.judged(spark, d)).join(q, "query_id", "left").join(c, "comment_id", "left")
    return rows.select(*PAIR, F.length("query_text").cast("bigint").alias("query_chars"), F.length("comment_text").cast("bigint").alias("comment_chars"))


def _digest_sql(source: str, *columns: str) -> str:
    """SELECT of (digest, n) of the set of rows; columns must be in the order of their names."""
    text = " || chr(31) || ".join(f"coalesce(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), chr(31), '\\u'), '\\N')" for c in columns)
    parts = " || ' ' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(8))
    return f"SELECT sha256(CAST(count(*) AS VARCHAR) || ' ' || {parts}) AS digest, count(*) AS n FROM (SELECT DISTINCT sha256({text}) AS h FROM {source})"


_DIGESTS = {"queries": ["query_id", "scenario", "source", "tier"], "qrels": ["comment_id", "judge_model", "label_safety", "query_id"], "retrieval_runs": ["backend", "comment_id", "query_id", "rank_pos"]}


@query("d18_set_digests", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", digest, n FROM ({_digest_sql(n, *c)})" for n, c in _DIGESTS.items()))
def d18(spark: SparkSession, d: str) -> DataFrame:
    """Digests of tables as sets of rows."""
    out = None
    for n, c in _DIGESTS.items():
        part = setops.set_digest(table(spark, d, n), c).select(F.lit(n).alias("table"), "digest", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("d19_pair_digests", _digest_sql("qrels", "comment_id", "query_id"))
def d19(spark: SparkSession, d: str) -> DataFrame:
    return setops.set_digest(table(spark, d, "qrels"), PAIR)


@query("d20_table_digest", _digest_sql("comments", "author", "comment_id", "comment_text", "created_utc", "link_id", "parent_id", "score", "source"))
def d20(spark: SparkSession, d: str) -> DataFrame:
    """Of a whole table, whatever the order of its rows and columns."""
    rows = table(spark, d, "comments").drop("ingested_at")
    return setops.set_digest(rows, list(reversed(rows.columns)))


@query("d21_csv_digest", _digest_sql("run_params", "param_id", "param_name", "purpose"))
def d21(spark: SparkSession, d: str) -> DataFrame:
    """Of a table that went through CSV: it is the same set."""
    from rankloom.base import shared_folder
    from rankloom.sources import io

    folder = shared_folder(spark, "csv")
    io.write_csv(table(spark, d, "run_params").repartition(3), folder, ["purpose", "param_id", "param_name"])
    return setops.set_digest(io.read_csv(spark, folder), ["param_id", "param_name", "purpose"])


_DONE = "SELECT route, query_id, count(DISTINCT comment_id) = 8 AND count(utility) = 8 AS ok FROM routes LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL"


def completeness(spark: SparkSession, d: str) -> DataFrame:
    top = t.routes(spark, d).filter("rank <= 8").join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return top.groupBy(*ranking.KEYS).agg(((F.count_distinct("comment_id") == 8) & (F.count("utility") == 8)).alias("ok"))


@query("d24_contrast_coverage", sql("SELECT a.route || '-' || b.route AS contrast, count(*) AS queries, count(*) FILTER (a.ok) AS \"left\", count(*) FILTER (b.ok) AS \"right\", count(*) FILTER (a.ok AND b.ok) AS joint FROM c a JOIN c b ON a.query_id = b.query_id AND a.route < b.route GROUP BY 1", "routes", "judged", c=_DONE))
def d24(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of systems the queries whose lists are complete on one side, the other, and both."""
    per = completeness(spark, d).groupBy("query_id").pivot("route", ["length", "lexical", "sbert"]).agg(F.first("ok"))
    out = None
    for a, b in (("length", "lexical"), ("length", "sbert"), ("lexical", "sbert")):
        have = per.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        part = have.agg(F.lit(f"{a}-{b}").alias("contrast"), F.count(F.lit(1)).alias("queries"), F.count_if(a).alias("left"), F.count_if(b).alias("right"), F.count_if(F.col(a) & F.col(b)).alias("joint"))
        out = part if out is None else out.unionByName(part)
    return out


@query("d25_complete_queries", sql("SELECT route, count(*) AS queries, count(*) FILTER (ok) AS complete FROM c GROUP BY 1", "routes", "judged", c=_DONE))
def d25(spark: SparkSession, d: str) -> DataFrame:
    return completeness(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("queries"), F.count_if("ok").alias("complete"))

