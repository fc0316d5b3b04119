"""Queries of sources and sinks: tables are written to the shared folder in each format and read back."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import shared_folder, table
from rankloom.functions import text as tx
from rankloom.operators import guards, ranking, setops
from rankloom.sources import io

from . import tables as t
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


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def raises(f: Callable) -> bool:
    """Whether the call breaks its contract, as Spark or the library says."""
    try:
        f()
    except Exception:
        return True
    return False


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))


# dumps


@query("a1_dump_of_comments", sql("SELECT source, count(*) AS n, count(comment_text) AS texts, CAST(sum(score) AS BIGINT) AS score, CAST(sum(length(comment_text)) AS BIGINT) AS chars FROM comments GROUP BY 1"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    """All stored comments as zstd-compressed JSON lines and back."""
    paths = io.write_zstd_jsonl(table(spark, d, "comments"), shared_folder(spark, "dump"))
    back = io.read_zstd_jsonl(spark, paths, "comment_id string, comment_text string, score int, source string")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("comment_text").alias("texts"), F.sum("score").alias("score"), F.sum(F.length("comment_text")).alias("chars"))


@query("a2_dump_of_posts", sql("SELECT post_id, count(*) AS deliveries, CAST(max(n_comments) AS BIGINT) AS n_comments FROM submissions WHERE is_self GROUP BY 1"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    """A dump with broken lines, which are skipped."""
    rows = table(spark, d, "submissions")
    folder = shared_folder(spark, "dump")
    paths = io.write_zstd_jsonl(rows, folder)
    import zstandard

    with io.opened(f"{folder}/broken.jsonl.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(b'{"post_id": "x", "is_self": tr\nnot json\n\n'))
    back = io.read_zstd_jsonl(spark, [*paths, f"{folder}/broken.jsonl.zst"], "post_id string, is_self boolean, n_comments int")
    return back.filter("is_self").groupBy("post_id").agg(F.count(F.lit(1)).alias("deliveries"), F.max("n_comments").cast("bigint").alias("n_comments"))


_OWN = "'t3_' || lower(trim(regexp_replace(post_id, '(?i)^t[13]_', '')))"


def own_links(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, link_id): the thread of each query's own post."""
    return t.texts(spark, d).select("query_id", F.concat(F.lit("t3_"), F.lower(F.trim(F.regexp_replace("post_id", "(?i)^t[13]_", "")))).alias("link_id"))


@query("a3_wanted_threads", sql(f"SELECT link_id, count(*) AS n FROM comments WHERE link_id IN (SELECT {_OWN} FROM texts WHERE post_id IS NOT NULL) GROUP BY 1", "texts"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    """Of a dump only the threads of the queries' posts."""
    paths = io.write_zstd_jsonl(table(spark, d, "comments").select("comment_id", "link_id"), shared_folder(spark, "dump"))
    wanted = own_links(spark, d).filter("link_id IS NOT NULL").select("link_id").distinct()
    return io.read_zstd_jsonl(spark, paths, "comment_id string, link_id string").join(wanted, "link_id", "left_semi").groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))


# tables


@query("a4_table_or_csv", sql("SELECT stem, count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT 'parquet' AS stem, query_id FROM qrels UNION ALL SELECT 'csv', query_id FROM qrels WHERE query_id IS NOT NULL UNION ALL SELECT 'preview', query_id FROM (SELECT query_id FROM qrels WHERE query_id IS NOT NULL ORDER BY query_id LIMIT 50)) GROUP BY 1"))
def a4(spark: SparkSession, d: str) -> DataFrame:
    """The parquet table first, then the whole CSV, then its preview."""
    folder = shared_folder(spark, "tables")
    rows = table(spark, d, "qrels").select("query_id", "comment_id", "utility")
    some = rows.filter("query_id IS NOT NULL")
    rows.write.parquet(f"{folder}/parquet.parquet")
    io.write_csv(some, f"{folder}/csv.csv")
    io.write_csv(some.limit(7), f"{folder}/csv_preview.csv")
    io.write_csv(some.orderBy("query_id").limit(50), f"{folder}/preview_preview.csv")
    parts = None
    for stem in ("parquet", "csv", "preview"):
        part = io.read_table(spark, folder, stem).select(F.lit(stem).alias("stem"), "query_id")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"))


@query("a5_strict_lines", sql("SELECT judge_model, validation_status, count(*) AS n, round(sum(utility), 4) AS total, true AS strict FROM qrels GROUP BY ALL"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines that are read strictly: a broken line stops the read."""
    folder = shared_folder(spark, "lines")
    io.write_jsonl(table(spark, d, "qrels"), f"{folder}/good")
    spark.createDataFrame([('{"judge_model": "x"',)], "value string").write.text(f"{folder}/bad")
    schema = "judge_model string, validation_status string, utility double"
    strict = raises(lambda: io.read_jsonl(spark, f"{folder}/bad", schema).collect()) and not io.read_jsonl(spark, f"{folder}/bad", schema, strict=False).filter("judge_model IS NOT NULL").head(1)
    return io.read_jsonl(spark, f"{folder}/good", schema).groupBy("judge_model", "validation_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("utility"), 4).alias("total")).withColumn("strict", F.lit(strict))


@query("a6_csv_of_strings", sql("SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '')"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, commas and line ends in CSV and back; every field is a string."""
    folder = shared_folder(spark, "csv")
    rows = table(spark, d, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("code"), F.regexp_replace("text", r"[\r\n]+", "\n").alias("text")).filter("text <> ''")
    io.write_csv(rows, folder)
    back = io.read_csv(spark, folder)
    assert dict(back.dtypes) == {"doc_id": "string", "code": "string", "text": "string"}
    text = F.unbase64("code").cast("string")
    return back.select("doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest")).distinct()


@query("a7_table_with_preview", sql("SELECT count(*) AS n, least(50, count(*)) AS preview, 5 AS columns FROM queries"))
def a7(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "table")
    io.write_table(table(spark, d, "queries").select("query_id", "source", "scenario", "tier", F.array("tier", "scenario").alias("both")), folder, "q")
    n, preview = spark.read.parquet(f"{folder}/q.parquet"), io.read_csv(spark, f"{folder}/q_preview.csv")
    return n.agg(F.count(F.lit(1)).alias("n")).crossJoin(preview.agg(F.count(F.lit(1)).alias("preview"))).withColumn("columns", F.lit(len(preview.columns)).cast("bigint"))


@query("a8_sorted_lines", sql("SELECT md5('{\"comment_id\":\"' || comment_id || '\",\"query_id\":\"' || query_id || '\",\"rank_pos\":' || rank_pos || '}') AS digest, count(*) AS n FROM retrieval_runs WHERE query_id IS NOT NULL AND comment_id IS NOT NULL AND rank_pos IS NOT NULL GROUP BY 1"))
def a8(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines have their fields in the order of the names."""
    folder = shared_folder(spark, "lines")
    io.write_jsonl(table(spark, d, "retrieval_runs").select("rank_pos", "query_id", "comment_id").dropna(), folder)
    return spark.read.text(folder).groupBy(F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("a9_csv_fields", sql("SELECT 'tier,query_id' AS header, count(*) AS n, count(nullif(tier, '')) AS tiers FROM queries WHERE query_id IS NOT NULL"))
def a9(spark: SparkSession, d: str) -> DataFrame:
    """CSV with stated fields in their order; others are left out."""
    folder = shared_folder(spark, "csv")
    io.write_csv(table(spark, d, "queries").filter("query_id IS NOT NULL"), folder, ["tier", "query_id"])
    back = io.read_csv(spark, folder)
    return back.agg(F.lit(",".join(back.columns)).alias("header"), F.count(F.lit(1)).alias("n"), F.count("tier").alias("tiers"))


@query("a10_manifest", sql("SELECT 'queries' AS name, count(*) AS n, count(DISTINCT query_id) AS ids FROM queries"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    """One sorted JSON document with counts."""
    n = table(spark, d, "queries").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("ids")).first()
    path = f"{shared_folder(spark, 'manifest')}/manifest.json"
    io.write_manifest(path, {"name": "queries", **n.asDict()})
    held = io.read_manifest(path)
    assert list(held) == sorted(held)
    return one_row(spark, **{k: held[k] for k in ("name", "n", "ids")})


@query("a11_create_only", sql("SELECT count(*) AS n, true AS refused FROM eval_items"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    """A sink that never replaces an earlier record."""
    folder = shared_folder(spark, "once")
    items = table(spark, d, "eval_items")
    io.write_jsonl(items, folder, create_only=True)
    refused = raises(lambda: io.write_jsonl(items.limit(0), folder, create_only=True))
    return spark.read.json(folder, "item_id long").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("a12_replaced_manifest", sql("SELECT max(param_id) AS last, CAST(count(*) AS BIGINT) AS writes FROM (SELECT CAST(param_id AS BIGINT) AS param_id FROM run_params WHERE param_id IS NOT NULL)"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    """A document written several times under one name: the last one stands there, whole."""
    path = f"{shared_folder(spark, 'manifest')}/state.json"
    ids = [r[0] for r in table(spark, d, "run_params").filter("param_id IS NOT NULL").orderBy("param_id").select("param_id").collect()]
    for n, i in enumerate(ids):
        io.write_manifest(path, {"last": i, "writes": n + 1})
    return one_row(spark, **io.read_manifest(path))


@query("a13_three_formats", sql("SELECT format, count(*) AS n, count(DISTINCT query_id) AS queries, CAST(sum(len(replies)) AS BIGINT) AS replies FROM reply_references, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS format) GROUP BY 1"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows as CSV with JSON text, JSON lines and parquet."""
    folder = shared_folder(spark, "dataset")
    rows = table(spark, d, "reply_references").withColumn("fetched_at", F.col("fetched_at").cast("string"))
    io.write_dataset(rows, folder, "r", "query_id")
    kind = dict(rows.dtypes)["replies"]
    parts = {
        "csv": io.read_csv(spark, f"{folder}/r.csv").select("query_id", F.from_json("replies", kind).alias("replies")),
        "jsonl": spark.read.schema(f"query_id string, replies {kind}").json(f"{folder}/r.jsonl"), "parquet": spark.read.parquet(f"{folder}/r.parquet"),
    }
    out = None
    for name, p in parts.items():
        part = p.agg(F.lit(name).alias("format"), F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"), F.sum(F.when(F.col("replies").isNotNull(), F.size("replies"))).alias("replies"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a15_rated_cards", sql("SELECT split_name, count(*) AS cards, count(*) FILTER (rating = 1) AS answerable, CAST(sum(length(question)) AS BIGINT) AS chars FROM (SELECT split_name, question, CAST(answerable AS INT) AS rating FROM eval_items) GROUP BY 1"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    """A store of rated cards in SQLite: cards, their questions, and of the ratings the last of each card."""
    import sqlite3

    items = table(spark, d, "eval_items").collect()  # of fixed size
    path = f"{shared_folder(spark, 'store')}/store.sqlite"
    with contextlib.closing(sqlite3.connect(":memory:")) as c:
        c.executescript("CREATE TABLE questions (id INT, text TEXT); CREATE TABLE cards (id INT, question_id INT, split TEXT); CREATE TABLE ratings (n INTEGER PRIMARY KEY, card_id INT, rating_json TEXT)")
        c.executemany("INSERT INTO questions VALUES (?, ?)", [(r.item_id, r.question) for r in items])
        c.executemany("INSERT INTO cards VALUES (?, ?, ?)", [(r.item_id, r.item_id, r.split_name) for r in items])
        c.executemany("INSERT INTO ratings (card_id, rating_json) VALUES (?, ?)", [(r.item_id, '{"answerable": 7}') for r in items] + [(r.item_id, f'{{"answerable": {int(bool(r.answerable))}}}') for r in items])
        c.commit()
        with io.opened(path, "wb") as f:
            f.write(c.serialize())
    cards = io.read_sqlite(spark, path, "SELECT c.id, c.split, q.text, r.n, r.rating_json FROM cards c JOIN questions q ON q.id = c.question_id JOIN ratings r ON r.card_id = c.id", "id bigint, split string, text string, n bigint, rating_json string")
    last = setops.latest(cards, ["id"], [F.desc("n")]).withColumn("rating", F.from_json("rating_json", "answerable int")["answerable"])
    return last.groupBy(F.col("split").alias("split_name")).agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("rating") == 1).alias("answerable"), F.sum(F.length("text")).alias("chars"))


@query("a16_nodes", sql("SELECT kind, count(*) AS nodes FROM (SELECT DISTINCT 'comment' AS kind, 't1_' || comment_id AS node FROM comments WHERE comment_id IS NOT NULL UNION SELECT DISTINCT 'post', link_id FROM comments WHERE link_id IS NOT NULL) GROUP BY 1"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a graph from a CSV table, where there is no parquet one."""
    folder = shared_folder(spark, "graph")
    c = table(spark, d, "comments")
    nodes = c.select(F.lit("comment").alias("kind"), F.concat(F.lit("t1_"), "comment_id").alias("node")).unionByName(c.select(F.lit("post").alias("kind"), F.col("link_id").alias("node"))).filter("node IS NOT NULL").distinct()
    io.write_csv(nodes, f"{folder}/nodes.csv")
    return io.read_table(spark, folder, "nodes").groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@query("a17_text_lookup", sql("SELECT comment_id, length(regexp_replace(comment_text, '[\\r\\n]+', ' ', 'g')) AS chars FROM notes WHERE trim(comment_text) NOT IN ('', '[deleted]', '[removed]')", "notes"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts from a wide CSV table, of which only these columns are read."""
    folder = shared_folder(spark, "csv")
    rows = t.comments(spark, d).filter(~F.trim("comment_text").isin(tx.TOMBSTONES)).withColumn("comment_text", F.hex(F.regexp_replace("comment_text", r"[\r\n]+", " ")))
    io.write_csv(rows, folder)
    return io.read_csv(spark, folder, ["comment_id", "comment_text"], line_ends=False).select("comment_id", F.length(F.unhex("comment_text").cast("string")).cast("bigint").alias("chars"))


# runs


def nested(spark: SparkSession, d: str, depth: int = 100) -> DataFrame:
    """(query_id, retrieved_titles, retrieved_scores) of the dense route."""
    top = t.run(spark, d).filter((F.col("route") == "dense") & (F.col("rank") <= depth)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "comment_id", "score"))).alias("l"))
    return top.select("query_id", F.col("l.comment_id").alias("retrieved_titles"), F.col("l.score").alias("retrieved_scores"))


@query("a18_official_run", sql("SELECT query_id, count(*) AS n, count(DISTINCT comment_id) AS items, false AS repeated FROM (SELECT * FROM run WHERE route = 'dense' AND rank <= 50) GROUP BY 1", "run"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    """A nested run in JSON lines; repeated ids in an array would be marked."""
    folder = shared_folder(spark, "run")
    io.write_jsonl(nested(spark, d, 50), folder)
    back = io.read_jsonl(spark, folder, "query_id string, retrieved_titles array<string>, retrieved_scores array<double>")
    n = F.size("retrieved_titles").cast("bigint")
    items = F.size(F.array_distinct("retrieved_titles")).cast("bigint")
    return back.select("query_id", n.alias("n"), items.alias("items"), (n != items).alias("repeated"))


@query("a22_run_with_fallbacks", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, comment_id) AS BIGINT) AS rank, round(coalesce(score, 0.0), 6) AS score FROM (SELECT query_id, comment_id, min(rank_pos) AS place, max(score) AS score FROM retrieval_runs WHERE backend = 'bm25' AND query_id IS NOT NULL AND comment_id IS NOT NULL GROUP BY ALL)"))
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose score may be named otherwise or be missing, which is 0; in the order (rank, id)."""
    rows = table(spark, d, "retrieval_runs").filter("backend = 'bm25' AND query_id IS NOT NULL AND comment_id IS NOT NULL").groupBy(*PAIR).agg(F.min("rank_pos").alias("rank"), F.max("score").alias("raw_score"))
    run = io.tolerant_run(rows.withColumnsRenamed({"query_id": "qid", "comment_id": "cid"}), "bm25").withColumnRenamed("rank", "was")
    return ranking.ranked(run, ranking.KEYS, ["was", "comment_id"]).select(*PAIR, *big("rank"), r6("score", "score"))


#: Rows of graph candidates with two routes' native scores and flags of where they come from.
_GRAPH = "SELECT query_id, comment_id, CASE WHEN lexical > 0 THEN lexical END AS fact, CASE WHEN novelty > 0 THEN novelty END AS passage, coalesce(sbert, 0.0) < 0.2 AS fallback, dense_rank IS NOT NULL AS callback, length IS NULL AS padding, coalesce(n.post = x.own, false) AS same_thread FROM pool LEFT JOIN (SELECT comment_id, regexp_replace(link_id, '^t[13]_', '') AS post FROM notes) n USING (comment_id) LEFT JOIN (SELECT query_id, lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) AS own FROM texts) x USING (query_id) WHERE source_pool = 'graph4'"
GRAPH = ("pool", "notes", "texts")


def graph_run(spark: SparkSession, d: str) -> DataFrame:
    """Graph candidates as a graph run stores them: a map of the native routes' scores, and provenance."""
    posts = t.comments(spark, d).select("comment_id", tx.bare_id(F.col("link_id")).alias("post"))
    own = own_links(spark, d).select("query_id", tx.bare_id(F.col("link_id")).alias("own"))
    rows = t.pool(spark, d).filter("source_pool = 'graph4'").join(posts, "comment_id", "left").join(own, "query_id", "left")
    scores = F.map_from_entries(F.array_compact(F.array(F.when(F.col("lexical") > 0, F.struct(F.lit("fact").alias("k"), F.col("lexical").alias("v"))), F.when(F.col("novelty") > 0, F.struct(F.lit("passage").alias("k"), F.col("novelty").alias("v"))))))
    return rows.select(*PAIR, scores.alias("native"), (F.coalesce("sbert", F.lit(0.0)) < 0.2).alias("fallback"), F.col("dense_rank").isNotNull().alias("callback"), F.col("length").isNull().alias("padding"), F.coalesce(F.col("post") == F.col("own"), F.lit(False)).alias("same_thread"))


@query("a23_graph_ranks", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, round(coalesce(1.0 / (60 + f), 0) + coalesce(1.0 / (60 + p), 0), 9) AS score FROM (SELECT query_id, comment_id, CASE WHEN fact IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, fact IS NULL ORDER BY fact DESC, comment_id) END AS f, CASE WHEN passage IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, passage IS NULL ORDER BY passage DESC, comment_id) END AS p FROM g))", *GRAPH, g=_GRAPH))
def a23(spark: SparkSession, d: str) -> DataFrame:
    """A graph run ranked anew by the fused ranks of its native routes."""
    g = graph_run(spark, d)
    each = ranking.ranked(g.select(*PAIR, F.explode("native").alias("route", "score")), ["query_id", "route"], [F.desc("score"), "comment_id"])
    fused = each.groupBy(*PAIR).agg(F.sum(1 / (60 + F.col("rank"))).alias("s"))
    all_ = g.select(*PAIR).join(fused, PAIR, "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)), 9))
    return ranking.ranked(all_, ["query_id"], [F.desc("s"), "comment_id"]).select(*PAIR, *big("rank"))


@query("a24_dense_coverage", sql("SELECT query_id, count(*) AS n, count(score) AS scored, count(DISTINCT comment_id) = 20 AS whole FROM (SELECT query_id, comment_id, max(score) AS score FROM retrieval_runs WHERE backend = 'dense' AND rank_pos <= 20 GROUP BY ALL) GROUP BY 1"))
def a24(spark: SparkSession, d: str) -> DataFrame:
    """How much of a backend's scored list of 20 each query has."""
    rows = table(spark, d, "retrieval_runs").filter("backend = 'dense' AND rank_pos <= 20").groupBy(*PAIR).agg(F.max("score").alias("score"))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), (F.count_distinct("comment_id") == 20).alias("whole"))


@query("a25_graph_scores", sql("SELECT query_id, comment_id, round((coalesce(a, 0) + coalesce(b, 0)) / 2, 6) AS score FROM (SELECT query_id, comment_id, CASE WHEN max(fact) OVER w <= min(fact) OVER w THEN CASE WHEN fact IS NOT NULL THEN 0.0 END ELSE (fact - min(fact) OVER w) / (max(fact) OVER w - min(fact) OVER w) END AS a, CASE WHEN max(passage) OVER w <= min(passage) OVER w THEN CASE WHEN passage IS NOT NULL THEN 0.0 END ELSE (passage - min(passage) OVER w) / (max(passage) OVER w - min(passage) OVER w) END AS b FROM g WINDOW w AS (PARTITION BY query_id))", *GRAPH, g=_GRAPH))
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Each native route's scores scaled within the query, and their mean over the two routes; an absent one counts 0."""
    g = graph_run(spark, d)
    each = g.select(*PAIR, F.explode("native").alias("route", "score"))
    scaled = each.select(*PAIR, ranking.minmax(F.col("score"), ["query_id", "route"], 0.0).alias("v")).groupBy(*PAIR).agg(F.sum("v").alias("v"))
    return g.select(*PAIR).join(scaled, PAIR, "left").select(*PAIR, r6(F.coalesce("v", F.lit(0.0)) / 2, "score"))


@query("a26_graph_provenance", sql("SELECT fault, count(*) AS n FROM (SELECT unnest([CASE WHEN fallback THEN 'fallback' END, CASE WHEN callback THEN 'callback' END, CASE WHEN padding THEN 'padding' END, CASE WHEN same_thread THEN 'same_thread' END, CASE WHEN fact IS NULL AND passage IS NULL THEN 'not_native' END]) AS fault FROM g) WHERE fault IS NOT NULL GROUP BY 1", *GRAPH, g=_GRAPH))
def a26(spark: SparkSession, d: str) -> DataFrame:
    """What would stop a graph run at the gate of its provenance, by fault."""
    marks = [F.when(F.col(c), c) for c in ("fallback", "callback", "padding", "same_thread")]
    faults = F.array_compact(F.array(*marks, F.when(F.size("native") == 0, "not_native")))
    return graph_run(spark, d).select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("a27_repeated_pairs", sql("SELECT query_id, comment_id, count(*) AS n, count(DISTINCT utility) AS utilities FROM candidate_features GROUP BY ALL HAVING count(*) > 1"))
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that a registry of utilities holds more than once, for which it would be rejected."""
    return table(spark, d, "candidate_features").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("utility").alias("utilities")).filter("n > 1")


@query("a28_cohort_ranks", sql("SELECT route, query_id, count(*) AS n, CAST(max(rank) AS BIGINT) AS deepest, count(*) = max(rank) AS sound FROM run WHERE query_id IN (SELECT query_id FROM texts WHERE use_bucket = 'query_candidate') GROUP BY ALL", "run", "texts"))
def a28(spark: SparkSession, d: str) -> DataFrame:
    """The runs of a cohort: how deep each list is and whether its ranks are 1 to n."""
    cohort = t.texts(spark, d).filter("use_bucket = 'query_candidate'").select("query_id")
    return t.run(spark, d).join(cohort, "query_id", "left_semi").groupBy(*ranking.KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("bigint").alias("deepest"), (F.count(F.lit(1)) == F.max("rank")).alias("sound"))


@query("a29_short_lists", sql("SELECT backend, query_id, count(DISTINCT comment_id) AS items, min(model_id) AS model_id FROM retrieval_runs WHERE query_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT comment_id) < 100"))
def a29(spark: SparkSession, d: str) -> DataFrame:
    """Lists with fewer than a hundred different items, with what else their rows carry."""
    rows = table(spark, d, "retrieval_runs").filter("query_id IS NOT NULL")
    return rows.groupBy("backend", "query_id").agg(F.count_distinct("comment_id").alias("items"), F.min("model_id").alias("model_id")).filter("items < 100")


@query("a30_entered_queries", sql("SELECT x.query_id, count(c) AS n, round(coalesce(sum(s), 0.0), 6) AS total FROM (SELECT query_id, count(*) FILTER (fact IS NOT NULL) AS facts FROM g GROUP BY 1) x LEFT JOIN (SELECT query_id, comment_id AS c, greatest(coalesce(fact, 0), coalesce(passage, 0)) AS s FROM g WHERE greatest(coalesce(fact, 0), coalesce(passage, 0)) > 0.1) y ON x.query_id = y.query_id AND facts > 0 GROUP BY 1", *GRAPH, g=_GRAPH))
def a30(spark: SparkSession, d: str) -> DataFrame:
    """Of a route only rows of positive score; a query that no fact entered has an empty list."""
    g = graph_run(spark, d).withColumn("s", F.greatest(F.coalesce(F.col("native")["fact"], F.lit(0.0)), F.coalesce(F.col("native")["passage"], F.lit(0.0))))
    facts = g.groupBy("query_id").agg(F.count_if(F.col("native")["fact"].isNotNull()).alias("facts"))
    rows = g.filter("s > 0.1").join(facts.filter("facts > 0"), "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))
    return facts.select("query_id").join(rows, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("total", F.lit(0.0)), "total"))


@query("a31_predictions_by_any_name", sql("SELECT query_id, CAST(rank AS BIGINT) AS rank, comment_id FROM run WHERE route = 'dense' AND rank <= 10", "run"))
def a31(spark: SparkSession, d: str) -> DataFrame:
    """Predictions whose fields are named in one of several ways, row by row."""
    n = nested(spark, d, 10)
    odd = F.pmod(F.xxhash64("query_id"), F.lit(3))
    rows = n.select(*[F.when(odd == i, F.col("query_id")).alias(c) for i, c in enumerate(("id", "query_id", "qid"))], *[F.when(odd == i, F.col("retrieved_titles")).alias(c) for i, c in enumerate(("retrieved_titles", "titles", "retrieved"))])
    folder = shared_folder(spark, "run")
    io.write_jsonl(rows, folder)
    back = io.read_jsonl(spark, folder, "id string, query_id string, qid string, retrieved_titles array<string>, titles array<string>, retrieved array<string>")
    each = back.select(F.coalesce("id", "query_id", "qid").alias("query_id"), F.posexplode(F.coalesce("retrieved_titles", "titles", "retrieved")).alias("pos", "comment_id"))
    return each.select("query_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "comment_id")


@query("a32_backends", sql("SELECT route, count(DISTINCT query_id) AS queries, count(*) AS n, round(avg(score), 6) AS mean_score FROM run GROUP BY 1", "run"))
def a32(spark: SparkSession, d: str) -> DataFrame:
    """One table of all backends' rankings, stored apart by backend."""
    folder = shared_folder(spark, "runs")
    t.run(spark, d).write.partitionBy("route").parquet(folder)
    return spark.read.parquet(folder).groupBy(F.col("route").cast("string").alias("route")).agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean_score"))


@query("a33_nested_or_flat", sql("SELECT query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM run WHERE route = 'dense' AND rank <= 30", "run"))
def a33(spark: SparkSession, d: str) -> DataFrame:
    """A file in which some queries' rows are nested and others flat."""
    half = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0
    flat = t.run(spark, d).filter("route = 'dense' AND rank <= 30").select(*PAIR, "rank").filter(half)
    rows = nested(spark, d, 30).filter(~half).select("query_id", "retrieved_titles").unionByName(flat, allowMissingColumns=True)
    folder = shared_folder(spark, "run")
    io.write_jsonl(rows, folder)
    back = io.read_jsonl(spark, folder, "query_id string, comment_id string, rank int, retrieved_titles array<string>")
    wide = back.filter("retrieved_titles IS NOT NULL").select("query_id", F.posexplode("retrieved_titles").alias("pos", "comment_id")).select(*PAIR, (F.col("pos") + 1).alias("rank"))
    return wide.unionByName(back.filter("retrieved_titles IS NULL").select(*PAIR, "rank")).select(*PAIR, *big("rank"))


@query("a34_positional_vectors", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings WHERE embedding IS NOT NULL")
def a34(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as matrices beside their ids, joined by position."""
    rows = table(spark, d, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    back = io.read_npy(spark, io.write_npy(rows, shared_folder(spark, "vectors"), "vec_id", "embedding"), width)
    return back.select("id", F.size("vec").cast("bigint").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


_SCALED = "CASE WHEN max(score) OVER w <= min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query("a35_run_features", sql(f"SELECT query_id, comment_id, count(*) AS runs, round(max(v) FILTER (route = 'dense'), 6) AS dense, round(max(v) FILTER (route = 'bm25'), 6) AS bm25 FROM (SELECT *, {_SCALED} AS v FROM run WINDOW w AS (PARTITION BY route, query_id)) WHERE query_id IN (SELECT query_id FROM candidate_features) GROUP BY ALL", "run"))
def a35(spark: SparkSession, d: str) -> DataFrame:
    """Scores of several runs, scaled within run and query (constant ones are 0), side by side for eligible queries."""
    eligible = table(spark, d, "candidate_features").select("query_id").distinct()
    v = t.run(spark, d).withColumn("v", ranking.minmax(F.col("score"), ranking.KEYS, 0.0)).join(eligible, "query_id", "left_semi")
    return v.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("runs"), *[r6(F.max(F.when(F.col("route") == r, F.col("v"))), r) for r in ("dense", "bm25")])


@query("a36_nested_run_features", sql(f"SELECT query_id, comment_id, CAST(rank AS BIGINT) AS rank, round({_SCALED}, 6) AS value FROM run WHERE route = 'dense' AND rank <= 50 WINDOW w AS (PARTITION BY query_id)", "run"))
def a36(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and scaled scores of a nested run."""
    flat = io.nested_run(nested(spark, d, 50), "dense")
    return flat.select(*PAIR, *big("rank"), r6(ranking.minmax(F.col("score"), ["query_id"], 0.0), "value"))


@query("a37_observed_features", sql("SELECT count(*) AS n, count(DISTINCT query_id) AS queries, true AS guarded FROM pool WHERE source_pool = 'graph4'", "pool"))
def a37(spark: SparkSession, d: str) -> DataFrame:
    """Features in CSV with one row per pair; repeated keys and names of held-out files are rejected."""
    folder = f"{shared_folder(spark, 'features')}/observed.csv"
    rows = t.pool(spark, d).filter("source_pool = 'graph4'").select(*PAIR, "novelty")
    io.write_csv(rows, folder)
    back = io.read_csv(spark, guards.reject_path(folder), line_ends=False)
    guards.assert_unique(back, PAIR)
    guarded = raises(lambda: guards.reject_path("features_test.csv")) and (raises(lambda: guards.assert_unique(back.unionByName(back), PAIR)) or not back.head(1))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries")).withColumn("guarded", F.lit(guarded))


@query("a39_verified_table", sql("SELECT tier, count(*) AS n, true AS verified FROM texts GROUP BY 1", "texts"))
def a39(spark: SparkSession, d: str) -> DataFrame:
    """A table whose files must be those of its manifest; others are refused."""
    folder = shared_folder(spark, "locked")
    t.texts(spark, d).select("query_id", "tier").write.parquet(folder)
    manifest = io.file_digests(spark, folder)
    refused = raises(lambda: io.verified_parquet(spark, folder, {k: "0" for k in manifest}))
    return io.verified_parquet(spark, folder, manifest).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).withColumn("verified", F.lit(refused))


@query("a40_plain_csv", sql("SELECT param_id, purpose, param_name, CAST(param_value AS VARCHAR) AS param_value FROM (SELECT CAST(param_id AS VARCHAR) AS param_id, purpose, param_name, param_value FROM run_params)"))
def a40(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    io.write_csv(table(spark, d, "run_params"), folder)
    return io.read_csv(spark, folder, line_ends=False)
