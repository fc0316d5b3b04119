"""Queries of scalar, text and vector functions and of feature matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.functions import text as tx
from rankloom.functions import utility as ut
from rankloom.functions import vectors
from rankloom.operators import ranking

from . import tables as t
from .contract_queries import values
from .record_queries import _CANON, _IDF, _PAIRTEXT, _TOK, pair_texts
from .scan_queries import _GRAPH, GRAPH, big, graph_run, r6
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


# judgments as numbers


_ANSWERS = ['{"label_relevance": 5, "label_safety": 7}', 'Sure! ```json\n{"label_relevance": 3, "label_safety": 2}\n``` done', '"label_relevance": 4, "label_safety": 6.5', "label_safety: 1", "no numbers here", "{}", None]


@query("g3_parsed_judgments", "SELECT a, TRY_CAST(nullif(regexp_extract(a, 'label_relevance\"?: (\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS relevance, TRY_CAST(nullif(regexp_extract(a, 'label_safety\"?: (\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS safety FROM (SELECT unnest([" + ", ".join("NULL" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _ANSWERS) + "]) AS a UNION ALL SELECT '{\"label_relevance\": ' || label_relevance || ', \"label_safety\": ' || label_safety || '}' FROM qrels)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """Labels out of a judge's answers, which may be JSON, hold JSON, or only name and number pairs."""
    stored = table(spark, d, "qrels").select(F.concat(F.lit('{"label_relevance": '), F.col("label_relevance").cast("string"), F.lit(', "label_safety": '), F.col("label_safety").cast("string"), F.lit("}")).alias("a"))
    rows = values(spark, "a string", *[(x,) for x in _ANSWERS]).unionByName(stored).withColumn("p", ut.parse_judgment(F.col("a"), ["label_relevance", "label_safety"]))
    return rows.select("a", F.col("p.label_relevance").alias("relevance"), F.col("p.label_safety").alias("safety"))


_FIVE = " + ".join(f"CAST({c} AS DOUBLE) * {w}" for c, w in ut.WEIGHTS_FIVE.items())


@query("g4_five_label_utility", sql(f"SELECT query_id, comment_id, round(CASE WHEN label_safety <= 2 AND ({_FIVE}) IS NOT NULL THEN least({_FIVE}, 2.0) ELSE {_FIVE} END, 6) AS utility FROM judged", "judged"))
def g4(spark: SparkSession, d: str) -> DataFrame:
    """The utility of five labels; null if one of them is missing."""
    return t.judged(spark, d).select(*PAIR, r6(ut.utility(ut.WEIGHTS_FIVE), "utility"))


@query("g5_grades", sql("SELECT CAST(greatest(0, least(6, round_even(utility, 0) - 1)) AS BIGINT) AS grade, count(*) AS n, round(min(utility), 4) AS low, round(max(utility), 4) AS high FROM judged WHERE utility IS NOT NULL GROUP BY 1", "judged"))
def g5(spark: SparkSession, d: str) -> DataFrame:
    """Utilities as grades of 0 to 6, halves to the even number."""
    rows = t.judged(spark, d).filter("utility IS NOT NULL").withColumn("grade", ut.grade(F.col("utility")).cast("bigint"))
    return rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("utility"), 4).alias("low"), F.round(F.max("utility"), 4).alias("high"))


@query("g6_quantised_labels", sql("SELECT scale, CAST(round_even((utility - 1) * scale, 0) AS BIGINT) AS label, count(*) AS n FROM judged, (SELECT unnest([1.0, 4.0]) AS scale) WHERE utility IS NOT NULL GROUP BY ALL", "judged"))
def g6(spark: SparkSession, d: str) -> DataFrame:
    rows = t.judged(spark, d).filter("utility IS NOT NULL")
    both = [rows.select(F.lit(s).alias("scale"), ut.graded(F.col("utility"), s).cast("bigint").alias("label")) for s in (1.0, 4.0)]
    return both[0].unionByName(both[1]).groupBy("scale", "label").agg(F.count(F.lit(1)).alias("n"))


# labels, ids and names


_PARTS = "list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'nan', 'none'))"


@query("g8_joined_labels", sql("SELECT query_id, array_to_string(list_filter(list_transform(range(1, CAST(len(p) + 1 AS BIGINT)), lambda i: CASE WHEN list_position(p, p[i]) = i THEN p[i] END), lambda x: x IS NOT NULL), '|') AS labels FROM (SELECT query_id, " + _PARTS.format(c="coalesce(scenario, '') || '|' || coalesce(tier, '') || '| ' || coalesce(scenario, '')") + " AS p FROM texts)", "texts"))
def g8(spark: SparkSession, d: str) -> DataFrame:
    """Labels joined by bars, each once in the order of its first place."""
    some = F.concat_ws("|", F.coalesce("scenario", F.lit("")), F.coalesce("tier", F.lit("")), F.concat(F.lit(" "), F.coalesce("scenario", F.lit(""))))
    return t.texts(spark, d).select("query_id", tx.join_labels(tx.split_labels(some)).alias("labels"))


@query("g9_primary_labels", sql("SELECT label, count(*) AS n FROM (SELECT coalesce(" + _PARTS.format(c="scenario") + "[1], 'other') AS label FROM texts) GROUP BY 1", "texts"))
def g9(spark: SparkSession, d: str) -> DataFrame:
    return t.texts(spark, d).groupBy(tx.primary_label(F.col("scenario"), "other").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("g14_tokens", sql("SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT DISTINCT doc_id, " + _TOK.format(c="text") + " AS w FROM documents WHERE text IS NOT NULL)"))
def g14(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents in all their scripts, without stop words, in order."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.md5(F.concat_ws(" ", "w")).alias("digest")).distinct()


@query("g17_token_sets", sql("SELECT comment_id, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(comment_text, '')), '[a-z]{3,}'))) AS BIGINT) AS words, CAST(len(list_distinct(" + _TOK.format(c="comment_text") + ")) AS BIGINT) AS tokens FROM notes", "notes"))
def g17(spark: SparkSession, d: str) -> DataFrame:
    return t.comments(spark, d).select("comment_id", F.size(F.array_distinct(tx.words3(F.col("comment_text")))).cast("bigint").alias("words"), F.size(tx.token_set(F.col("comment_text"))).cast("bigint").alias("tokens"))


@query("g19_canonical_texts", sql(f"SELECT query_id, {_CANON.format(c='query_text')} AS text FROM texts WHERE query_text IS NOT NULL", "texts"))
def g19(spark: SparkSession, d: str) -> DataFrame:
    """Query texts as they are compared: white space collapsed, case folded."""
    return t.texts(spark, d).filter("query_text IS NOT NULL").select("query_id", tx.canonical(F.col("query_text")).alias("text"))


@query("g21_bare_ids", sql("SELECT prefix, count(*) AS n, count(DISTINCT bare) AS ids FROM (SELECT regexp_extract(parent_id, '^(t[13]_)', 1) AS prefix, regexp_replace(parent_id, '^t[13]_', '') AS bare FROM comments WHERE parent_id IS NOT NULL) GROUP BY 1"))
def g21(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comments").filter("parent_id IS NOT NULL").select(F.regexp_extract("parent_id", r"^(t[13]_)", 1).alias("prefix"), tx.bare_id(F.col("parent_id")).alias("bare"))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bare").alias("ids"))


_FILES = ["runs/q1.json", "q2.tar.gz", "/a/b.c/plain", ".hidden", "x/.y.json", "a.json.json", ""]
_FILE_SQL = "SELECT unnest([" + ", ".join(f"'{p}'" for p in _FILES) + "]) AS path UNION ALL SELECT 'out/' || query_id || '.json' FROM queries"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, "path string", *[(p,) for p in _FILES]).unionByName(table(spark, d, "queries").select(F.concat(F.lit("out/"), "query_id", F.lit(".json")).alias("path")))


@query("g22_adapter_ids", f"SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS id FROM ({_FILE_SQL})")
def g22(spark: SparkSession, d: str) -> DataFrame:
    """Base names without their last suffix."""
    return _files(spark, d).select("path", tx.stem(F.col("path")).alias("id"))


@query("g23_official_ids", f"SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.json$', '') AS id FROM ({_FILE_SQL})")
def g23(spark: SparkSession, d: str) -> DataFrame:
    """Base names without .json."""
    return _files(spark, d).select("path", F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.json$", "").alias("id"))


@query("g24_path_stems", f"SELECT stem, count(*) AS n FROM (SELECT lower(regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1')) AS stem FROM ({_FILE_SQL})) GROUP BY 1")
def g24(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(F.lower(tx.stem(F.col("path"))).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


# nested items


_VALID = "r.text IS NOT NULL AND trim(r.text) NOT IN ('', '[deleted]', '[removed]')"


@query("g25_supporting_replies", sql("SELECT query_id, CAST(len(replies) AS BIGINT) AS n, CAST(len(list_filter(replies, lambda r: " + _VALID + ")) AS BIGINT) AS fit FROM reply_references WHERE replies IS NOT NULL"))
def g25(spark: SparkSession, d: str) -> DataFrame:
    """Of nested replies those that hold text, without taking the arrays apart."""
    fit = F.filter("replies", lambda r: F.coalesce(~F.trim(r["text"]).isin(tx.TOMBSTONES), F.lit(False)))
    return table(spark, d, "reply_references").filter("replies IS NOT NULL").select("query_id", F.size("replies").cast("bigint").alias("n"), F.size(fit).cast("bigint").alias("fit"))


@query("g26_gold_titles", sql("SELECT query_id, array_to_string(CASE WHEN len(replies) > 5 THEN list_transform(list_filter(replies, lambda r: r.text_sha256 IS NOT NULL), lambda r: r.reply_id) ELSE list_transform(replies, lambda r: r.reply_id) END, ' ') AS ids FROM (SELECT DISTINCT query_id, replies FROM reply_references WHERE replies IS NOT NULL)"))
def g26(spark: SparkSession, d: str) -> DataFrame:
    """Ids from either of two nested forms: of long lists only the entries with a digest."""
    ids = lambda a: F.transform(a, lambda r: r["reply_id"])
    rows = table(spark, d, "reply_references").filter("replies IS NOT NULL").select("query_id", "replies").distinct()
    return rows.select("query_id", F.concat_ws(" ", F.when(F.size("replies") > 5, ids(F.filter("replies", lambda r: r["text_sha256"].isNotNull()))).otherwise(ids(F.col("replies")))).alias("ids"))


@query("g27_optional_texts", sql("SELECT query_id, CAST(coalesce(list_sum(list_transform(replies, lambda r: length(coalesce(r.text, r.text_sha256, '')))), 0) AS BIGINT) AS chars FROM reply_references WHERE replies IS NOT NULL"))
def g27(spark: SparkSession, d: str) -> DataFrame:
    """Each reply's text, else its digest, else nothing."""
    chars = F.aggregate("replies", F.lit(0).cast("bigint"), lambda s, r: s + F.length(F.coalesce(r["text"], r["text_sha256"], F.lit(""))))
    return table(spark, d, "reply_references").filter("replies IS NOT NULL").select("query_id", chars.alias("chars"))


@query("g28_role_prefixes", sql("SELECT query_id, md5('query: ' || query_text) AS once, md5('passage: query: ' || query_text) AS other FROM texts WHERE query_text IS NOT NULL AND NOT starts_with(query_text, 'query: ')", "texts"))
def g28(spark: SparkSession, d: str) -> DataFrame:
    """Role names in front of texts, once however often they are put there."""
    once = tx.role_prefixed(F.col("query_text"), "query")
    rows = t.texts(spark, d).filter("query_text IS NOT NULL").filter(~F.col("query_text").startswith("query: "))
    return rows.select("query_id", F.md5(tx.role_prefixed(once, "query")).alias("once"), F.md5(tx.role_prefixed(once, "passage")).alias("other"))


# vectors


_V = "CAST(embedding AS DOUBLE[])"
_UNIT = f"SELECT vec_id, label, list_transform({_V}, lambda x: x / greatest(sqrt(list_dot_product({_V}, {_V})), 1e-12)) AS v FROM embeddings WHERE embedding IS NOT NULL"


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", vectors.l2_normalized(F.col("embedding")).alias("v"))


@query("g29_unit_vectors", sql("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, round(v[1], 6) AS first, round(v[-1], 6) AS last FROM u", u=_UNIT))
def g29(spark: SparkSession, d: str) -> DataFrame:
    return unit_vectors(spark, d).select("vec_id", r6(vectors.norm(F.col("v")), "length"), r6(F.element_at("v", 1), "first"), r6(F.element_at("v", -1), "last"))


@query("g30_neighbour_cosines", sql("SELECT a.vec_id, round(greatest(-1, least(1, list_dot_product(a.v, b.v))), 6) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1", u=_UNIT))
def g30(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector and the next by id."""
    u = unit_vectors(spark, d)
    return u.join(u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", r6(vectors.cosine(F.col("v"), F.col("w")), "cosine"))


_CELLS = "SELECT label AS set, v, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM u) WHERE n <= 8"


def _sets_of_eight(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(unit_vectors(spark, d), ["label"], ["vec_id"], 8, "n").select(F.col("label").alias("set"), "v", "vec_id")


@query("g31_set_similarity", sql("SELECT CAST(a.set AS BIGINT) AS set, round(avg(list_dot_product(a.v, b.v)), 6) AS mean, round(max(list_dot_product(a.v, b.v)), 6) AS largest FROM c a JOIN c b ON a.set = b.set AND a.vec_id < b.vec_id GROUP BY 1", u=_UNIT, c=_CELLS))
def g31(spark: SparkSession, d: str) -> DataFrame:
    """Mean and largest cosine within sets of eight vectors, whose pairs are few."""
    a = _sets_of_eight(spark, d)
    pairs = a.join(a.select("set", F.col("v").alias("w"), F.col("vec_id").alias("other")), "set").filter("vec_id < other").withColumn("s", vectors.dot(F.col("v"), F.col("w")))
    return pairs.groupBy(F.col("set").cast("bigint").alias("set")).agg(r6(F.avg("s"), "mean"), r6(F.max("s"), "largest"))


@query("g32_mean_pairwise", sql("SELECT CAST(set AS BIGINT) AS set, n, round((t - n) / (n * (n - 1)), 6) AS mean FROM (SELECT set, count(*) AS n, sum(x * x) AS t0 FROM (SELECT set, vec_id, 1 AS x FROM c) GROUP BY 1) JOIN (SELECT set, sum(s * s) AS t FROM (SELECT set, i, sum(x) AS s FROM (SELECT set, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c) GROUP BY ALL) GROUP BY 1) USING (set) WHERE n > 1", u=_UNIT, c="SELECT label AS set, v, vec_id FROM u"))
def g32(spark: SparkSession, d: str) -> DataFrame:
    """Mean dot product over all pairs of each label's vectors, from the square of their sum: no pair is formed."""
    u = unit_vectors(spark, d)
    n = u.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    return n.join(sums, "label").filter("n > 1").select(F.col("label").cast("bigint").alias("set"), "n", r6((F.col("t") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), "mean"))


@query("g33_set_distances", sql("SELECT CAST(set AS BIGINT) AS set, round(1 - avg(s), 6) AS ild FROM (SELECT a.set, list_dot_product(a.v, b.v) AS s FROM c a JOIN c b ON a.set = b.set AND a.vec_id < b.vec_id) GROUP BY 1", u=_UNIT, c=_CELLS.replace("n <= 8", "n <= 5")))
def g33(spark: SparkSession, d: str) -> DataFrame:
    """One minus the mean cosine within sets of five."""
    from rankloom.operators import selection

    five = ranking.top_k(unit_vectors(spark, d), ["label"], ["vec_id"], 5, "n").select(F.col("label").alias("query_id"), F.col("vec_id").alias("comment_id"), F.col("v").alias("vec"))
    return selection.intra_list_distance(five).select(F.col("query_id").cast("bigint").alias("set"), r6("ild", "ild"))


@query("g36_bidirectional_f", "SELECT cra, rcc, beta, round(CASE WHEN beta * beta * cra + rcc > 0 THEN (1 + beta * beta) * cra * rcc / (beta * beta * cra + rcc) ELSE 0.0 END, 6) AS f FROM (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS cra), (SELECT unnest([0.0, 0.5, 0.8]) AS rcc), (SELECT unnest([0.5, 1.0, 2.0]) AS beta)")
def g36(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mean of two coverages, 0 where both are."""
    steps = lambda n, xs: values(spark, f"{n} double", *[(x,) for x in xs])
    rows = steps("cra", (0.0, 0.25, 0.5, 1.0)).crossJoin(steps("rcc", (0.0, 0.5, 0.8))).crossJoin(steps("beta", (0.5, 1.0, 2.0)))  # of fixed size
    b = F.col("beta") * F.col("beta")
    return rows.withColumn("f", F.round(F.when(b * F.col("cra") + F.col("rcc") > 0, (1 + b) * F.col("cra") * F.col("rcc") / (b * F.col("cra") + F.col("rcc"))).otherwise(0.0), 6))


@query("g34_nearest_of_a_set", sql("SELECT q.vec_id, round(max(list_dot_product(q.v, c.v)), 6) AS nearest FROM u q, c WHERE q.vec_id % 50 = 0 GROUP BY 1", u=_UNIT, c="SELECT v FROM u WHERE vec_id % 50 = 1"))
def g34(spark: SparkSession, d: str) -> DataFrame:
    """Of stated vectors the largest dot product with any of another stated set."""
    u = unit_vectors(spark, d)
    asked = u.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vec"))
    held = u.filter("vec_id % 50 = 1").select(F.col("vec_id").alias("comment_id"), F.col("v").alias("vec"))
    return ranking.dense_top_k(held, asked, 1).select(F.col("query_id").alias("vec_id"), r6("score", "nearest"))


# feature matrices


_MATRIX = "SELECT p.query_id, p.comment_id, coalesce(sbert, 0) AS s_sem, coalesce(lexical, 0) AS s_lex, " + ", ".join(f"CASE WHEN {r} IS NULL THEN 0.0 ELSE 1 - ({r} - 1) / 99.0 END AS p_{r}, CASE WHEN {r} IS NULL THEN 0 ELSE 1 END AS i_{r}" for r in ("dense", "bm25", "lex")) + ", coalesce(length, 0) AS log_len, coalesce(d8_max, 0) AS s_max_d8, coalesce(d8_mean, 0) AS s_mean_d8 FROM pool p LEFT JOIN (SELECT query_id, comment_id, min(rank) FILTER (route = 'dense') AS dense, min(rank) FILTER (route = 'bm25') AS bm25 FROM run WHERE rank <= 100 GROUP BY ALL) r USING (query_id, comment_id) LEFT JOIN (SELECT query_id, comment_id, rank AS lex FROM routes WHERE route = 'lexical') l USING (query_id, comment_id)"
_M_NAMES = ["s_sem", "s_lex", "p_dense", "i_dense", "p_bm25", "i_bm25", "p_lex", "i_lex", "log_len", "s_max_d8", "s_mean_d8"]


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(pair, eleven features): similarities, each route's place as a percentile and whether it is there, length, and
    nearness to the baseline's eight."""
    run = t.run(spark, d).filter("rank <= 100").groupBy(*PAIR).agg(*[F.min(F.when(F.col("route") == r, F.col("rank"))).alias(r) for r in ("dense", "bm25")])
    lex = t.routes(spark, d).filter("route = 'lexical'").select(*PAIR, F.col("rank").alias("lex"))
    rows = t.pool(spark, d).join(run, PAIR, "left").join(lex, PAIR, "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    places = [c for r in ("dense", "bm25", "lex") for c in (ranking.depth_percentile(F.col(r), 100).alias(f"p_{r}"), F.col(r).isNotNull().cast("int").alias(f"i_{r}"))]
    return rows.select(*PAIR, zero("sbert", "s_sem"), zero("lexical", "s_lex"), *places, zero("length", "log_len"), zero("d8_max", "s_max_d8"), zero("d8_mean", "s_mean_d8"))


@query("g40_feature_matrix", sql("SELECT query_id, comment_id, " + ", ".join(f"round({c}, 6) AS {c}" if c[0] != "i" else f"CAST({c} AS BIGINT) AS {c}" for c in _M_NAMES) + " FROM m", "run", "routes", m=_MATRIX))
def g40(spark: SparkSession, d: str) -> DataFrame:
    return feature_matrix(spark, d).select(*PAIR, *[r6(c, c) if c[0] != "i" else F.col(c).cast("bigint").alias(c) for c in _M_NAMES])


@query("g41_route_ranks", sql("SELECT route, query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM run WHERE rank <= 50 UNION ALL SELECT 'pool_' || route, query_id, comment_id, CAST(rank AS BIGINT) FROM routes WHERE rank <= 50", "run", "routes"))
def g41(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all routes in one table."""
    pool = t.routes(spark, d).withColumn("route", F.concat(F.lit("pool_"), "route"))
    return t.run(spark, d).select("route", *PAIR, "rank").unionByName(pool.select("route", *PAIR, "rank")).filter("rank <= 50").select("route", *PAIR, *big("rank"))


@query("g42_drift_features", sql("SELECT j.query_id, j.comment_id, CASE WHEN label_safety <= 2 THEN 'safety' WHEN label_relevance <= 3 THEN 'semantic_context' ELSE 'support_quality' END AS drift, round(coalesce(sbert, 0), 6) AS similarity, dense_rank IS NOT NULL AS ranked, p.query_id IS NOT NULL AS in_pool FROM judged j LEFT JOIN pool p USING (query_id, comment_id) WHERE label_safety <= 2 OR label_relevance <= 3 OR label_usefulness <= 3", "judged", "pool"))
def g42(spark: SparkSession, d: str) -> DataFrame:
    """Judged items that miss their query, by how, with their static features where the pool has them."""
    j = t.judged(spark, d).filter("label_safety <= 2 OR label_relevance <= 3 OR label_usefulness <= 3")
    kind = F.when(F.col("label_safety") <= 2, "safety").when(F.col("label_relevance") <= 3, "semantic_context").otherwise("support_quality")
    p = t.pool(spark, d).select(*PAIR, "sbert", "dense_rank", F.lit(True).alias("held"))
    return j.join(p, PAIR, "left").select(*PAIR, kind.alias("drift"), r6(F.coalesce("sbert", F.lit(0.0)), "similarity"), F.col("dense_rank").isNotNull().alias("ranked"), F.coalesce("held", F.lit(False)).alias("in_pool"))


@query("g44_feature_registry", sql("SELECT m.query_id, m.comment_id, round(s_sem, 6) AS s_sem, round(p_dense, 6) AS p_dense, round(coalesce(fact, 0), 6) AS fact, round(coalesce(passage, 0), 6) AS passage, (CASE WHEN fact IS NULL THEN 0 ELSE 1 END) + (CASE WHEN passage IS NULL THEN 0 ELSE 1 END) AS native_routes, utility IS NOT NULL AS labelled FROM m LEFT JOIN g USING (query_id, comment_id) LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id)", "run", "routes", "judged", *GRAPH, m=_MATRIX, g=_GRAPH))
def g44(spark: SparkSession, d: str) -> DataFrame:
    """Basic and graph features of each candidate, with whether it is labelled."""
    g = graph_run(spark, d).select(*PAIR, F.col("native")["fact"].alias("fact"), F.col("native")["passage"].alias("passage"))
    rows = feature_matrix(spark, d).join(g, PAIR, "left").join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return rows.select(*PAIR, r6("s_sem", "s_sem"), r6("p_dense", "p_dense"), *[r6(F.coalesce(c, F.lit(0.0)), c) for c in ("fact", "passage")], (F.col("fact").isNotNull().cast("bigint") + F.col("passage").isNotNull().cast("bigint")).alias("native_routes"), F.col("utility").isNotNull().alias("labelled"))


@query("g45_mixed_features", sql("SELECT query_id, comment_id, round(coalesce(1.0 / (60 + a), 0), 9) AS rr_sbert, round(coalesce(1.0 / (60 + b), 0), 9) AS rr_lexical, round(coalesce(1.0 / (60 + a), 0) + coalesce(1.0 / (60 + b), 0), 9) AS rr_sum, CAST(least(a, b) AS BIGINT) AS best, CAST(abs(a - b) AS BIGINT) AS apart FROM (SELECT query_id, comment_id, min(rank) FILTER (route = 'sbert') AS a, min(rank) FILTER (route = 'lexical') AS b FROM routes GROUP BY ALL)", "routes"))
def g45(spark: SparkSession, d: str) -> DataFrame:
    """Features of both routes' places: reciprocal ranks, their sum, the better one and how far they are apart."""
    wide = t.routes(spark, d).groupBy(*PAIR).agg(*[F.min(F.when(F.col("route") == r, F.col("rank"))).alias(n) for r, n in (("sbert", "a"), ("lexical", "b"))])
    a, b = ranking.reciprocal_rank(F.col("a")), ranking.reciprocal_rank(F.col("b"))
    return wide.select(*PAIR, F.round(a, 9).alias("rr_sbert"), F.round(b, 9).alias("rr_lexical"), F.round(a + b, 9).alias("rr_sum"), F.least("a", "b").cast("bigint").alias("best"), F.abs(F.col("a") - F.col("b")).cast("bigint").alias("apart"))


@query("g46_card_features", sql("SELECT x.query_id, x.comment_id, round(ln(1 + length(coalesce(comment_text, ''))), 6) AS log_chars, CAST(len(regexp_extract_all(coalesce(comment_text, ''), 'https?://')) AS BIGINT) AS links, contains(coalesce(comment_text, ''), '?') AS asks, regexp_matches(lower(coalesce(comment_text, '')), '(^|[^\\p{L}\\p{N}_])(i|my|me)($|[^\\p{L}\\p{N}_])') AS personal, round(len(list_intersect(list_distinct(" + _TOK.format(c="query_text") + "), list_distinct(" + _TOK.format(c="comment_text") + "))) / CAST(greatest(1, len(list_distinct(" + _TOK.format(c="query_text") + "))) AS DOUBLE), 6) AS covered FROM x", "pool", "texts", "notes", x=_PAIRTEXT))
def g46(spark: SparkSession, d: str) -> DataFrame:
    """Features of a candidate's text as a reader sees it."""
    c, q = F.coalesce("comment_text", F.lit("")), tx.token_set(F.col("query_text"))
    covered = F.size(F.array_intersect(q, tx.token_set(F.col("comment_text")))) / F.greatest(F.lit(1), F.size(q))
    return pair_texts(spark, d).select(*PAIR, r6(F.log1p(F.length(c)), "log_chars"), F.regexp_count(c, F.lit("https?://")).cast("bigint").alias("links"), F.contains(c, F.lit("?")).alias("asks"), F.lower(c).rlike(r"(^|[^\p{L}\p{N}_])(i|my|me)($|[^\p{L}\p{N}_])").alias("personal"), r6(covered, "covered"))


@query("g47_scaled_matrix", sql("SELECT query_id, comment_id, " + ", ".join(f"round(CASE WHEN b_{c} > a_{c} THEN greatest(0, least(1, ({c} - a_{c}) / (b_{c} - a_{c}))) ELSE 0 END, 6) AS {c}" for c in ("s_sem", "s_lex", "log_len")) + " FROM m, (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS a_{c}, quantile_cont({c}, 0.95) AS b_{c}" for c in ("s_sem", "s_lex", "log_len")) + " FROM m)", "run", "routes", m=_MATRIX))
def g47(spark: SparkSession, d: str) -> DataFrame:
    """Features scaled between their 5th and 95th percentile and cut to 0 to 1; constant ones are 0."""
    m, names = feature_matrix(spark, d), ("s_sem", "s_lex", "log_len")
    edges = m.agg(*[F.percentile(c, [0.05, 0.95]).alias(f"e_{c}") for c in names])
    scaled = lambda c: F.when(F.col(f"e_{c}")[1] > F.col(f"e_{c}")[0], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col(f"e_{c}")[0]) / (F.col(f"e_{c}")[1] - F.col(f"e_{c}")[0])))).otherwise(F.lit(0.0))
    return m.crossJoin(F.broadcast(edges)).select(*PAIR, *[r6(scaled(c), c) for c in names])


# links, hosts and other strings


_HOST = "regexp_extract(lower(u), '^https?://([^/:?#]+)', 1)"
_LINKS = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s)\\]>]+')) AS u FROM documents"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(tx.links(F.col("text"))).alias("u")).distinct()


def host(u: str) -> Column:
    return F.regexp_extract(F.lower(u), r"^https?://([^/:?#]+)", 1)


@query("g50_link_inventory", f"SELECT host, count(*) AS links, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {_HOST} AS host FROM ({_LINKS})) GROUP BY 1")
def g50(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of links and how many documents have them; the links themselves stay out."""
    return links(spark, d).groupBy(host("u").alias("host")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("doc_id").alias("documents"))


_WORDS_OUT = "len(regexp_extract_all(regexp_replace(coalesce(text, ''), 'https?://[^\\s)\\]>]+', '', 'g'), '[a-zA-Z]{3,}'))"
_N_LINKS = "len(regexp_extract_all(coalesce(text, ''), 'https?://'))"


@query("g51_reasons_to_judge_again", sql(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_N_LINKS} = 0 THEN 'none' WHEN {_WORDS_OUT} < 3 THEN 'link alone' WHEN {_N_LINKS} > 2 THEN 'many links' WHEN {_WORDS_OUT} < 12 THEN 'few words beside a link' ELSE 'text with a link' END AS reason FROM documents) GROUP BY 1"))
def g51(spark: SparkSession, d: str) -> DataFrame:
    """Why a text with links may have been judged wrongly once links were replaced."""
    text = F.coalesce("text", F.lit(""))
    words, n = F.regexp_count(F.regexp_replace(text, r"https?://[^\s)\]>]+", ""), F.lit("[a-zA-Z]{3,}")), F.regexp_count(text, F.lit("https?://"))
    reason = F.when(n == 0, "none").when(words < 3, "link alone").when(n > 2, "many links").when(words < 12, "few words beside a link").otherwise("text with a link")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_DOMAINS = ["example", "example.org", "test"]


@query("g52_domain_matches", f"SELECT host, {' OR '.join(f'host = {chr(39)}{x}{chr(39)} OR ends_with(host, {chr(39)}.{x}{chr(39)})' for x in _DOMAINS)} AS known, count(*) AS n FROM (SELECT {_HOST} AS host FROM ({_LINKS})) GROUP BY ALL")
def g52(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that are one of some domains or below it."""
    h = links(spark, d).select(host("u").alias("host"))
    return h.groupBy("host", tx.host_in(F.col("host"), _DOMAINS).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("g53_plain_signs", sql("SELECT query_id, regexp_replace(" + "translate(query_text, '‘’“”–—', '''''\"\"--')" + ", '…', '...', 'g') AS text FROM texts WHERE query_text IS NOT NULL AND NOT regexp_matches(translate(query_text, '‘’“”–—…', '-------'), '[^\\x01-\\x7f]')", "texts"))
def g53(spark: SparkSession, d: str) -> DataFrame:
    """Typographic signs as plain ones, in texts that have no other characters beyond ASCII."""
    rows = t.texts(spark, d).filter("query_text IS NOT NULL").filter(~F.translate("query_text", "‘’“”–—…", "-------").rlike(r"[^\x01-\x7f]"))
    return rows.select("query_id", tx.ascii_normal(F.col("query_text")).alias("text"))


@query("g54_providers", "SELECT spec, CASE WHEN contains(spec, ':') THEN split_part(spec, ':', 1) ELSE 'openai' END AS provider, CASE WHEN contains(spec, ':') THEN substr(spec, strpos(spec, ':') + 1) ELSE spec END AS model, n FROM (SELECT coalesce(judge_model, 'local:m:1') AS spec, count(*) AS n FROM qrels GROUP BY 1)")
def g54(spark: SparkSession, d: str) -> DataFrame:
    """Names of judges as provider and model; a name without a provider has the usual one."""
    spec = table(spark, d, "qrels").groupBy(F.coalesce("judge_model", F.lit("local:m:1")).alias("spec")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("spec", ":", 2)
    two = F.size(parts) == 2
    return spec.select("spec", F.when(two, F.get(parts, F.lit(0))).otherwise("openai").alias("provider"), F.when(two, F.get(parts, F.lit(1))).otherwise(F.col("spec")).alias("model"), "n")


_LISTS = ['["a", "b"]', "[]", "not json", None, '["a", null]']


@query("g55_json_lists", "SELECT v, CASE WHEN starts_with(v, '[') THEN array_to_string(regexp_extract_all(v, '\"([^\"]*)\"', 1), ',') END AS items FROM (SELECT unnest([" + ", ".join("NULL" if x is None else f"'{x}'" for x in _LISTS) + "]) AS v UNION ALL SELECT CAST(to_json([query_id, source]) AS VARCHAR) FROM queries WHERE query_id IS NOT NULL AND source IS NOT NULL)")
def g55(spark: SparkSession, d: str) -> DataFrame:
    """Lists stored as JSON text; what is no list is null."""
    rows = table(spark, d, "queries").filter("query_id IS NOT NULL AND source IS NOT NULL").select(F.to_json(F.array("query_id", "source")).alias("v"))
    all_ = values(spark, "v string", *[(x,) for x in _LISTS]).unionByName(rows).withColumn("a", F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")))
    return all_.select("v", F.when(F.col("a").isNotNull(), F.concat_ws(",", "a")).alias("items"))


@query("g56_object_digests", sql("SELECT query_id, comment_id, sha256('{\"comment_id\":\"' || comment_id || '\",\"query_id\":\"' || query_id || '\",\"rank\":' || rank || '}') AS digest FROM run WHERE route = 'bm25' AND rank <= 20", "run"))
def g56(spark: SparkSession, d: str) -> DataFrame:
    """Digests of objects as canonical JSON: sorted fields, no blanks."""
    rows = t.run(spark, d).filter("route = 'bm25' AND rank <= 20")
    return rows.select(*PAIR, F.sha2(F.to_json(F.struct("comment_id", "query_id", "rank")), 256).alias("digest"))


_SCALARS = ["true", "False", "null", "~", "12", "-3.5", "1e3", "'quoted'", "plain text", ""]


@query("g57_scalars", "SELECT raw, CASE WHEN lower(raw) IN ('true', 'false') THEN 'boolean' WHEN lower(raw) IN ('null', '~', '') THEN 'null' WHEN regexp_full_match(raw, '[+-]?\\d+') THEN 'integer' WHEN TRY_CAST(raw AS DOUBLE) IS NOT NULL THEN 'double' ELSE 'string' END AS kind, CASE WHEN lower(raw) IN ('null', '~', '') THEN NULL ELSE trim(raw, '''') END AS value FROM (SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SCALARS) + "]) AS raw UNION ALL SELECT DISTINCT param_name FROM run_params)")
def g57(spark: SparkSession, d: str) -> DataFrame:
    """What plain values of a configuration are."""
    rows = values(spark, "raw string", *[(x,) for x in _SCALARS]).unionByName(table(spark, d, "run_params").select(F.col("param_name").alias("raw")).distinct())
    low, none = F.lower("raw"), F.lower("raw").isin("null", "~", "")
    kind = F.when(low.isin("true", "false"), "boolean").when(none, "null").when(F.col("raw").rlike(r"^[+-]?\d+$"), "integer").when(F.col("raw").try_cast("double").isNotNull(), "double").otherwise("string")
    return rows.select("raw", kind.alias("kind"), F.when(~none, F.btrim("raw", F.lit("'"))).alias("value"))


@query("g58_parameters", "SELECT purpose, count(*) AS n, round(min(param_value), 6) AS low, round(max(param_value), 6) AS high FROM run_params GROUP BY 1")
def g58(spark: SparkSession, d: str) -> DataFrame:
    """Parameters by purpose, as a study looks them up."""
    rows = table(spark, d, "run_params")
    held: dict = {}
    for r in rows.orderBy("param_id").collect():  # of fixed size
        held.setdefault(r["purpose"], []).append(r["param_value"])
    known = lambda p: [v for v in held.get(p, []) if v is not None]
    some = [(p, len(held[p]), round(min(known(p)), 6), round(max(known(p)), 6)) for p in held if known(p)]
    return values(spark, "purpose string, n long, low double, high double", *some)


@query("g16_rare_tokens", sql("SELECT query_id, term, round(idf, 6) AS idf FROM (SELECT query_id, term, idf, quantile_cont(coalesce(idf, 0), 0.75) OVER (PARTITION BY query_id) AS cut FROM (SELECT query_id, unnest(list_distinct(" + _TOK.format(c="query_text") + ")) AS term FROM texts) LEFT JOIN i USING (term)) WHERE idf >= cut", "texts", "notes", i=_IDF))
def g16(spark: SparkSession, d: str) -> DataFrame:
    """Of each query its rare words: those at or above the third quartile of its words' weights."""
    from rankloom.base import lookup_skewed

    weights = tx.idf(t.comments(spark, d), "comment_id", "comment_text")
    q = t.texts(spark, d).select("query_id", F.explode(tx.token_set(F.col("query_text"))).alias("term"))
    known = q.groupBy("term").agg(F.count(F.lit(1)).alias("c")).join(weights.select("term", "idf"), "term", "left")
    rows = lookup_skewed(q, known, "term", "c")
    cut = rows.groupBy("query_id").agg(F.percentile(F.coalesce("idf", F.lit(0.0)), 0.75).alias("cut"))
    return rows.join(cut, "query_id").filter("idf >= cut").select("query_id", "term", r6("idf", "idf"))


@query("g12_reply_clusters", sql("SELECT h, count(*) AS replies, count(DISTINCT query_id) AS queries FROM (SELECT DISTINCT query_id, reply_id, sha256(" + _CANON.format(c="text") + ") AS h FROM (SELECT query_id, unnest(replies, recursive := true) FROM reply_references) WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1"))
def g12(spark: SparkSession, d: str) -> DataFrame:
    """Texts that would get one vector for many replies: groups of equal ones, by digest."""
    r = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r")).filter("r.text IS NOT NULL").select("query_id", F.col("r.reply_id").alias("reply_id"), tx.text_digest(F.col("r.text")).alias("h")).distinct()
    return r.groupBy("h").agg(F.count(F.lit(1)).alias("replies"), F.count_distinct("query_id").alias("queries")).filter("replies > 1")

