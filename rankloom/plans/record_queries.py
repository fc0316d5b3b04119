"""Queries of filters, guards, joins, sets, text features, samples, selection, graphs, scorers and composed studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import cut, lookup_skewed, table
from rankloom.functions import text as tx
from rankloom.functions import utility as ut
from rankloom.operators import fusion, graph, guards, learn, metrics, ranking, sampling, selection, setops, stats
from rankloom.streaming import judging

from . import tables as t
from .measure_queries import labelled, rounded
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


BOTS = ["AutoModerator", "B0tRank", "RepostSleuthBot"]
_BOTS = ", ".join(f"'{b}'" for b in BOTS)
TERMS = ["dose", "doses", "dosis", "medication", "prescription", "pill", "pills", "pharmacy"]
_YEAR = "CASE WHEN created_utc BETWEEN 0 AND 4102444800 THEN CAST(year(to_timestamp(created_utc) AT TIME ZONE 'UTC') AS BIGINT) END"


def year_of(c: str):
    """Year in UTC of seconds since 1970; null outside 1970 to 2099 (wrong units) and for null."""
    return F.when(F.col(c).between(0, 4102444800), F.year(F.timestamp_seconds(c)).cast("bigint"))


# filters and guards


@query("b1_base_posts", sql(f"SELECT post_id, {_YEAR} AS year, length(selftext) AS chars FROM posts WHERE {_YEAR} BETWEEN 2022 AND 2025 AND is_self AND selftext IS NOT NULL AND trim(selftext) NOT IN ('', '[deleted]', '[removed]') AND length(selftext) >= 100", "posts"))
def b1(spark: SparkSession, d: str) -> DataFrame:
    p = t.posts(spark, d).withColumn("year", year_of("created_utc"))
    kept = p.filter(F.col("year").between(2022, 2025) & F.col("is_self") & ~F.trim("selftext").isin(tx.TOMBSTONES) & (F.length("selftext") >= 100))
    return kept.select("post_id", "year", F.length("selftext").cast("bigint").alias("chars"))


@query("b2_years", sql(f"SELECT {_YEAR} AS year, count(*) AS n FROM comments GROUP BY 1"))
def b2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments").groupBy(year_of("created_utc").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("b8_term_filter", sql("SELECT comment_id, lower(m) AS term FROM (SELECT comment_id, nullif(regexp_extract(comment_text, '(?i)\\b(dose|doses|dosis|medication|prescription|pill|pills|pharmacy)\\b', 1), '') AS m FROM notes) WHERE m IS NOT NULL", "notes"))
def b8(spark: SparkSession, d: str) -> DataFrame:
    c = t.comments(spark, d).select("comment_id", F.lower(tx.term_matches(F.col("comment_text"), TERMS)).alias("term"))
    return c.filter("term IS NOT NULL")


_REASONS = "concat_ws('|', CASE WHEN coalesce(trim(query_id), '') = '' OR coalesce(trim(comment_id), '') = '' THEN 'identity' END, CASE WHEN utility IS NULL OR isnan(utility) OR isinf(utility) THEN 'utility' END, CASE WHEN " + " OR ".join(f"NOT coalesce({c} BETWEEN 1 AND 7, false)" for c in t.LABELS) + " THEN 'labels' END, CASE WHEN coalesce(trim(judge_model), '') = '' THEN 'model' END, CASE WHEN coalesce(trim(judge_version), '') = '' THEN 'version' END, CASE WHEN coalesce(validation_status, '') <> 'ok' THEN 'status' END)"


@query("b12_judgment_reasons", sql(f"SELECT query_id, comment_id, {_REASONS} AS reasons, count(*) AS n FROM qrels GROUP BY ALL"))
def b12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qrels").withColumn("reasons", guards.judgment_reasons(t.LABELS))
    return rows.groupBy(*PAIR, "reasons").agg(F.count(F.lit(1)).alias("n"))


@query("b13_complete_judgments", sql(f"SELECT query_id, comment_id, round(utility, 6) AS utility FROM judged WHERE {_REASONS} = ''", "judged"))
def b13(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).filter(guards.judgment_reasons(t.LABELS) == "").select(*PAIR, r6("utility", "utility"))


_LINEAR = " + ".join(f"CAST({c} AS DOUBLE) * {w}" for c, w in ut.WEIGHTS.items())
_UTILITY = f"CASE WHEN label_safety <= 2 AND ({_LINEAR}) IS NOT NULL THEN least({_LINEAR}, 2.0) ELSE {_LINEAR} END"


@query("b28_utility_audit", sql(f"SELECT count(*) AS n, count(*) FILTER (abs(utility - u) > 0.001) AS off, round(max(abs(utility - u)), 4) AS largest FROM (SELECT utility, {_UTILITY} AS u FROM judged) WHERE utility IS NOT NULL AND u IS NOT NULL", "judged"))
def b28(spark: SparkSession, d: str) -> DataFrame:
    rows = t.judged(spark, d).select("utility", ut.utility().alias("u")).filter("utility IS NOT NULL AND u IS NOT NULL")
    gap = F.abs(F.col("utility") - F.col("u"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > 0.001).alias("off"), F.round(F.max(gap), 4).alias("largest"))


@query("b20_same_post_filter", sql("SELECT route, query_id, comment_id, CAST(row_number() OVER (PARTITION BY route, query_id ORDER BY rank) AS BIGINT) AS rank FROM run LEFT JOIN (SELECT comment_id, regexp_replace(link_id, '^t[13]_', '') AS post FROM notes) USING (comment_id) LEFT JOIN (SELECT query_id, lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) AS own FROM texts) USING (query_id) WHERE NOT coalesce(post = own, false)", "run", "notes", "texts"))
def b20(spark: SparkSession, d: str) -> DataFrame:
    """Runs without candidates of the query's own post, ranked anew."""
    posts = t.comments(spark, d).select("comment_id", tx.bare_id(F.col("link_id")).alias("post"))
    own = t.texts(spark, d).select("query_id", F.lower(F.trim(F.regexp_replace("post_id", "(?i)^t[13]_", ""))).alias("own"))
    kept = t.run(spark, d).join(posts, "comment_id", "left").join(own, "query_id", "left").filter(~F.coalesce(F.col("post") == F.col("own"), F.lit(False)))
    return ranking.ranked(kept.withColumnRenamed("rank", "was"), ranking.KEYS, ["was"]).select("route", *PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("b29_disjoint_sets", sql("SELECT 'runs' AS a, 'pool' AS b, count(*) AS shared FROM (SELECT DISTINCT query_id FROM retrieval_runs INTERSECT SELECT DISTINCT query_id FROM candidate_features) UNION ALL SELECT 'pool', 'judged', count(*) FROM (SELECT DISTINCT query_id FROM candidate_features INTERSECT SELECT DISTINCT query_id FROM qrels)"))
def b29(spark: SparkSession, d: str) -> DataFrame:
    ids = {n: table(spark, d, n).select("query_id").distinct() for n in ("retrieval_runs", "candidate_features", "qrels")}
    count = lambda a, b, x, y: ids[a].intersect(ids[b]).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(x).alias("a"), F.lit(y).alias("b"), "shared")
    return count("retrieval_runs", "candidate_features", "runs", "pool").unionByName(count("candidate_features", "qrels", "pool", "judged"))


# joins


_VALID = f"parent_id = link_id AND comment_text IS NOT NULL AND trim(comment_text) NOT IN ('', '[deleted]', '[removed]') AND coalesce(c.author, '') NOT IN ({_BOTS}) AND length(comment_text) >= 20 AND NOT regexp_matches(comment_text, '^\\s*https?://\\S+\\s*$')"


@query("c1_comments_of_posts", sql(f"SELECT post_id, count(*) AS n, CAST(max(c.score) AS BIGINT) AS top FROM posts p JOIN notes c ON c.link_id = 't3_' || p.post_id WHERE {_VALID} GROUP BY 1", "posts", "notes"))
def c1(spark: SparkSession, d: str) -> DataFrame:
    """First-level comments that hold text, by post. A megathread is summed per task before the shuffle."""
    c = t.comments(spark, d).filter((F.col("parent_id") == F.col("link_id")) & ~F.trim("comment_text").isin(tx.TOMBSTONES) & ~F.coalesce("author", F.lit("")).isin(BOTS) & (F.length("comment_text") >= 20) & ~F.col("comment_text").rlike(tx.LINK_ONLY))
    per = c.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").cast("bigint").alias("top"))
    p = t.posts(spark, d).select("post_id", F.concat(F.lit("t3_"), "post_id").alias("link_id"))
    return p.join(per, "link_id").select("post_id", "n", "top")


@query("c5_features_with_labels", sql("SELECT count(*) AS pairs, count(utility) AS labelled, count(*) FILTER (comment_text IS NULL) AS without_text FROM pool LEFT JOIN judged USING (query_id, comment_id) LEFT JOIN notes USING (comment_id)", "pool", "judged", "notes"))
def c5(spark: SparkSession, d: str) -> DataFrame:
    j = t.judged(spark, d).select(*PAIR, "utility")
    c = t.comments(spark, d).select("comment_id", "comment_text")
    rows = t.pool(spark, d).join(j, PAIR, "left").join(c, "comment_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count("utility").alias("labelled"), F.count_if(F.col("comment_text").isNull()).alias("without_text"))


@query("c6_candidate_registry", sql("SELECT query_id, comment_id, CAST(a AS BIGINT) AS dense_rank, CAST(b AS BIGINT) AS bm25_rank, round(utility, 6) AS utility FROM (SELECT query_id, comment_id, rank AS a FROM run WHERE route = 'dense') FULL JOIN (SELECT query_id, comment_id, rank AS b FROM run WHERE route = 'bm25') USING (query_id, comment_id) LEFT JOIN judged USING (query_id, comment_id)", "run", "judged"))
def c6(spark: SparkSession, d: str) -> DataFrame:
    run = t.run(spark, d)
    a, b = (run.filter(F.col("route") == r).select(*PAIR, F.col("rank").cast("bigint").alias(f"{r}_rank")) for r in ("dense", "bm25"))
    return a.join(b, PAIR, "full_outer").join(t.judged(spark, d).select(*PAIR, r6("utility", "utility")), PAIR, "left")


@query("c10_memberships", sql("SELECT query_id, comment_id, string_agg(DISTINCT route, '|' ORDER BY route) AS routes FROM run WHERE rank <= 50 GROUP BY ALL", "run"))
def c10(spark: SparkSession, d: str) -> DataFrame:
    return setops.memberships(t.run(spark, d), 50).select(*PAIR, F.concat_ws("|", "routes").alias("routes"))


@query("c8_route_provenance", sql("SELECT query_id, comment_id, string_agg(route || '=' || rank, ',' ORDER BY route) AS ranks FROM run GROUP BY ALL", "run"))
def c8(spark: SparkSession, d: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("route", "rank")))
    return t.run(spark, d).groupBy(*PAIR).agg(F.concat_ws(",", F.transform(each, lambda x: F.concat_ws("=", x["route"], x["rank"].cast("string")))).alias("ranks"))


#: White space as the library's patterns know it, and text compared without case: the characters that fold to several.
_SPACE = "[\\s\\v\\x{{85}}\\p{{Z}}]"
_CANON = "lower(regexp_replace(regexp_replace({c}, '^" + _SPACE + "+|" + _SPACE + "+$', '', 'g'), '" + _SPACE + "+', ' ', 'g'))"
for _letter, _folded in tx.FOLDS.items():
    _CANON = "replace(" + _CANON + f", '{_letter}', '{_folded}')"


@query("c14_reference_leaks", sql(f"SELECT DISTINCT query_id, reply_id, comment_id, comments FROM (SELECT query_id, unnest(replies, recursive := true) FROM reply_references) r JOIN (SELECT h, min(comment_id) AS comment_id, count(*) AS comments FROM (SELECT DISTINCT comment_id, sha256({_CANON.format(c='comment_text')}) AS h FROM comments WHERE length(comment_text) >= 40) GROUP BY 1) c ON sha256({_CANON.format(c='text')}) = c.h WHERE length(text) >= 40"))
def c14(spark: SparkSession, d: str) -> DataFrame:
    """Reference replies whose text is also a stored comment's: the first such comment and how many there are."""
    r = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r")).filter(F.length("r.text") >= 40).select("query_id", F.col("r.reply_id").alias("reply_id"), tx.text_digest(F.col("r.text")).alias("h"))
    c = table(spark, d, "comments").filter(F.length("comment_text") >= 40).select("comment_id", tx.text_digest(F.col("comment_text")).alias("h"))
    r = r.distinct()
    held = c.distinct().groupBy("h").agg(F.min("comment_id").alias("comment_id"), F.count(F.lit(1)).alias("comments"))
    heads = r.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(held, "h")
    return lookup_skewed(r, heads, "h", "n").select("query_id", "reply_id", "comment_id", "comments").distinct()


@query("c15_capped_replies", sql("SELECT query_id, reply_id, CAST(place AS BIGINT) AS place FROM (SELECT query_id, reply_id, row_number() OVER (PARTITION BY query_id ORDER BY reply_id) AS place FROM (SELECT DISTINCT query_id, reply_id FROM (SELECT query_id, unnest(replies, recursive := true) FROM reply_references) WHERE text IS NOT NULL AND trim(text) NOT IN ('', '[deleted]', '[removed]') AND NOT regexp_matches(text, '^\\s*https?://\\S+\\s*$'))) WHERE place <= 10"))
def c15(spark: SparkSession, d: str) -> DataFrame:
    """Ten valid replies of each query."""
    r = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r")).select("query_id", "r.reply_id", "r.text")
    valid = r.filter(~F.trim("text").isin(tx.TOMBSTONES) & ~F.col("text").rlike(tx.LINK_ONLY)).select("query_id", "reply_id").distinct()
    return ranking.top_k(valid, ["query_id"], ["reply_id"], 10, "place").select("query_id", "reply_id", F.col("place").cast("bigint").alias("place"))


@query("c18_margin_pairs", sql("SELECT a.query_id, a.comment_id AS better, b.comment_id AS worse, round(a.utility - b.utility, 6) AS margin FROM l a JOIN l b ON a.query_id = b.query_id AND a.utility - b.utility >= 4.0", "pool", "judged", l="SELECT query_id, comment_id, utility FROM pool JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL"))
def c18(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a query's pool (of fixed depth) whose utilities are 4 or more apart."""
    l = labelled(spark, d)
    a = l.select("query_id", F.col("comment_id").alias("better"), F.col("utility").alias("ua"))
    b = l.select("query_id", F.col("comment_id").alias("worse"), F.col("utility").alias("ub"))
    return a.join(b, "query_id").filter(F.col("ua") - F.col("ub") >= 4.0).select("query_id", "better", "worse", F.round(F.col("ua") - F.col("ub"), 6).alias("margin"))


# sets


@query("d1_stable_unique", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, comment_id) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, min(rank_pos) AS p FROM retrieval_runs WHERE comment_id IS NOT NULL GROUP BY ALL)"))
def d1(spark: SparkSession, d: str) -> DataFrame:
    return setops.stable_unique(table(spark, d, "retrieval_runs"), ["query_id"], "comment_id", "rank_pos").select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("d3_text_aliases", sql(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_CANON.format(c='text')}) AS canonical FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"))
def d3(spark: SparkSession, d: str) -> DataFrame:
    return setops.aliases(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", tx.canonical(F.col("text")))


@query("d7_added_items", sql("SELECT query_id, comment_id, CAST(place AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM run r WHERE route = 'bm25' AND NOT EXISTS (SELECT 1 FROM run o WHERE o.route = 'dense' AND o.rank <= 8 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE place <= 4", "run"))
def d7(spark: SparkSession, d: str) -> DataFrame:
    return setops.exclusives(t.run(spark, d), "bm25", 4, ["dense"], 8).select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("d12_coverage", sql("SELECT CAST(depth AS BIGINT) AS depth, route, count(*) AS pairs, count(j) AS judged, count(*) - count(j) AS missing, round(count(j) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM (SELECT depth, route, query_id, comment_id FROM routes, (SELECT unnest([8, 20]) AS depth) WHERE rank <= depth) LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) GROUP BY ALL", "routes", "judged"))
def d12(spark: SparkSession, d: str) -> DataFrame:
    steps = F.explode(F.array(F.lit(8), F.lit(20)))
    pairs = t.routes(spark, d).withColumn("depth", steps).filter("rank <= depth")
    return rounded(setops.coverage(pairs, t.judged(spark, d), ["depth", "route"]))


@query("d13_residual", sql("SELECT DISTINCT query_id, comment_id FROM run WHERE rank <= 8 AND (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM judged)", "run", "judged"))
def d13(spark: SparkSession, d: str) -> DataFrame:
    return setops.residual(t.run(spark, d).filter("rank <= 8"), t.judged(spark, d))


@query("d23_latest_judgments", sql("SELECT query_id, comment_id, round(utility, 6) AS utility, judged_at FROM judged", "judged"))
def d23(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).select(*PAIR, r6("utility", "utility"), "judged_at")


@query("d22_edges", sql("SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT DISTINCT author AS src, link_id AS dst, source AS kind FROM comments WHERE author IS NOT NULL AND link_id IS NOT NULL) GROUP BY 1"))
def d22(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "comments").filter("author IS NOT NULL AND link_id IS NOT NULL").select(F.col("author").alias("src"), F.col("link_id").alias("dst"), F.col("source").alias("kind"))
    return graph.edge_counts(e)


# functions


@query("g1_utility", sql(f"SELECT query_id, comment_id, round({_UTILITY}, 6) AS utility, round({_LINEAR}, 6) AS linear FROM judged", "judged"))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).select(*PAIR, r6(ut.utility(), "utility"), r6(ut.linear(), "linear"))


@query("g2_clamped_scores", sql("SELECT query_id, comment_id, CASE WHEN utility IS NULL THEN 1 ELSE CAST(greatest(1.0, least(7.0, round_even(utility, 0))) AS BIGINT) END AS score, CASE WHEN utility IS NOT NULL THEN CAST(greatest(0, least(6, round_even(utility, 0) - 1)) AS BIGINT) END AS grade FROM judged", "judged"))
def g2(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).select(*PAIR, ut.clamp_score(F.col("utility")).cast("bigint").alias("score"), F.when(F.col("utility").isNotNull(), ut.grade(F.col("utility"))).cast("bigint").alias("grade"))


_TOK = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], w))"


@query("g10_token_counts", sql("SELECT comment_id, CAST(len(regexp_extract_all(lower(coalesce(comment_text, '')), '[a-z]{3,}')) AS BIGINT) AS words, CAST(len(" + _TOK.format(c="comment_text") + ") AS BIGINT) AS tokens FROM notes", "notes"))
def g10(spark: SparkSession, d: str) -> DataFrame:
    return t.comments(spark, d).select("comment_id", F.size(tx.words3(F.col("comment_text"))).cast("bigint").alias("words"), F.size(tx.tokens(F.col("comment_text"))).cast("bigint").alias("tokens"))


_IDF = "SELECT term, count(*) AS df, ln((max(n) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM (SELECT unnest(list_distinct(" + _TOK.format(c="comment_text") + ")) AS term FROM notes), (SELECT count(*) AS n FROM notes) GROUP BY 1"


@query("g15_idf", sql("SELECT term, df, round(idf, 6) AS idf FROM i", "notes", i=_IDF))
def g15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tx.idf(t.comments(spark, d), "comment_id", "comment_text"))


_PAIRTEXT = "SELECT p.query_id, p.comment_id, query_text, comment_text FROM pool p JOIN texts USING (query_id) JOIN notes USING (comment_id)"


def pair_texts(spark: SparkSession, d: str) -> DataFrame:
    q, c = t.texts(spark, d).select("query_id", "query_text"), t.comments(spark, d).select("comment_id", "comment_text")
    return t.pool(spark, d).select(*PAIR).join(q, "query_id").join(c, "comment_id")


@query(
    "g16_lexical_features",
    sql(
        "SELECT query_id, comment_id, CAST(count(*) FILTER (inside) AS BIGINT) AS shared, round(CASE WHEN sum(w) > 0 THEN coalesce(sum(w) FILTER (inside), 0) / sum(w) ELSE 0 END, 6) AS overlap, CAST(count(*) FILTER (inside AND w >= cut) AS BIGINT) AS rare FROM (SELECT *, quantile_cont(w, 0.75) OVER (PARTITION BY query_id, comment_id) AS cut FROM (SELECT query_id, comment_id, coalesce(idf, 0.0) AS w, list_contains(items, term) AS inside FROM q LEFT JOIN i USING (term))) GROUP BY ALL",
        "pool", "texts", "notes", i=_IDF, x=_PAIRTEXT,
        q="SELECT query_id, comment_id, list_distinct(" + _TOK.format(c="comment_text") + ") AS items, unnest(list_distinct(" + _TOK.format(c="query_text") + ")) AS term FROM x",
    ),
)
def g16(spark: SparkSession, d: str) -> DataFrame:
    weights = tx.idf(t.comments(spark, d), "comment_id", "comment_text")
    asked = t.texts(spark, d).select("query_id", "query_text").filter(F.size(tx.token_set(F.col("query_text"))) > 0)
    pairs = t.pool(spark, d).select(*PAIR).join(asked.select("query_id"), "query_id", "left_semi").join(t.comments(spark, d).select("comment_id", "comment_text"), "comment_id")
    f = tx.lexical_features(pairs, asked, "comment_text", "query_text", weights)
    return rounded(f).withColumn("shared", F.col("shared").cast("bigint"))


@query("g18_token_jaccard", sql("SELECT query_id, comment_id, round(len(list_intersect(a, b)) / CAST(greatest(1, len(list_distinct(list_concat(a, b)))) AS DOUBLE), 6) AS jaccard FROM (SELECT query_id, comment_id, list_distinct(" + _TOK.format(c="query_text") + ") AS a, list_distinct(" + _TOK.format(c="comment_text") + ") AS b FROM x)", "pool", "texts", "notes", x=_PAIRTEXT))
def g18(spark: SparkSession, d: str) -> DataFrame:
    return pair_texts(spark, d).select(*PAIR, r6(tx.jaccard(tx.token_set(F.col("query_text")), tx.token_set(F.col("comment_text"))), "jaccard"))


@query("g20_text_digests", sql(f"SELECT comment_id, sha256({_CANON.format(c='comment_text')}) AS digest FROM notes WHERE comment_text IS NOT NULL", "notes"))
def g20(spark: SparkSession, d: str) -> DataFrame:
    return t.comments(spark, d).filter("comment_text IS NOT NULL").select("comment_id", tx.text_digest(F.col("comment_text")).alias("digest"))


@query("g7_labels", sql("SELECT query_id, coalesce(string_agg(DISTINCT x, '|' ORDER BY x), '') AS labels FROM (SELECT query_id, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS x FROM (SELECT query_id, list_filter(list_transform(string_split(coalesce(scenario, ''), '|'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'nan', 'none')) AS p FROM texts)) GROUP BY 1", "texts"))
def g7(spark: SparkSession, d: str) -> DataFrame:
    return t.texts(spark, d).select("query_id", tx.join_labels(F.array_sort(tx.split_labels(F.col("scenario")))).alias("labels"))


def _redacted_sql(c: str) -> str:
    """The placeholders by patterns without look-around: what stands before and behind is put back. Numbers that share the
    sign between them need a second pass."""
    out = f"regexp_replace(regexp_replace({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), 'https?://[^\\s)\\]>]+', '[URL]', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(^|[^\\w/])/?[uU]/[A-Za-z0-9_-]+', '\\1[USER]', 'g'), '(^|[^\\w/])/?[rR]/[A-Za-z0-9_]+', '\\1[COMMUNITY]', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^\\d])\\+?\\d(?:[ ().-]{{0,2}}\\d){{6,14}}($|[^\\d])', '\\1[NUMBER]\\2', 'g')"
    return out


@query("g49_redaction", sql(f"SELECT comment_id, sha256({_redacted_sql('comment_text')}) AS digest FROM notes WHERE comment_text IS NOT NULL", "notes"))
def g49(spark: SparkSession, d: str) -> DataFrame:
    """Digests of all redacted comments with text."""
    c = t.comments(spark, d).filter("comment_text IS NOT NULL")
    return c.select("comment_id", F.sha2(tx.redacted(F.col("comment_text")), 256).alias("digest"))


@query("g48_link_kinds", sql("SELECT kind, count(*) AS links FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(u), '{p}') THEN '{k}'" for k, p in tx.LINK_KINDS) + " ELSE 'other' END AS kind FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s)\\]>]+')) AS u FROM documents)) GROUP BY 1"))
def g48(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select(F.explode(tx.links(F.col("text"))).alias("u"))
    return u.groupBy(tx.link_kind(F.col("u")).alias("kind")).agg(F.count(F.lit(1)).alias("links"))


_ASKED = "list_reduce(list_transform(string_split(lower(query_id), ''), lambda c: instr('0123456789abcdefghijklmnopqrstuvwxyz', c) - 1), lambda a, c: (a * 36 + c) % 50) = 0"
_BM25 = (
    "SELECT query_id, comment_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM (SELECT DISTINCT query_id, unnest(" + _TOK.format(c="query_text") + f") AS term FROM texts WHERE {_ASKED}) JOIN (SELECT term, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tf, (SELECT count(*) AS n FROM notes) GROUP BY 1) USING (term) JOIN tf USING (term) JOIN (SELECT comment_id, len("
    + _TOK.format(c="comment_text") + ") AS len FROM notes) USING (comment_id), (SELECT avg(len(" + _TOK.format(c="comment_text") + ")) AS mean FROM notes) WHERE w > 0 GROUP BY ALL"
)


@query("g0_bm25", sql("SELECT query_id, comment_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, comment_id) AS rank FROM s) WHERE rank <= 20", "notes", "texts", tf="SELECT comment_id, term, count(*) AS tf FROM (SELECT comment_id, unnest(" + _TOK.format(c="comment_text") + ") AS term FROM notes) GROUP BY ALL", s=_BM25))
def bm25(spark: SparkSession, d: str) -> DataFrame:
    """All comments for every query whose id, a number to base 36, is divisible by 50."""
    asked = t.texts(spark, d).filter(F.conv("query_id", 36, 10).cast("bigint") % 50 == 0).select("query_id", "query_text")
    return rounded(tx.bm25(t.comments(spark, d), asked, "comment_id", "comment_text", "query_text", 20))


@query("g11_tfidf", sql("SELECT comment_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY comment_id)), 6) AS value FROM (SELECT comment_id, term, (1 + ln(tf)) * idf AS v FROM (SELECT comment_id, term, count(*) AS tf FROM (SELECT comment_id, unnest(" + _TOK.format(c="comment_text") + ") AS term FROM notes) GROUP BY ALL) JOIN i USING (term))", "notes", i=_IDF))
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = t.comments(spark, d)
    return rounded(tx.tfidf(c, "comment_id", "comment_text", tx.idf(c, "comment_id", "comment_text")))


# selection


def _set_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    run = t.routes(spark, d)
    return run.filter("route = 'sbert' AND rank <= 8"), run.filter("route = 'sbert' AND rank <= 30"), t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, F.col("utility").alias("score"))


_F1 = """SELECT query_id, CASE WHEN ns > s + 1e-12 THEN new ELSE comment_id END AS comment_id, CASE WHEN ns > s + 1e-12 THEN 'pool' ELSE 'baseline' END AS source FROM
(SELECT b.query_id, b.comment_id, coalesce(utility, -1e300) AS s, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(utility, -1e300), b.comment_id DESC) AS t FROM routes b LEFT JOIN (SELECT * FROM judged WHERE utility IS NOT NULL) USING (query_id, comment_id) WHERE route = 'sbert' AND rank <= 8)
LEFT JOIN (SELECT query_id, comment_id AS new, utility AS ns, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS t FROM routes JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL AND route = 'sbert' AND rank BETWEEN 9 AND 30 QUALIFY t <= 3) USING (query_id, t)"""


@query("f1_budgeted_set", sql("SELECT * FROM f", "routes", "judged", f=_F1))
def f1(spark: SparkSession, d: str) -> DataFrame:
    base, pool, scores = _set_inputs(spark, d)
    return selection.budgeted_set(base, pool, scores, 3).select(*PAIR, "source")


@query("f2_replacements")
def f2(spark: SparkSession, d: str) -> DataFrame:
    base, pool, scores = _set_inputs(spark, d)
    chosen = selection.budgeted_set(base, pool, scores, 3)
    return rounded(selection.replacements(chosen, base, scores.withColumnRenamed("score", "utility")))


@query("f4_decomposition")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """Headroom of the pool and where it is lost, per query, for a lexical scorer and a budget of 3."""
    base, pool, u = _set_inputs(spark, d)
    judged = u.withColumnRenamed("score", "utility")
    mean = lambda s, n: s.select(*PAIR).join(judged, PAIR).groupBy("query_id").agg(F.avg("utility").alias(n))
    lexical = t.routes(spark, d).filter("route = 'lexical'").select(*PAIR, "score")
    best = metrics.oracle_utility(pool, judged).select("query_id", F.col("oracle").alias("pool"))
    rows = mean(base, "base").join(best, "query_id").join(mean(selection.budgeted_set(base, pool, u, 3), "feasible"), "query_id").join(mean(selection.budgeted_set(base, pool, lexical, 3), "learned"), "query_id")
    return rounded(rows.select("query_id", *[c.alias(n) for n, c in selection.decomposition("base", "pool", "feasible", "learned").items()]))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d)
    judged = t.judged(spark, d).select(*PAIR, "utility")
    fresh = setops.exclusives(run, "lexical", 4, ["sbert"], 8)
    return selection.one_swap_actions(run.filter("route = 'sbert' AND rank <= 8"), fresh, judged)


@query("f10_actions", sql("SELECT query_id, replaced || '>' || candidate AS action_id, round((uc - ub) / 8, 6) AS reward FROM (SELECT query_id, comment_id AS candidate, utility AS uc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 8 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) LEFT JOIN judged USING (query_id, comment_id) WHERE place <= 4) JOIN (SELECT query_id, comment_id AS replaced, utility AS ub FROM routes LEFT JOIN judged USING (query_id, comment_id) WHERE route = 'sbert' AND rank <= 8) USING (query_id) UNION ALL SELECT DISTINCT query_id, 'NOOP', 0.0 FROM routes", "routes", "judged"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).select("query_id", "action_id", r6("reward", "reward"))


@query("f11_best_actions")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.best_action(_actions(spark, d), "reward", 0.05))


@query("f13_thresholds")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.threshold_report(selection.best_action(_actions(spark, d), "reward"), [0.0, 0.1, 0.25, 0.5]))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The pool's features as short unit vectors, as the tables hold no text embeddings."""
    from rankloom.functions.vectors import l2_normalized

    p = t.pool(spark, d)
    vec = l2_normalized(F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("sbert", "lexical", "d8_max", "d8_mean", "novelty")]))
    return p.withColumn("vec", vec).withColumn("quality", F.col("sbert"))


@query("f5_mmr")
def f5(spark: SparkSession, d: str) -> DataFrame:
    base = t.routes(spark, d).filter("route = 'sbert' AND rank <= 8").select(*PAIR, F.lit(True).alias("in_baseline"))
    pool = _vectors(spark, d).join(base, PAIR, "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))
    return selection.mmr(pool, 0.3, 8, 3)


@query("f8_sequential")
def f8(spark: SparkSession, d: str) -> DataFrame:
    c = t.comments(spark, d).select("comment_id", tx.token_set(F.col("comment_text")).alias("tokens"))
    pool = t.routes(spark, d).filter("route = 'sbert'").join(c, "comment_id", "left")
    return selection.sequential(pool, 3, 0.2)


@query("h24_intra_list_distance")
def h24(spark: SparkSession, d: str) -> DataFrame:
    top = t.routes(spark, d).filter("route = 'sbert' AND rank <= 8").select(*PAIR).join(_vectors(spark, d).select(*PAIR, "vec"), PAIR)
    return rounded(selection.intra_list_distance(top))


# samples


_MD5 = "CAST(('0x' || substr(md5({x} || '#7'), 1, 15)) AS BIGINT)"


@query("j1_uniform", sql(f"SELECT query_id FROM (SELECT DISTINCT query_id FROM queries) ORDER BY {_MD5.format(x='query_id')}, query_id LIMIT 100"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(table(spark, d, "queries").select("query_id").distinct(), "query_id", 100)


@query("j2_balanced", sql(f"SELECT query_id, scenario, tier, CAST(turn AS BIGINT) AS turn FROM (SELECT query_id, scenario, tier, row_number() OVER (PARTITION BY scenario, tier ORDER BY {_MD5.format(x='query_id')}, query_id) AS turn FROM texts) ORDER BY turn, scenario NULLS FIRST, tier NULLS FIRST LIMIT 60", "texts"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(t.texts(spark, d).select("query_id", "scenario", "tier"), ["scenario", "tier"], "query_id", 60).select("query_id", "scenario", "tier", F.col("turn").cast("bigint").alias("turn"))


@query("j11_folds", sql("SELECT query_id, CAST(repeat AS BIGINT) AS repeat, CAST(CAST(('0x' || substr(md5(query_id || '#7#' || repeat), 1, 15)) AS BIGINT) % 5 AS BIGINT) AS fold FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL), (SELECT unnest(range(3)) AS repeat)"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    f = sampling.folds(table(spark, d, "qrels"), "query_id", 5, 3)
    return f.select("query_id", F.col("repeat").cast("bigint").alias("repeat"), F.col("fold").cast("bigint").alias("fold"))


@query("j8_stratified_split", sql(f"SELECT query_id, scenario, CASE WHEN place <= round(n * 0.2) THEN 'holdout' ELSE 'train' END AS split FROM (SELECT query_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY {_MD5.format(x='query_id')}, query_id) AS place, count(*) OVER (PARTITION BY scenario) AS n FROM texts WHERE scenario IS NOT NULL)", "texts"))
def j8(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(t.texts(spark, d).filter("scenario IS NOT NULL"), ["scenario"], "query_id", 0.2)


# graphs


def _thread_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Comments and their parents, both ways; seeds are the comments of the candidate pool's queries."""
    c = cut(t.comments(spark, d).filter("parent_id IS NOT NULL").select(F.concat(F.lit("t1_"), "comment_id").alias("src"), F.col("parent_id").alias("dst")))
    e = c.unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    s = t.pool(spark, d).select("query_id", F.concat(F.lit("t1_"), "comment_id").alias("node"), F.greatest(F.coalesce("sbert", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    return e, cut(s)


@query("l17_pagerank")
def l17(spark: SparkSession, d: str) -> DataFrame:
    e, s = _thread_graph(spark, d)
    return rounded(graph.pagerank_top(e, s, 50, 0.5, 6))


@query("g43_seed_distances")
def g43(spark: SparkSession, d: str) -> DataFrame:
    e, s = _thread_graph(spark, d)
    return rounded(graph.seed_distances(e, s))


# scorers

FEATURES = ["sbert", "lexical", "length", "d8_max", "d8_mean", "novelty"]


def _scored(family: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
        folds = sampling.folds(rows, "query_id", 2)
        if family in ("listnet", "ranknet"):
            return learn.out_of_fold(rows, folds, 2, lambda a, b: learn.fit_listwise(a, b, FEATURES, "utility", family))
        if family == "lambdamart":
            return learn.out_of_fold(rows, folds, 2, lambda a, b: learn.fit_lambdamart(a, b, FEATURES, "utility"))
        fit = (lambda a, b: learn.fit_pairwise(a, b, FEATURES, "utility", family)) if family in ("logistic", "svc") else (lambda a, b: learn.useful_probability(a, b, FEATURES, "utility")) if family == "useful" else (lambda a, b: learn.fit_pointwise(a, b, FEATURES, "utility", family))
        return learn.out_of_fold(rows, folds, 2, fit)

    run.__doc__ = f"Out-of-fold scores of the {family} scorer."
    return run


for _id, _family in (("k3", "huber"), ("k10", "ridge"), ("k11", "elastic_net"), ("k12", "gbt_pointwise"), ("k23", "random_forest"), ("k7", "logistic"), ("k20", "svc"), ("k21", "useful"), ("k18", "ranknet"), ("k19", "listnet"), ("k5", "lambdamart")):
    QUERIES[f"{_id}_{_family}"] = _scored(_family)


@query("k22_isotonic")
def k22(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select(*PAIR, F.col("sbert").alias("score"), "utility")
    return rounded(learn.calibrated(rows, rows, "utility"))


@query("k1_query_weights", sql("SELECT query_id, comment_id, round(t / CAST(q * n AS DOUBLE), 6) AS weight FROM (SELECT query_id, comment_id, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER () AS t FROM l), (SELECT count(DISTINCT query_id) AS q FROM l)", "pool", "judged", l="SELECT query_id, comment_id FROM pool JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL"))
def k1(spark: SparkSession, d: str) -> DataFrame:
    return learn.query_weights(labelled(spark, d)).select(*PAIR, r6("weight", "weight"))


@query("k9_standardized", sql("SELECT query_id, comment_id, " + ", ".join(f"round(CASE WHEN s_{c} > 1e-12 THEN (coalesce({c}, m_{c}) - m_{c}) / s_{c} ELSE 0 END, 6) AS {c}" for c in FEATURES) + " FROM pool, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM pool)", "pool"))
def k9(spark: SparkSession, d: str) -> DataFrame:
    p = t.pool(spark, d)
    return rounded(learn.standardized(p, p.select(*PAIR, *FEATURES), FEATURES))


@query("k35_one_standard_error")
def k35(spark: SparkSession, d: str) -> DataFrame:
    """The smallest replacement budget within one standard error of the best, by realised utility."""
    base, pool, u = _set_inputs(spark, d)
    lexical = t.routes(spark, d).filter("route = 'lexical'").select(*PAIR, "score")
    parts = None
    for budget in (0, 1, 2, 4):
        part = selection.budgeted_set(base, pool, lexical, budget).join(u.withColumnRenamed("score", "u"), PAIR).groupBy("query_id").agg(F.avg("u").alias("value")).withColumn("budget", F.lit(budget))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(learn.one_standard_error(parts, "budget", "value", "query_id"))


# judging as a stream


@query("m1_pending", sql("SELECT DISTINCT query_id, comment_id FROM candidate_features ANTI JOIN (SELECT query_id, comment_id FROM qrels WHERE validation_status = 'ok') USING (query_id, comment_id)"))
def m1(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "qrels").filter("validation_status = 'ok'")
    return judging.pending(table(spark, d, "candidate_features").select(*PAIR), done)


@query("m2_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return judging.windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


@query("m4_first_deliveries", sql("SELECT comment_id, count(*) AS deliveries, min(ingested_at) AS first FROM comments WHERE comment_id IS NOT NULL GROUP BY 1"))
def m4(spark: SparkSession, d: str) -> DataFrame:
    """Each key once, as a resumed run sees it, with how often it was delivered and when first."""
    rows = table(spark, d, "comments").filter("comment_id IS NOT NULL")
    n = rows.groupBy("comment_id").agg(F.count(F.lit(1)).alias("deliveries"), F.min("ingested_at").alias("first"))
    return judging.first_deliveries(rows, "comment_id", "ingested_at").select("comment_id").join(n, "comment_id")


# composed studies


@query("o3_cohort", sql(f"SELECT tier, scenario, query_id, n FROM (SELECT *, row_number() OVER (PARTITION BY tier, scenario ORDER BY n DESC, query_id) AS pick FROM (SELECT q.query_id, coalesce(q.scenario, 'UNKNOWN') AS scenario, c.n, CASE WHEN c.n >= 16 THEN 'deep' WHEN c.n >= 4 THEN 'mid' WHEN c.n >= 1 THEN 'shallow' ELSE 'none' END AS tier FROM texts q JOIN (SELECT link_id, count(*) AS n FROM notes c WHERE {_VALID} GROUP BY 1) c ON c.link_id = 't3_' || lower(trim(regexp_replace(q.post_id, '(?i)^t[13]_', ''))) WHERE q.use_bucket = 'query_candidate')) WHERE pick <= 15", "texts", "notes"))
def o3(spark: SparkSession, d: str) -> DataFrame:
    """Queries by depth of their thread and scenario, a quota of each."""
    c = t.comments(spark, d).filter((F.col("parent_id") == F.col("link_id")) & ~F.trim("comment_text").isin(tx.TOMBSTONES) & ~F.coalesce("author", F.lit("")).isin(BOTS) & (F.length("comment_text") >= 20) & ~F.col("comment_text").rlike(tx.LINK_ONLY))
    n = c.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    q = t.texts(spark, d).filter("use_bucket = 'query_candidate'").select("query_id", F.coalesce("scenario", F.lit("UNKNOWN")).alias("scenario"), F.concat(F.lit("t3_"), F.lower(F.trim(F.regexp_replace("post_id", "(?i)^t[13]_", "")))).alias("link_id"))
    rows = q.join(n, "link_id").withColumn("tier", sampling.tier_of(F.col("n")))
    return sampling.quota(rows, ["tier", "scenario"], [F.desc("n"), "query_id"], 15).select("tier", "scenario", "query_id", "n")


@query("o27_budget_sweep")
def o27(spark: SparkSession, d: str) -> DataFrame:
    """Oracle utility of pools by depth and budget, and the gain over the baseline with its interval."""
    run, u = t.routes(spark, d), t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, F.col("utility").alias("score"))
    base = run.filter("route = 'sbert' AND rank <= 8")
    parts = None
    for depth in (12, 20, 50):
        for budget in (1, 4):
            chosen = selection.budgeted_set(base, run.filter(F.col("rank") <= depth), u, budget)
            per = chosen.join(u.select(*PAIR, F.col("score").alias("utility")), PAIR).groupBy("query_id").agg(F.avg("utility").alias("value"))
            part = per.withColumn("cell", F.lit(f"depth {depth}, budget {budget}"))
            parts = part if parts is None else parts.unionByName(part)
    return rounded(stats.bootstrap_mean(parts, "query_id", "value", ["cell"]))


@query("o30_held_out_arms")
def o30(spark: SparkSession, d: str) -> DataFrame:
    """Utility of four ways from two routes to eight items: either route, fusion, and fusion with protected slots."""
    run, judged = t.routes(spark, d), t.judged(spark, d)
    two = run.filter("route IN ('sbert', 'lexical')")
    fused = fusion.fused_order(two, weights={"sbert": 1.0, "lexical": 0.3})
    arms = {"sbert": run.filter("route = 'sbert'"), "lexical": run.filter("route = 'lexical'"), "fused": fused, "residual": fusion.residual_slots(fused, run.filter("route = 'lexical'"), 8, 2)}
    parts = None
    for name, arm in arms.items():
        part = metrics.set_utility(arm.select(*PAIR, "rank").withColumn("route", F.lit(name)), judged, 8)
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), F.count("utility").alias("complete"), F.avg("utility").alias("utility"), F.avg("good_share").alias("good_share")))


@query("o44_triangulation")
def o44(spark: SparkSession, d: str) -> DataFrame:
    """How similarity, lexical overlap and novelty go with utility within queries, with length held fixed."""
    rows = labelled(spark, d)
    parts = None
    for signal in ("sbert", "lexical", "novelty"):
        part = stats.pooled_correlations(stats.sufficient(rows, signal, "utility", "length", ranks=True)).withColumn("signal", F.lit(signal))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts)


@query("l8_token_estimate", sql("SELECT count(*) AS items, CAST(sum(floor((length(query_text) + length(comment_text) + 1600) / 4)) AS BIGINT) AS input_tokens, count(*) * 120 AS output_tokens FROM x WHERE query_text IS NOT NULL AND comment_text IS NOT NULL", "pool", "texts", "notes", x=_PAIRTEXT))
def l8(spark: SparkSession, d: str) -> DataFrame:
    """What judging the pool would send and receive."""
    p = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL")
    return p.agg(F.count(F.lit(1)).alias("items"), F.sum(F.floor((F.length("query_text") + F.length("comment_text") + 1600) / 4)).cast("bigint").alias("input_tokens"), (F.count(F.lit(1)) * 120).alias("output_tokens"))
