"""Queries of scans, orders, fusion and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import lookup_skewed, table
from rankloom.operators import fusion, pools, ranking, sampling, setops
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


# scans


@query("a19_flat_run", sql("SELECT route, query_id, comment_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM run", "run"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    return t.run(spark, d).select("route", *PAIR, F.col("rank").cast("bigint").alias("rank"), r6("score", "score"))


@query("a20_nested_run", sql("SELECT 'nested' AS route, query_id, comment_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM run WHERE route = 'dense' AND rank <= 20", "run"))
def a20(spark: SparkSession, d: str) -> DataFrame:
    """A run as arrays per query and back."""
    top = t.run(spark, d).filter("route = 'dense' AND rank <= 20").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "comment_id", "score"))).alias("l"))
    nested = top.select("query_id", F.col("l.comment_id").alias("retrieved_titles"), F.col("l.score").alias("retrieved_scores"))
    return io.nested_run(nested, "nested").select("route", *PAIR, F.col("rank").cast("bigint").alias("rank"), r6("score", "score"))


@query("a21_run_integrity", sql("SELECT backend AS route, query_id, count(*) AS n, count(DISTINCT comment_id) AS items, CAST(min(rank_pos) AS BIGINT) AS low, CAST(max(rank_pos) AS BIGINT) AS high FROM retrieval_runs GROUP BY ALL HAVING count(*) <> count(DISTINCT comment_id) OR count(*) <> count(DISTINCT rank_pos) OR min(rank_pos) <> 1 OR max(rank_pos) <> count(*)"))
def a21(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.operators.guards import run_violations

    stored = table(spark, d, "retrieval_runs").select(F.col("backend").alias("route"), *PAIR, F.col("rank_pos").alias("rank"))
    return run_violations(stored).select("route", "query_id", "n", "items", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))


@query("a14_ids", sql("SELECT DISTINCT coalesce(nullif(trim(query_id), ''), nullif(trim(post_id), '')) AS id FROM queries WHERE coalesce(nullif(trim(query_id), ''), nullif(trim(post_id), '')) IS NOT NULL"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    return io.read_ids(table(spark, d, "queries"))


@query("a38_source_map", sql("SELECT posts, count(*) AS comments, posts > 1 AS conflict FROM (SELECT count(DISTINCT link_id) AS posts FROM comments WHERE comment_id IS NOT NULL GROUP BY comment_id) GROUP BY 1"))
def a38(spark: SparkSession, d: str) -> DataFrame:
    """Comments by the number of posts they are stored under; more than one is a conflict."""
    per = table(spark, d, "comments").filter("comment_id IS NOT NULL").groupBy("comment_id").agg(F.count_distinct("link_id").alias("posts"))
    return per.groupBy("posts").agg(F.count(F.lit(1)).alias("comments")).withColumn("conflict", F.col("posts") > 1)


# orders


@query(
    "e1_dense_top_k",
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, e.vec_id AS comment_id, list_dot_product(v, CAST(e.embedding AS DOUBLE[])) AS score FROM q, embeddings e WHERE e.vec_id <> query_id) "
    "SELECT query_id, comment_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS rank FROM s) WHERE rank <= 10",
)
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Exact search: every row whose id is divisible by 50 against all others."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("comment_id"), F.col("embedding").alias("vec"))
    asked = rows.filter("comment_id % 50 = 0").withColumnRenamed("comment_id", "query_id")
    near = ranking.dense_top_k(rows, asked, 11).filter("query_id <> comment_id").drop("rank")
    return ranking.top_k(near, ["query_id"], [F.desc("score"), "comment_id"], 10).select("query_id", "comment_id", r6("score", "score"), F.col("rank").cast("bigint").alias("rank"))


@query("e3_rrf_scores", sql("SELECT query_id, comment_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM run GROUP BY ALL", "run"))
def e3(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf_scores(t.run(spark, d)).select(*PAIR, F.round("score", 9).alias("score"))


_SEEN = "SELECT query_id, comment_id, min(CASE route WHEN 'dense' THEN 0 ELSE 1 END * 1000000 + rank) AS seen FROM run GROUP BY ALL"
_FUSED = "SELECT query_id, comment_id, round(score, 5) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, seen) AS rank FROM scores s JOIN seen USING (query_id, comment_id)) WHERE rank <= 8"


@query("e4_rrf_fuse", sql(_FUSED, "run", scores="SELECT query_id, comment_id, sum(CASE route WHEN 'dense' THEN 1.0 ELSE 0.5 END / (60 + rank)) AS score FROM run GROUP BY ALL", seen=_SEEN))
def e4(spark: SparkSession, d: str) -> DataFrame:
    top = fusion.fuse(t.run(spark, d), ["dense", "bm25"], weights={"dense": 1.0, "bm25": 0.5})
    return top.select(*PAIR, "score", F.col("rank").cast("bigint").alias("rank"))


_MINMAX = "CASE WHEN max(score) OVER w - min(score) OVER w <= {eps} THEN {c} ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


def _norm(value) -> DataFrame:
    return lambda spark, d: t.run(spark, d).select("route", *PAIR, r6(value, "value"))


def _norm_sql(expression: str) -> str:
    return sql(f"SELECT route, query_id, comment_id, round({expression}, 6) AS value FROM run WINDOW w AS (PARTITION BY route, query_id)", "run")


K = ranking.KEYS
QUERIES["e5_minmax"] = lambda spark, d: _norm(ranking.minmax(F.col("score"), K))(spark, d)
ORACLE["e5_minmax"] = _norm_sql(_MINMAX.format(eps=0, c=1.0))
QUERIES["e6_zscore"] = lambda spark, d: _norm(ranking.zscore(F.col("score"), K))(spark, d)
ORACLE["e6_zscore"] = _norm_sql("CASE WHEN stddev_pop(score) OVER w <= 0 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END")
QUERIES["e7_rank_percentile"] = lambda spark, d: _norm(ranking.rank_percentile(F.col("score"), "comment_id", K))(spark, d)
ORACLE["e7_rank_percentile"] = _norm_sql("CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY route, query_id ORDER BY score, comment_id) - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) END")
QUERIES["e39_minmax_zero"] = lambda spark, d: _norm(ranking.minmax(F.col("score"), K, 0.0))(spark, d)
ORACLE["e39_minmax_zero"] = _norm_sql(_MINMAX.format(eps=0, c=0.0))
QUERIES["e43_minmax_half"] = lambda spark, d: _norm(ranking.minmax(F.col("score"), K, 0.5, 1e-12))(spark, d)
ORACLE["e43_minmax_half"] = _norm_sql(_MINMAX.format(eps="1e-12", c=0.5))

_CC = "SELECT query_id, comment_id, sum(CASE route WHEN 'dense' THEN 0.7 ELSE 0.3 END * v) AS score FROM (SELECT *, " + _MINMAX.format(eps=0, c=1.0) + " AS v FROM run WINDOW w AS (PARTITION BY route, query_id)) GROUP BY ALL"


@query("e9_cc_scores", sql("SELECT query_id, comment_id, round(score, 6) AS score FROM scores", "run", scores=_CC))
def e9(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cc_scores(t.run(spark, d), {"dense": 0.7, "bm25": 0.3}).select(*PAIR, r6("score", "score"))


@query("e10_cc_fuse", sql(_FUSED.replace("s.score DESC, seen", "round(s.score, 9) DESC, seen"), "run", scores=_CC, seen=_SEEN))
def e10(spark: SparkSession, d: str) -> DataFrame:
    top = fusion.fuse(t.run(spark, d), ["dense", "bm25"], mode="cc", weights={"dense": 0.7, "bm25": 0.3})
    return top.select(*PAIR, "score", F.col("rank").cast("bigint").alias("rank"))


@query("e12_tune_cc_weights")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return fusion.tune_cc_weights(t.routes(spark, d), t.gold(spark, d), ["sbert", "lexical", "length"])


@query("e13_fused_order", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, comment_id) AS BIGINT) AS rank FROM scores", "run", scores="SELECT query_id, comment_id, sum(CASE route WHEN 'dense' THEN 1.0 ELSE 0.3 END / (60 + rank)) AS score FROM run GROUP BY ALL"))
def e13(spark: SparkSession, d: str) -> DataFrame:
    scores = fusion.rrf_scores(t.run(spark, d), {"dense": 1.0, "bm25": 0.3})
    return ranking.ranked(scores, ["query_id"], [F.desc(F.round("score", 9)), "comment_id"]).select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


_STAGES = """SELECT query_id, comment_id, 0 AS stage, min(rank * 3 + CASE route WHEN 'sbert' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END) AS place, 'top' AS rule FROM routes WHERE rank <= 5 GROUP BY query_id, comment_id
UNION ALL SELECT query_id, comment_id, 1, place, 'only_length' FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM routes r WHERE route = 'length' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.query_id = r.query_id AND o.comment_id = r.comment_id AND o.route IN ('sbert', 'lexical') AND o.rank <= 20)) WHERE place <= 3
UNION ALL SELECT query_id, comment_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id), 'rrf' FROM (SELECT query_id, comment_id, sum(1.0 / (60 + rank)) AS score FROM routes GROUP BY ALL)"""


@query("e17_union_pool", sql("SELECT query_id, comment_id, CAST(pos AS BIGINT) AS pos, rules FROM (SELECT query_id, comment_id, rules, row_number() OVER (PARTITION BY query_id ORDER BY o, comment_id) AS pos FROM (SELECT query_id, comment_id, min(stage * 1000000 + place) AS o, string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules FROM stages GROUP BY ALL)) WHERE pos <= 30", "routes", stages=_STAGES))
def e17(spark: SparkSession, d: str) -> DataFrame:
    p = pools.union_pool(t.routes(spark, d), ["sbert", "lexical", "length"], ["length"])
    return p.select(*PAIR, F.col("pos").cast("bigint").alias("pos"), "rules")


@query("e16_mother_pool")
def e16(spark: SparkSession, d: str) -> DataFrame:
    """Core heads, exclusives, disagreements, then the fused order up to 30."""
    run = t.routes(spark, d)
    heads = run.filter("route IN ('sbert', 'lexical') AND rank <= 3").groupBy(*PAIR).agg(F.min("rank").alias("at"))
    alone = setops.exclusives(run, "length", 3, ["sbert", "lexical"], 20).withColumnRenamed("rank", "at")
    apart = pools.disagreements(run, "sbert", "lexical", 10, 30)
    fused = ranking.ranked(fusion.rrf_scores(run), ["query_id"], [F.desc("score"), "comment_id"], "at")
    return pools.staged_pool([("core", heads), ("exclusive", alone), ("disagreement", apart), ("rrf", fused)], 30)


@query(
    "e24_protected_tail",
    sql(
        "SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, 0 AS part, rank AS place FROM routes WHERE route = 'sbert' AND rank <= 5 UNION ALL SELECT query_id, comment_id, 1, place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 5 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE place <= 3)",
        "routes",
    ),
)
def e24(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d)
    return fusion.protected_tail(run.filter("route = 'sbert'"), run.filter("route = 'lexical'"), 3).select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("e29_rank_prior", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, comment_id) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, sum(CASE route WHEN 'sbert' THEN 0.175 ELSE 0.825 END / (60 + rank)) AS score FROM routes WHERE route IN ('sbert', 'lexical') GROUP BY ALL)", "routes"))
def e29(spark: SparkSession, d: str) -> DataFrame:
    """The entry order by similarity as a prior of a lexical model's scores."""
    run = t.routes(spark, d)
    fused = fusion.rank_prior(run.filter("route = 'sbert'").drop("route"), run.filter("route = 'lexical'"), "rrf", 0.175).drop("rank")
    return ranking.ranked(fused, ["query_id"], [F.desc(F.round("score", 9)), "comment_id"]).select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("e32_residual_slots")
def e32(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d)
    return fusion.residual_slots(run.filter("route = 'sbert'"), run.filter("route = 'lexical'"), 8, 2)


@query("e44_depth_percentile", sql("SELECT query_id, comment_id, round(CASE WHEN dense_rank IS NULL THEN 0.0 WHEN dense_rank BETWEEN 1 AND 50 THEN 1 - (dense_rank - 1) / 49.0 END, 6) AS value FROM pool", "pool"))
def e44(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).select(*PAIR, r6(ranking.depth_percentile(F.col("dense_rank"), 50), "value"))


@query(
    "e45_cosine_votes",
    "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM u), "
    "s AS (SELECT q.vec_id AS query_id, c.vec_id AS c, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank FROM n q, n c WHERE q.vec_id % 50 = 0), "
    "w AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM s WHERE rank <= 7 GROUP BY ALL) SELECT query_id, CAST(label AS BIGINT) AS label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) AS p FROM w) WHERE p = 1",
)
def e45(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.functions.vectors import l2_normalized

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("comment_id"), "label", l2_normalized(F.col("embedding")).alias("vec"))
    asked = rows.filter("comment_id % 50 = 0").select(F.col("comment_id").alias("query_id"), "vec")
    return ranking.cosine_votes(asked, rows, 7).select("query_id", F.col("label").cast("bigint").alias("label"), "votes")


_THREADS = "SELECT link_id, count(*) AS n, max(score) AS top FROM notes GROUP BY 1"
_TIER = "CASE WHEN n >= 16 THEN 'deep' WHEN n >= 4 THEN 'mid' WHEN n >= 1 THEN 'shallow' ELSE 'none' END"


@query("e46_tier_quota", sql(f"SELECT tier, link_id, n, CAST(pick AS BIGINT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, top DESC NULLS LAST, link_id) AS pick FROM (SELECT *, {_TIER} AS tier FROM threads)) WHERE pick <= 40", "notes", threads=_THREADS))
def e46(spark: SparkSession, d: str) -> DataFrame:
    threads = t.comments(spark, d).groupBy("link_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).withColumn("tier", sampling.tier_of(F.col("n")))
    return sampling.quota(threads, ["tier"], [F.desc("n"), F.desc_nulls_last("top"), "link_id"], 40).select("tier", "link_id", "n", F.col("pick").cast("bigint").alias("pick"))


@query("e47_comments_per_post", sql(f"SELECT link_id, comment_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY score DESC NULLS LAST, comment_id) AS rank FROM notes) x JOIN (SELECT link_id, {_TIER} AS tier FROM threads) USING (link_id) WHERE rank <= 5 OR tier = 'deep'", "notes", threads=_THREADS))
def e47(spark: SparkSession, d: str) -> DataFrame:
    """Comments by score, five of each thread that is not deep, all of the deep ones."""
    c = t.comments(spark, d).select("link_id", "comment_id", "score")
    tiers = c.groupBy("link_id").agg(F.count(F.lit(1)).alias("n")).select("link_id", "n", sampling.tier_of(F.col("n")).alias("tier"))
    sized = lookup_skewed(c.filter("link_id IS NOT NULL"), tiers, "link_id", "n")
    order = [F.desc_nulls_last("score"), "comment_id"]
    deep, other = ranking.ranked_split(sized.filter("tier = 'deep'"), ["link_id"], order), ranking.top_k(sized.filter("tier <> 'deep'"), ["link_id"], order, 5)
    return deep.unionByName(other).select("link_id", "comment_id", F.col("rank").cast("bigint").alias("rank"))


@query("e49_slots")
def e49(spark: SparkSession, d: str) -> DataFrame:
    """Per query one item for each of three slots, then the best others up to five."""
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    wanted = {"useful": F.col("utility") >= 5, "uncertain": F.col("utility").between(3, 5), "novel": F.col("novelty") >= 0.5}
    return sampling.slots(rows, "query_id", "comment_id", wanted, [F.desc("sbert"), "comment_id"], 5)


@query("e50_best_rank", sql("SELECT query_id, comment_id, CAST(coalesce(least(min(CASE WHEN route = 'dense' THEN rank END), 9999), 9999) AS BIGINT) AS dense, CAST(coalesce(min(rank), 9999) AS BIGINT) AS best FROM run GROUP BY ALL", "run"))
def e50(spark: SparkSession, d: str) -> DataFrame:
    wide = t.run(spark, d).groupBy(*PAIR).agg(F.min(F.when(F.col("route") == "dense", F.col("rank"))).alias("a"), F.min(F.when(F.col("route") == "bm25", F.col("rank"))).alias("b"))
    return wide.select(*PAIR, ranking.best_rank(F.col("a")).cast("bigint").alias("dense"), ranking.best_rank(F.col("a"), F.col("b")).cast("bigint").alias("best"))


# lists that depend on the order of taking


@query("d4_round_robin")
def d4(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d)
    return pools.round_robin(run, ["lexical", "length"], run.filter("route = 'sbert' AND rank <= 8"), 4)


@query("d6_interleave")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return pools.interleave(t.routes(spark, d), "sbert", "lexical", 0.7, 20)


@query("o64_matched_pool", sql("SELECT query_id, comment_id, CAST(pos AS BIGINT) AS pos FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY o, comment_id) AS pos FROM (SELECT query_id, comment_id, min(o) AS o FROM (SELECT query_id, comment_id, CASE WHEN rank <= 16 THEN rank ELSE 2000000 + rank END AS o FROM routes WHERE route = 'sbert' UNION ALL SELECT query_id, comment_id, 1000000 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 16 AND o.query_id = r.query_id AND o.comment_id = r.comment_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) <= 4) GROUP BY ALL)) WHERE pos <= 20", "routes"))
def o64(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d)
    return pools.matched_pool(run.filter("route = 'sbert'"), run.filter("route = 'lexical'"), 20, 4).select(*PAIR, F.col("pos").cast("bigint").alias("pos"))
