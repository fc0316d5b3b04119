"""Queries of bands, flags, alternative pools, sensitivity of gold rules, contrasts and workloads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.functions import text as tx
from rankloom.functions.vectors import l2_normalized
from rankloom.operators import metrics, pools, ranking, sampling, selection, setops, stats

from . import tables as t
from .measure_queries import _IDEAL, _LABELLED, labelled, rounded
from .record_queries import _CANON
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


BANDS = [(1, 8, "head"), (9, 20, "middle"), (21, 50, "deep"), (51, 100, "tail")]


@query("b4_rank_bands", sql("SELECT route, CASE WHEN rank BETWEEN 1 AND 8 THEN 'head' WHEN rank BETWEEN 9 AND 20 THEN 'middle' WHEN rank BETWEEN 21 AND 50 THEN 'deep' WHEN rank BETWEEN 51 AND 100 THEN 'tail' END AS band, count(*) AS n FROM run GROUP BY ALL", "run"))
def b4(spark: SparkSession, d: str) -> DataFrame:
    return t.run(spark, d).groupBy("route", ranking.rank_band(F.col("rank"), BANDS).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("b6_route_categories", sql("SELECT category, count(*) AS pairs FROM (SELECT CASE WHEN bool_or(route = 'dense') AND bool_or(route = 'bm25') THEN 'both' WHEN bool_or(route = 'dense') THEN 'dense_only' WHEN bool_or(route = 'bm25') THEN 'bm25_only' ELSE 'none' END AS category FROM run GROUP BY query_id, comment_id) GROUP BY 1", "run"))
def b6(spark: SparkSession, d: str) -> DataFrame:
    m = setops.memberships(t.run(spark, d))
    has = lambda r: F.array_contains("routes", r)
    return m.groupBy(F.when(has("dense") & has("bm25"), "both").when(has("dense"), "dense_only").when(has("bm25"), "bm25_only").otherwise("none").alias("category")).agg(F.count(F.lit(1)).alias("pairs"))


@query("b7_mismatch_types", sql("SELECT mismatch, count(*) AS n FROM (SELECT CASE WHEN label_safety <= 2 THEN 'safety' WHEN label_relevance <= 3 THEN 'semantic_context' WHEN label_usefulness <= 3 THEN 'support_quality' END AS mismatch FROM judged) GROUP BY 1", "judged"))
def b7(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label_safety") <= 2, "safety").when(F.col("label_relevance") <= 3, "semantic_context").when(F.col("label_usefulness") <= 3, "support_quality")
    return t.judged(spark, d).groupBy(kind.alias("mismatch")).agg(F.count(F.lit(1)).alias("n"))


@query("b11_reasonable", sql("SELECT query_id, comment_id FROM judged WHERE label_relevance >= 4 AND label_usefulness >= 4 AND label_safety >= 4", "judged"))
def b11(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).filter("label_relevance >= 4 AND label_usefulness >= 4 AND label_safety >= 4").select(*PAIR)


@query("c9_view_union", sql("SELECT query_id, comment_id, bool_or(source_pool = 'dense50') AS in_dense, bool_or(source_pool = 'graph4') AS in_graph, bool_or(source_pool = 'rrf3') AS in_fused, count(DISTINCT source_pool) AS views FROM candidate_features WHERE query_id IS NOT NULL AND comment_id IS NOT NULL GROUP BY ALL"))
def c9(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda v: F.bool_or(F.col("source_pool") == v)
    return table(spark, d, "candidate_features").filter("query_id IS NOT NULL AND comment_id IS NOT NULL").groupBy(*PAIR).agg(is_("dense50").alias("in_dense"), is_("graph4").alias("in_graph"), is_("rrf3").alias("in_fused"), F.count_distinct("source_pool").alias("views"))


@query("c16_source_flags", sql("SELECT query_id, comment_id, coalesce(rank <= 8, false) AS in_d8, dense_rank IS NOT NULL AS in_dense, source_pool = 'graph4' AS in_graph, source_pool = 'graph4' AND dense_rank IS NULL AS graph_added FROM pool LEFT JOIN (SELECT query_id, comment_id, rank FROM routes WHERE route = 'sbert') USING (query_id, comment_id)", "routes"))
def c16(spark: SparkSession, d: str) -> DataFrame:
    head = t.routes(spark, d).filter("route = 'sbert'").select(*PAIR, "rank")
    graph = F.col("source_pool") == "graph4"
    return t.pool(spark, d).join(head, PAIR, "left").select(*PAIR, F.coalesce(F.col("rank") <= 8, F.lit(False)).alias("in_d8"), F.col("dense_rank").isNotNull().alias("in_dense"), graph.alias("in_graph"), (graph & F.col("dense_rank").isNull()).alias("graph_added"))


_TOP4 = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id)"


@query(
    "c17_rescue_pools",
    sql(
        f"SELECT 'deep' AS pool, query_id, comment_id FROM (SELECT *, {_TOP4} AS p FROM routes WHERE route = 'sbert' AND rank > 8) WHERE p <= 4 UNION ALL SELECT 'practical', query_id, comment_id FROM (SELECT *, {_TOP4} AS p FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 8 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE p <= 4 "
        f"UNION ALL SELECT 'exclusive', query_id, comment_id FROM (SELECT *, {_TOP4} AS p FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 30 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE p <= 4",
        "routes",
    ),
)
def c17(spark: SparkSession, d: str) -> DataFrame:
    """Pools of four: deeper in the same route, another route, and only in the other route."""
    run = t.routes(spark, d)
    deep = ranking.top_k(run.filter("route = 'sbert' AND rank > 8").drop("rank"), ["query_id"], [F.desc("score"), "comment_id"], 4)
    parts = {"deep": deep, "practical": setops.exclusives(run, "lexical", 4, ["sbert"], 8), "exclusive": setops.exclusives(run, "lexical", 4, ["sbert"], 30)}
    out = None
    for name, p in parts.items():
        part = p.select(F.lit(name).alias("pool"), *PAIR)
        out = part if out is None else out.unionByName(part)
    return out


@query("c23_source_contests", sql("SELECT a.query_id, count(*) AS pairs, count(*) FILTER (a.utility > b.utility) AS wins, count(*) FILTER (a.utility < b.utility) AS losses FROM l a JOIN l b ON a.query_id = b.query_id AND a.source_pool = 'graph4' AND b.source_pool = 'dense50' AND abs(a.utility - b.utility) >= 1 GROUP BY 1", "pool", "judged", l=_LABELLED))
def c23(spark: SparkSession, d: str) -> DataFrame:
    """How graph candidates fare against dense ones of the same query, where utilities differ by 1 or more."""
    l = labelled(spark, d)
    a = l.filter("source_pool = 'graph4'").select("query_id", F.col("utility").alias("ua"))
    b = l.filter("source_pool = 'dense50'").select("query_id", F.col("utility").alias("ub"))
    pairs = a.join(b, "query_id").filter(F.abs(F.col("ua") - F.col("ub")) >= 1)
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("ua") > F.col("ub")).alias("wins"), F.count_if(F.col("ua") < F.col("ub")).alias("losses"))


# gold rules

RULES = {"useful": "utility >= 4.0", "good": "utility >= 4.5", "high": "utility >= 5.0"}
_RULES = " UNION ALL ".join(f"SELECT '{n}' AS rule, query_id, comment_id FROM judged WHERE {c}" for n, c in RULES.items()) + " UNION ALL SELECT 'top3', query_id, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS p FROM judged WHERE utility IS NOT NULL) WHERE p <= 3"


def gold_rules(spark: SparkSession, d: str) -> DataFrame:
    j = t.judged(spark, d)
    parts = [j.filter(c).select(F.lit(n).alias("rule"), *PAIR) for n, c in RULES.items()]
    parts.append(ranking.top_k(j.filter("utility IS NOT NULL"), ["query_id"], [F.desc("utility"), "comment_id"], 3).select(F.lit("top3").alias("rule"), *PAIR))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("d17_gold_rules", sql("SELECT * FROM r", "judged", r=_RULES))
def d17(spark: SparkSession, d: str) -> DataFrame:
    return gold_rules(spark, d)


@query("h20_gold_sensitivity", sql("SELECT rule, route, round(recall, 6) AS recall, rank() OVER (PARTITION BY rule ORDER BY round(recall, 9) DESC) AS place FROM (SELECT rule, route, avg(h / CAST(n AS DOUBLE)) AS recall FROM (SELECT g.rule, o.route, g.query_id, count(*) FILTER (o.rank <= 8) AS h FROM r g JOIN routes o USING (query_id, comment_id) GROUP BY ALL) JOIN (SELECT rule, query_id, count(*) AS n FROM r GROUP BY ALL) USING (rule, query_id) GROUP BY ALL)", "routes", "judged", r=_RULES))
def h20(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each route under each rule of what is gold, and the routes' places; queries whose gold the pool holds."""
    g = gold_rules(spark, d)
    n = g.groupBy("rule", "query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = g.join(t.routes(spark, d), PAIR).groupBy("rule", "route", "query_id").agg(F.count_if(F.col("rank") <= 8).alias("h"))
    means = hits.join(n, ["rule", "query_id"]).groupBy("rule", "route").agg(F.avg(F.col("h") / F.col("n")).alias("recall"))
    return means.select("rule", "route", F.round("recall", 6).alias("recall"), F.rank().over(W.partitionBy("rule").orderBy(F.desc(F.round("recall", 9)))).cast("bigint").alias("place"))


@query("h12_joint", sql("SELECT route, round(avg(CASE WHEN inside = n THEN 1.0 ELSE 0.0 END), 6) AS joint FROM (SELECT route, query_id, count(*) FILTER (rank <= 20) AS inside, count(*) AS n FROM gold JOIN routes USING (query_id, comment_id) GROUP BY ALL) GROUP BY 1", "routes", "gold"))
def h12(spark: SparkSession, d: str) -> DataFrame:
    per = t.gold(spark, d).join(t.routes(spark, d), PAIR).groupBy("route", "query_id").agg(F.count_if(F.col("rank") <= 20).alias("inside"), F.count(F.lit(1)).alias("n"))
    return rounded(per.groupBy("route").agg(F.avg((F.col("inside") == F.col("n")).cast("double")).alias("joint")))


_SAME = "SELECT r.route, r.query_id, r.rank, coalesce(n.post = x.own, false) AS same FROM run r LEFT JOIN (SELECT comment_id, regexp_replace(link_id, '^t[13]_', '') AS post FROM notes) n USING (comment_id) LEFT JOIN (SELECT query_id, lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) AS own FROM texts) x USING (query_id)"


@query("h15_same_post_share", sql("SELECT route, CAST(k AS BIGINT) AS k, round(avg(s), 6) AS share FROM (SELECT route, query_id, k, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS s FROM x1, (SELECT unnest([5, 8, 10]) AS k) WHERE rank <= k GROUP BY ALL) GROUP BY ALL", "run", "notes", "texts", x1=_SAME))
def h15(spark: SparkSession, d: str) -> DataFrame:
    """The share of candidates from the query's own post at several depths."""
    posts = t.comments(spark, d).select("comment_id", tx.bare_id(F.col("link_id")).alias("post"))
    own = t.texts(spark, d).select("query_id", F.lower(F.trim(F.regexp_replace("post_id", "(?i)^t[13]_", ""))).alias("own"))
    run = t.run(spark, d).join(posts, "comment_id", "left").join(own, "query_id", "left").withColumn("same", F.coalesce(F.col("post") == F.col("own"), F.lit(False)).cast("double"))
    per = run.withColumn("k", F.explode(F.array(F.lit(5), F.lit(8), F.lit(10)))).filter("rank <= k").groupBy("route", "query_id", "k").agg(F.avg("same").alias("s"))
    return rounded(per.groupBy("route", "k").agg(F.avg("s").alias("share")))


@query("h38_set_sources", sql("SELECT route, round(avg(CASE WHEN source_pool = 'graph4' THEN 1.0 ELSE 0.0 END), 6) AS graph_share, round(avg(novelty), 6) AS novelty FROM routes JOIN pool USING (query_id, comment_id) WHERE rank <= 8 GROUP BY 1", "routes"))
def h38(spark: SparkSession, d: str) -> DataFrame:
    rows = t.routes(spark, d).filter("rank <= 8").join(t.pool(spark, d).select(*PAIR, "source_pool", "novelty"), PAIR)
    return rounded(rows.groupBy("route").agg(F.avg((F.col("source_pool") == "graph4").cast("double")).alias("graph_share"), F.avg("novelty").alias("novelty")))


# orders


@query("e22_graph_extension", sql("SELECT query_id, comment_id, round(sbert, 6) AS score FROM pool p WHERE source_pool = 'graph4' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 8 AND o.query_id = p.query_id AND o.comment_id = p.comment_id)", "routes"))
def e22(spark: SparkSession, d: str) -> DataFrame:
    head = t.routes(spark, d).filter("route = 'sbert' AND rank <= 8").select(*PAIR)
    return t.pool(spark, d).filter("source_pool = 'graph4'").join(head, PAIR, "left_anti").select(*PAIR, F.round("sbert", 6).alias("score"))


@query("e36_without_graph", sql("SELECT query_id, comment_id, CAST(p AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sbert DESC, comment_id) AS p FROM pool WHERE source_pool <> 'graph4') WHERE p <= 8", "pool"))
def e36(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(t.pool(spark, d).filter("source_pool <> 'graph4'"), ["query_id"], [F.desc("sbert"), "comment_id"], 8).select(*PAIR, F.col("rank").cast("bigint").alias("rank"))


@query("e42_scaled_subset", sql("SELECT query_id, comment_id, round(CASE WHEN max(sbert) OVER w <= min(sbert) OVER w THEN 0.0 ELSE (sbert - min(sbert) OVER w) / (max(sbert) OVER w - min(sbert) OVER w) END, 6) AS value FROM pool WHERE source_pool = 'graph4' WINDOW w AS (PARTITION BY query_id)", "pool"))
def e42(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).filter("source_pool = 'graph4'").select(*PAIR, F.round(ranking.minmax(F.col("sbert"), ["query_id"], 0.0), 6).alias("value"))


@query("e16_disagreements", sql("SELECT query_id, comment_id, CAST(least(coalesce(a, 9999), coalesce(b, 9999)) AS BIGINT) AS place, CASE WHEN a <= 10 AND (b IS NULL OR b > 30) THEN 'sbert_high' ELSE 'lexical_high' END AS kind FROM (SELECT query_id, comment_id, min(rank) FILTER (route = 'sbert') AS a, min(rank) FILTER (route = 'lexical') AS b FROM routes GROUP BY ALL) WHERE (a <= 10 AND (b IS NULL OR b > 30)) OR (b <= 10 AND (a IS NULL OR a > 30))", "routes"))
def e16d(spark: SparkSession, d: str) -> DataFrame:
    return pools.disagreements(t.routes(spark, d), "sbert", "lexical", 10, 30).select(*PAIR, F.col("at").cast("bigint").alias("place"), "kind")


@query(
    "g13_prototypes",
    "WITH n AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings), e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n), m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY 1), "
    "s AS (SELECT vec_id, n.label AS stored, m.label, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS s FROM n, m) SELECT CAST(stored AS BIGINT) AS stored, CAST(label AS BIGINT) AS label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS p FROM s) WHERE p = 1 GROUP BY ALL",
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the nearest class mean of unit vectors, against the stored labels; class means are few and broadcast."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", l2_normalized(F.col("embedding")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).select(F.col("label").alias("guess"), l2_normalized(F.col("c")).alias("c"))
    from rankloom.functions.vectors import dot

    scored = rows.crossJoin(F.broadcast(means)).withColumn("s", F.round(dot(F.col("v"), F.col("c")), 9))
    best = scored.groupBy("vec_id", "label").agg(F.max(F.struct("s", (-F.col("guess")).alias("g"))).alias("b"))
    return best.groupBy(F.col("label").cast("bigint").alias("stored"), (-F.col("b.g")).cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# contrasts


@query("i27_contrasts", sql("SELECT a.route || '-' || b.route AS contrast, count(*) AS n, count(*) FILTER (a.v - b.v > 1e-12) AS wins, count(*) FILTER (abs(a.v - b.v) <= 1e-12) AS ties, count(*) FILTER (a.v - b.v < -1e-12) AS losses, round(avg(a.v - b.v), 6) AS mean_delta FROM per a JOIN per b ON a.query_id = b.query_id AND a.route < b.route GROUP BY 1", "routes", "judged", per="SELECT route, r.query_id, avg(utility) AS v FROM routes r JOIN judged USING (query_id, comment_id) WHERE rank <= 8 AND utility IS NOT NULL GROUP BY ALL"))
def i27(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of routes by the mean utility of what is judged among their first eight."""
    per = t.routes(spark, d).filter("rank <= 8").join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).groupBy("route", "query_id").agg(F.avg("utility").alias("v"))
    out = None
    for a, b in (("length", "lexical"), ("length", "sbert"), ("lexical", "sbert")):
        part = stats.win_tie_loss(stats.paired(per, "route", a, b, "v"), []).select(F.lit(f"{a}-{b}").alias("contrast"), "n", "wins", "ties", "losses", "mean_delta")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("i38_policy_arm")
def i38(spark: SparkSession, d: str) -> DataFrame:
    """What acting on a lexical margin gains, harms and misses against the best possible swap."""
    run = t.routes(spark, d)
    judged = t.judged(spark, d).select(*PAIR, "utility")
    actions = selection.one_swap_actions(run.filter("route = 'sbert' AND rank <= 8"), setops.exclusives(run, "lexical", 4, ["sbert"], 8), judged)
    lexical = run.filter("route = 'lexical'").select("query_id", F.col("comment_id").alias("candidate_id"), F.col("score").alias("model"))
    chosen = selection.best_action(actions.join(lexical, ["query_id", "candidate_id"], "left").withColumn("model", F.coalesce("model", F.when(F.col("action_id") == "NOOP", 0.25))), "model")
    best = actions.groupBy("query_id").agg(F.max("reward").alias("best"))
    r = chosen.join(best, "query_id")
    acted = F.col("action_id") != "NOOP"
    return rounded(r.agg(F.count(F.lit(1)).alias("queries"), F.avg(acted.cast("double")).alias("action_rate"), F.avg("reward").alias("mean_reward"), F.avg((acted & (F.col("reward") < 0)).cast("double")).alias("harm_rate"), F.avg(F.col("best") - F.col("reward")).alias("regret")))


@query("i43_strata", sql("SELECT stratum, count(*) AS queries, round(avg(ndcg), 6) AS ndcg FROM (SELECT query_id, ndcg, unnest(['all', coalesce(tier, 'UNKNOWN')]) AS stratum FROM per LEFT JOIN texts USING (query_id) WHERE route = 'sbert') GROUP BY 1", "routes", "judged", "texts", ideal=_IDEAL, per="SELECT route, query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM (SELECT route, r.query_id, sum(coalesce((pow(2.0, greatest(utility, 0.0)) - 1), 0) / log2(rank + 1)) AS dcg FROM routes r LEFT JOIN judged j USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL) LEFT JOIN ideal USING (query_id)"))
def i43(spark: SparkSession, d: str) -> DataFrame:
    """nDCG over all queries and by tier: each query counts in the strata it belongs to."""
    per = metrics.graded_ndcg(t.routes(spark, d).filter("route = 'sbert'"), t.judged(spark, d), 8).join(t.texts(spark, d).select("query_id", "tier"), "query_id", "left")
    each = per.withColumn("stratum", F.explode(F.array(F.lit("all"), F.coalesce("tier", F.lit("UNKNOWN")))))
    return rounded(each.groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"), F.avg("ndcg").alias("ndcg")))


@query("j6_anchors", sql("SELECT query_id, comment_id, CAST(turn AS BIGINT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY band, source_pool, known ORDER BY CAST(('0x' || substr(md5(pair || '#7'), 1, 15)) AS BIGINT), pair) AS turn FROM (SELECT query_id, comment_id, source_pool, query_id || '/' || comment_id AS pair, CASE WHEN rank BETWEEN 1 AND 8 THEN 'head' WHEN rank BETWEEN 9 AND 20 THEN 'middle' ELSE 'deep' END AS band, utility IS NOT NULL AS known FROM pool JOIN (SELECT query_id, comment_id, rank FROM routes WHERE route = 'sbert') USING (query_id, comment_id) LEFT JOIN judged USING (query_id, comment_id))) ORDER BY turn, band, source_pool, known LIMIT 50", "routes", "judged"))
def j6(spark: SparkSession, d: str) -> DataFrame:
    """Fifty pairs in turns over bands of rank, source and whether they are judged."""
    head = t.routes(spark, d).filter("route = 'sbert'").select(*PAIR, "rank")
    rows = t.pool(spark, d).join(head, PAIR).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    band = F.when(F.col("rank").between(1, 8), "head").when(F.col("rank").between(9, 20), "middle").otherwise("deep")
    rows = rows.select(*PAIR, "source_pool", F.concat_ws("/", *PAIR).alias("pair"), band.alias("band"), F.col("utility").isNotNull().alias("known"))
    return sampling.balanced(rows, ["band", "source_pool", "known"], "pair", 50).select(*PAIR, F.col("turn").cast("bigint").alias("turn"))


@query("l11_encoding_workload", sql(f"SELECT count(*) AS texts, count(*) FILTER (NOT cached) AS to_encode FROM (SELECT h, h IN (SELECT sha256({_CANON.format(c='query_text')}) FROM queries WHERE query_text IS NOT NULL) AS cached FROM (SELECT DISTINCT sha256({_CANON.format(c='comment_text')}) AS h FROM comments WHERE comment_text IS NOT NULL AND trim(comment_text) <> ''))"))
def l11(spark: SparkSession, d: str) -> DataFrame:
    """Different comment texts, and those whose digest is not yet among the queries' (as a cache of vectors)."""
    h = table(spark, d, "comments").filter("comment_text IS NOT NULL AND trim(comment_text) <> ''").select(tx.text_digest(F.col("comment_text")).alias("h")).distinct()
    cache = table(spark, d, "queries").filter("query_text IS NOT NULL").select(tx.text_digest(F.col("query_text")).alias("h")).distinct().withColumn("cached", F.lit(1))
    return h.join(cache, "h", "left").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("cached").isNull()).alias("to_encode"))


@query("m5_payload_digests", sql("SELECT count(*) AS pairs, count(DISTINCT h) AS payloads FROM (SELECT sha256(coalesce(query_text, '') || chr(31) || coalesce(comment_text, '')) AS h FROM pool JOIN texts USING (query_id) JOIN notes USING (comment_id))", "pool", "texts", "notes"))
def m5(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to judge and the different payloads a judge would see."""
    q, c = t.texts(spark, d).select("query_id", "query_text"), t.comments(spark, d).select("comment_id", "comment_text")
    rows = t.pool(spark, d).select(*PAIR).join(q, "query_id").join(c, "comment_id")
    digest = F.sha2(F.concat(F.coalesce("query_text", F.lit("")), F.lit("\x1f"), F.coalesce("comment_text", F.lit(""))), 256)
    return rows.select(digest.alias("h")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("h").alias("payloads"))


@query("o10_sampling_profile", sql("SELECT coalesce(scenario, 'UNKNOWN') AS scenario, coalesce(tier, 'UNKNOWN') AS tier, count(*) AS n, count(*) FILTER (drug_related = 1) AS drug_related FROM texts GROUP BY ALL", "texts"))
def o10(spark: SparkSession, d: str) -> DataFrame:
    return t.texts(spark, d).groupBy(F.coalesce("scenario", F.lit("UNKNOWN")).alias("scenario"), F.coalesce("tier", F.lit("UNKNOWN")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("drug_related") == 1).alias("drug_related"))


@query("f27_pool_summary", sql("SELECT source_pool, count(*) AS size, count(utility) AS judged, round(avg(utility), 6) AS mean_utility, round(quantile_cont(utility, 0.5), 6) AS median_utility, round(avg(CASE WHEN utility >= 4.5 THEN 1.0 WHEN utility < 4.5 THEN 0.0 END), 6) AS useful FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) GROUP BY 1", "pool", "judged"))
def f27(spark: SparkSession, d: str) -> DataFrame:
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return rounded(rows.groupBy("source_pool").agg(F.count(F.lit(1)).alias("size"), F.count("utility").alias("judged"), F.avg("utility").alias("mean_utility"), F.percentile("utility", 0.5).alias("median_utility"), F.avg((F.col("utility") >= 4.5).cast("double")).alias("useful")))


def _hashed_vectors(rows: DataFrame, keys: list[str], text: str, size: int = 128) -> DataFrame:
    """(keys, vec): unit vectors of texts' token counts by hash; they stand in for an encoder, of which there is none
    here. Texts without tokens have the zero vector."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for words in b["__t"]:
                v = np.bincount([zlib.crc32(w.encode()) % size for w in words], minlength=size).astype(float)
                out.append(v / max(float(np.linalg.norm(v)), 1e-12))
            yield b[keys].assign(vec=out)

    tokens = rows.select(*keys, tx.tokens(F.col(text)).alias("__t"))
    return tokens.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", vec array<double>")


def _alignment_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of each query with reference replies: the eight comments of its candidate pool or, without one, of its own post's
    thread with the largest scores; and its valid replies."""
    own = t.texts(spark, d).select("query_id", F.concat(F.lit("t3_"), F.lower(F.trim(F.regexp_replace("post_id", "(?i)^t[13]_", "")))).alias("link_id"))
    c = t.comments(spark, d).filter("length(comment_text) >= 20").select("comment_id", "link_id", "comment_text", "score")
    first = ranking.top_k(c.select("link_id", "comment_id", "score"), ["link_id"], [F.desc_nulls_last("score"), "comment_id"], 8)
    thread = own.join(first, "link_id").select(*PAIR, F.lit(1).alias("source"), "rank")
    pool = t.routes(spark, d).filter("route = 'sbert' AND rank <= 8").select(*PAIR, F.lit(0).alias("source"), "rank")
    both = thread.unionByName(pool)
    first = both.groupBy("query_id").agg(F.min("source").alias("source"))
    chosen = both.join(first, ["query_id", "source"]).select(*PAIR).join(c.select("comment_id", "comment_text"), "comment_id")
    r = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r")).select("query_id", "r.reply_id", "r.text").filter("length(text) >= 20").dropDuplicates(["query_id", "reply_id"])
    return _hashed_vectors(chosen, PAIR, "comment_text"), _hashed_vectors(r, ["query_id", "reply_id"], "text")


@query("g35_alignment")
def g35(spark: SparkSession, d: str) -> DataFrame:
    c, r = _alignment_inputs(spark, d)
    return rounded(metrics.alignment(c, r, 0.5))


@query("g37_cluster_balanced_coverage")
def g37(spark: SparkSession, d: str) -> DataFrame:
    c, r = _alignment_inputs(spark, d)
    return rounded(metrics.cluster_balanced_coverage(c, r))
