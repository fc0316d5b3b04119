"""Queries of orders, named systems, oracles and one-swap decisions, and the SQL of selections defined elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.functions import text as tx
from rankloom.functions import utility as ut
from rankloom.operators import fusion, metrics, ranking, selection

from . import tables as t
from .contract_queries import _ACTIONS, swap_inputs
from .measure_queries import bootstrapped
from .scan_queries import big, r6
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


def union(parts: dict[str, DataFrame], name: str, columns: list) -> DataFrame:
    out = None
    for k, p in parts.items():
        part = p.select(F.lit(k).alias(name), *columns)
        out = part if out is None else out.unionByName(part)
    return out


# orders


@query("e2_scored_rows", sql("SELECT backend AS route, query_id, count(*) AS n, round(sum(coalesce(CASE WHEN NOT isnan(score) THEN score END, 0.0)), 6) AS total FROM retrieval_runs WHERE query_id IS NOT NULL AND trim(coalesce(comment_id, '')) <> '' GROUP BY ALL"))
def e2(spark: SparkSession, d: str) -> DataFrame:
    """Rows of stored runs as ids and scores: a missing score is 0, a row without an id is left out."""
    rows = table(spark, d, "retrieval_runs").filter(F.col("query_id").isNotNull() & (F.trim(F.coalesce("comment_id", F.lit(""))) != ""))
    return rows.groupBy(F.col("backend").alias("route"), "query_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.coalesce(t.number("score"), F.lit(0.0))), "total"))


_MM = "CASE WHEN max({c}) OVER w - min({c}) OVER w <= 0 THEN {k} ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
_ZS = "CASE WHEN stddev_pop({c}) OVER w <= 0 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END"
_RP = "CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY route, query_id ORDER BY {c}, comment_id) - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) END"


@query("e8_normalisers", sql(f"SELECT route, query_id, comment_id, round({_MM.format(c='score', k=1.0)}, 6) AS minmax, round({_ZS.format(c='score')}, 6) AS zscore, round({_RP.format(c='score')}, 6) AS rank_percentile FROM routes WINDOW w AS (PARTITION BY route, query_id)", "routes"))
def e8(spark: SparkSession, d: str) -> DataFrame:
    """Every normaliser by its name."""
    names = ("minmax", "zscore", "rank_percentile")
    return t.routes(spark, d).select("route", *PAIR, *[r6(ranking.normalized(F.col("score"), "comment_id", ranking.KEYS, n), n) for n in names])


_SEEN3 = "SELECT query_id, comment_id, min(CASE route WHEN 'sbert' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END * 1000000 + rank) AS seen FROM routes GROUP BY ALL"
_RRF3 = "SELECT query_id, comment_id, sum(CASE route WHEN 'sbert' THEN 1.0 WHEN 'lexical' THEN 0.5 ELSE 0.25 END / (60 + rank)) AS score FROM routes GROUP BY ALL"
_CC3 = f"SELECT query_id, comment_id, sum(CASE route WHEN 'sbert' THEN 0.5 WHEN 'lexical' THEN 0.3 ELSE 0.2 END * v) AS score FROM (SELECT *, {_ZS.format(c='score')} AS v FROM routes WINDOW w AS (PARTITION BY route, query_id)) GROUP BY ALL"


@query("e11_fusion_modes", sql("SELECT mode, query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM (SELECT mode, s.query_id, s.comment_id, row_number() OVER (PARTITION BY mode, s.query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM (SELECT 'rrf' AS mode, * FROM a UNION ALL SELECT 'cc', * FROM b) s JOIN seen USING (query_id, comment_id)) WHERE rank <= 8", "routes", a=_RRF3, b=_CC3, seen=_SEEN3))
def e11(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of three routes by either mode; equal scores keep the order in which the routes meet them."""
    run, order = t.routes(spark, d), ["sbert", "lexical", "length"]
    rrf = fusion.rrf_scores(run, {"sbert": 1.0, "lexical": 0.5, "length": 0.25})
    cc = fusion.cc_scores(run, {"sbert": 0.5, "lexical": 0.3, "length": 0.2}, "zscore")
    seen = fusion.first_seen(run, order)
    both = union({"rrf": rrf, "cc": cc}, "mode", [*PAIR, F.round("score", 9).alias("score")]).join(seen, PAIR)
    return ranking.top_k(both, ["mode", "query_id"], [F.desc("score"), "seen"], 8).select("mode", *PAIR, *big("rank"))


@query("e14_rank_maps", sql("SELECT query_id, comment_id, " + ", ".join(f"CAST(min(rank) FILTER (route = '{r}') AS BIGINT) AS {r}" for r in ("sbert", "lexical", "length")) + " FROM routes GROUP BY ALL", "routes"))
def e14(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's rank in every route, side by side."""
    return t.routes(spark, d).groupBy(*PAIR).agg(*[F.min(F.when(F.col("route") == r, F.col("rank"))).cast("bigint").alias(r) for r in ("sbert", "lexical", "length")])


@query("e15_whole_rrf_order", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, comment_id) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, sum(1.0 / (60 + rank)) AS s FROM routes GROUP BY ALL)", "routes"))
def e15(spark: SparkSession, d: str) -> DataFrame:
    s = fusion.rrf_scores(t.routes(spark, d)).withColumn("score", F.round("score", 9))
    return ranking.ranked(s, ["query_id"], [F.desc("score"), "comment_id"]).select(*PAIR, *big("rank"))


def top8(scores: DataFrame, order: Column | None = None) -> DataFrame:
    """(pair, rank): the first eight by score to nine digits, then id; missing scores last."""
    s = scores.withColumn("__s", F.round(order if order is not None else F.col("score"), 9))
    return ranking.top_k(s, ["query_id"], [F.desc_nulls_last("__s"), "comment_id"], 8).select(*PAIR, *big("rank"))


def _top8_sql(source: str, score: str = "score") -> str:
    return f"SELECT query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC NULLS LAST, comment_id) AS rank FROM ({source})) WHERE rank <= 8"


_DEEP = "SELECT query_id, comment_id, 1.0 / (60 + rank) AS s FROM routes WHERE route = 'sbert' UNION ALL SELECT query_id, comment_id, 0.3 / (60 + rank) FROM routes WHERE route = 'lexical' UNION ALL SELECT query_id, comment_id, 1.0 / (60 + rank - 8) FROM routes WHERE route = 'sbert' AND rank BETWEEN 9 AND 30"


def deep_slice(run: DataFrame) -> DataFrame:
    """The dense list from its ninth item on, as a route of its own."""
    return run.filter("route = 'sbert' AND rank BETWEEN 9 AND 30").select(F.lit("deep").alias("route"), *PAIR, "score", (F.col("rank") - 8).alias("rank"))


@query("e18_rank_fusion_with_slice", sql(_top8_sql(f"SELECT query_id, comment_id, sum(s) AS score FROM ({_DEEP}) GROUP BY ALL"), "routes"))
def e18(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of two routes and the deeper slice of the first."""
    run = t.routes(spark, d)
    two = run.filter("route IN ('sbert', 'lexical')").select("route", *PAIR, "score", "rank")
    return top8(fusion.rrf_scores(two.unionByName(deep_slice(run)), {"lexical": 0.3}))


@query("e19_list_with_its_slice", sql(_top8_sql("SELECT query_id, comment_id, 1.0 / (60 + rank) + CASE WHEN rank BETWEEN 9 AND 30 THEN 1.0 / (60 + rank - 8) ELSE 0 END AS score FROM routes WHERE route = 'sbert'"), "routes"))
def e19(spark: SparkSession, d: str) -> DataFrame:
    """A list fused with its own deeper slice: what such a fusion does without any second opinion."""
    run = t.routes(spark, d)
    return top8(fusion.rrf_scores(run.filter("route = 'sbert'").select("route", *PAIR, "score", "rank").unionByName(deep_slice(run))))


@query("e20_score_fusion", sql(_top8_sql(f"SELECT query_id, comment_id, sum(CASE route WHEN 'sbert' THEN 0.8 ELSE 0.2 END * v) AS score FROM (SELECT *, {_RP.format(c='score')} AS v FROM routes WHERE route IN ('sbert', 'lexical') WINDOW w AS (PARTITION BY route, query_id)) GROUP BY ALL"), "routes"))
def e20(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d).filter("route IN ('sbert', 'lexical')")
    return top8(fusion.cc_scores(run, {"sbert": 0.8, "lexical": 0.2}, "rank_percentile"))


@query("e21_union_by_score", sql(_top8_sql("SELECT query_id, comment_id, p.novelty AS score FROM (SELECT DISTINCT query_id, comment_id FROM routes WHERE rank <= 20) LEFT JOIN pool p USING (query_id, comment_id)"), "routes"))
def e21(spark: SparkSession, d: str) -> DataFrame:
    """The union of the routes' heads by one model's score; items without a score come last."""
    heads = t.routes(spark, d).filter("rank <= 20").select(*PAIR).distinct()
    return top8(heads.join(t.pool(spark, d).select(*PAIR, F.col("novelty").alias("score")), PAIR, "left"))


@query("e23_deep_extension", sql("SELECT r.query_id, r.comment_id, CAST(r.rank AS BIGINT) AS rank, round(p.lexical, 6) AS model FROM routes r LEFT JOIN pool p USING (query_id, comment_id) WHERE r.route = 'sbert' AND r.rank BETWEEN 9 AND 100", "routes"))
def e23(spark: SparkSession, d: str) -> DataFrame:
    run = t.routes(spark, d).filter("route = 'sbert' AND rank BETWEEN 9 AND 100").select(*PAIR, "rank")
    return run.join(t.pool(spark, d).select(*PAIR, "lexical"), PAIR, "left").select(*PAIR, *big("rank"), r6("lexical", "model"))


_KNOWN = "SELECT r.query_id, r.comment_id, r.rank, utility AS score FROM routes r JOIN judged USING (query_id, comment_id) WHERE route = 'sbert' AND utility IS NOT NULL"


@query("e25_visible_oracles", sql(f"SELECT 'any' AS oracle, * FROM ({_top8_sql('SELECT * FROM k')}) UNION ALL SELECT 'tail', query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS BIGINT) FROM (SELECT query_id, comment_id, 0 AS part, rank AS place FROM routes WHERE route = 'sbert' AND rank <= 5 UNION ALL SELECT query_id, comment_id, 1, place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM k WHERE rank > 5) WHERE place <= 3)", "routes", "judged", k=_KNOWN))
def e25(spark: SparkSession, d: str) -> DataFrame:
    """The best eight of what is judged, and with the first five of the list protected the best three of the rest."""
    run = t.routes(spark, d).filter("route = 'sbert'")
    known = run.select(*PAIR, "rank").join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, F.col("utility").alias("score")), PAIR)
    tail = fusion.protected_tail(run, known, 3).select(*PAIR, *big("rank"))
    return union({"any": top8(known), "tail": tail}, "oracle", [*PAIR, "rank"])


#: Names of systems with the fused weights, or the normaliser, of two routes.
_RRF_SYSTEMS = {f"rrf_{w:g}": w for w in (0.1, 0.3, 0.5, 1.0)}
_CC_SYSTEMS = {f"cc_{n}_{w:g}": (n, w) for n in ("minmax", "zscore", "rank_percentile") for w in (0.5, 0.8)}
_NORMS = {"minmax": _MM.format(c="score", k=1.0), "zscore": _ZS.format(c="score"), "rank_percentile": _RP.format(c="score")}


def fixed_systems(spark: SparkSession, d: str) -> DataFrame:
    """(system, query_id, comment_id, rank): the first eight of every named system, which share the two routes' lists."""
    run = t.routes(spark, d).filter("route IN ('sbert', 'lexical')")
    dense, lexical = run.filter("route = 'sbert'"), run.filter("route = 'lexical'")
    parts = {"dense": dense.filter("rank <= 8").select(*PAIR, *big("rank")), "lexical": lexical.filter("rank <= 8").select(*PAIR, *big("rank"))}
    parts |= {n: top8(fusion.rrf_scores(run, {"lexical": w})) for n, w in _RRF_SYSTEMS.items()}
    parts |= {n: top8(fusion.cc_scores(run, {"sbert": w, "lexical": 1 - w}, norm)) for n, (norm, w) in _CC_SYSTEMS.items()}
    parts |= {f"tail_{q}": fusion.protected_tail(dense, lexical, q).select(*PAIR, *big("rank")) for q in (1, 2, 4)}
    return union(parts, "system", [*PAIR, "rank"])


def _tail_sql(q: int) -> str:
    return f"SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, 0 AS part, rank AS place FROM two WHERE route = 'sbert' AND rank <= {8 - q} UNION ALL SELECT query_id, comment_id, 1, place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM two r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM two o WHERE o.route = 'sbert' AND o.rank <= {8 - q} AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE place <= {q})"


_SYSTEMS = " UNION ALL ".join(
    [f"SELECT '{n}' AS system, query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM two WHERE route = '{r}' AND rank <= 8" for n, r in (("dense", "sbert"), ("lexical", "lexical"))]
    + [f"SELECT '{n}', * FROM ({_top8_sql(f'SELECT query_id, comment_id, sum(CASE route WHEN {chr(39)}lexical{chr(39)} THEN {w} ELSE 1.0 END / (60 + rank)) AS score FROM two GROUP BY ALL')})" for n, w in _RRF_SYSTEMS.items()]
    + [f"SELECT '{n}', * FROM ({_top8_sql(f'SELECT query_id, comment_id, sum(CASE route WHEN {chr(39)}sbert{chr(39)} THEN {w} ELSE {round(1 - w, 9)} END * v) AS score FROM (SELECT *, {_NORMS[norm]} AS v FROM two WINDOW w AS (PARTITION BY route, query_id)) GROUP BY ALL')})" for n, (norm, w) in _CC_SYSTEMS.items()]
    + [f"SELECT 'tail_{q}', * FROM ({_tail_sql(q)})" for q in (1, 2, 4)]
)
_TWO = "SELECT * FROM routes WHERE route IN ('sbert', 'lexical')"


@query("e26_fixed_systems", sql("SELECT * FROM s", "routes", two=_TWO, s=_SYSTEMS))
def e26(spark: SparkSession, d: str) -> DataFrame:
    return fixed_systems(spark, d)


_SYSTEM_ROWS = "SELECT system, query_id, count(utility) AS judged, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 THEN avg(utility) END AS utility, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 AND max(idcg) > 0 THEN sum((pow(2.0, greatest(utility, 0.0)) - 1) / log2(rank + 1)) / max(idcg) END AS ndcg FROM s LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) LEFT JOIN ideal USING (query_id) GROUP BY ALL"
_IDEAL = "SELECT query_id, sum((pow(2.0, greatest(utility, 0.0)) - 1) / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS place FROM judged WHERE utility IS NOT NULL) WHERE place <= 8 GROUP BY 1"


def system_rows(spark: SparkSession, d: str, systems: DataFrame | None = None) -> DataFrame:
    """(system, query_id, judged, utility, ndcg): metrics of each system's eight items, null unless all are judged."""
    judged = t.judged(spark, d)
    run = (systems if systems is not None else fixed_systems(spark, d)).withColumnRenamed("system", "route")
    sets = metrics.set_utility(run, judged, 8)
    return sets.join(metrics.graded_ndcg(run, judged, 8), ["route", "query_id"]).select(F.col("route").alias("system"), "query_id", F.col("n_judged").alias("judged"), "utility", F.when(F.col("complete") & (F.col("ndcg") > 0), F.col("ndcg")).alias("ndcg"))


@query("e27_system_rows", sql("SELECT system, query_id, judged, round(utility, 6) AS utility, round(nullif(ndcg, 0), 6) AS ndcg FROM m", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m=_SYSTEM_ROWS))
def e27(spark: SparkSession, d: str) -> DataFrame:
    return system_rows(spark, d).select("system", "query_id", "judged", r6("utility", "utility"), r6("ndcg", "ndcg"))


@query("e28_top_ids", sql("SELECT query_id, string_agg(comment_id, ' ' ORDER BY rank) AS ids FROM run WHERE route = 'bm25' AND rank <= 5 GROUP BY 1", "run"))
def e28(spark: SparkSession, d: str) -> DataFrame:
    """The first five ids of each query in one line."""
    top = ranking.top_k(t.run(spark, d).filter("route = 'bm25'").drop("rank"), ["query_id"], [F.desc("score"), "comment_id"], 5)
    return top.groupBy("query_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "comment_id"))), lambda x: x["comment_id"])).alias("ids"))


_POOL20 = "SELECT query_id, comment_id, place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, comment_id) AS place FROM (SELECT query_id, comment_id, sum(CASE route WHEN 'lexical' THEN 0.3 ELSE 1.0 END / (60 + rank)) AS s FROM two GROUP BY ALL)) WHERE place <= 20"
_MODEL20 = "SELECT query_id, comment_id, place, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(novelty, 0), 9) DESC, comment_id) AS m FROM p20 LEFT JOIN pool USING (query_id, comment_id)"


@query("e30_held_out_assembly", sql("SELECT 'pool' AS arm, query_id, comment_id, CAST(place AS BIGINT) AS rank FROM m20 WHERE place <= 8 UNION ALL SELECT 'model', query_id, comment_id, CAST(m AS BIGINT) FROM m20 WHERE m <= 8 UNION ALL SELECT 'prior', query_id, comment_id, CAST(r AS BIGINT) FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 / (60 + place) + 0.5 / (60 + m), 9) DESC, comment_id) AS r FROM m20) WHERE r <= 8", "routes", two=_TWO, p20=_POOL20, m20=_MODEL20))
def e30(spark: SparkSession, d: str) -> DataFrame:
    """Two routes fused to a pool of twenty, its items scored by a model, and three arms of eight: pool, model, both."""
    run = t.routes(spark, d).filter("route IN ('sbert', 'lexical')")
    fused = fusion.rrf_scores(run, {"lexical": 0.3}).withColumn("score", F.round("score", 9))
    pool = ranking.top_k(fused, ["query_id"], [F.desc("score"), "comment_id"], 20, "place")
    rows = pool.join(t.pool(spark, d).select(*PAIR, "novelty"), PAIR, "left").withColumn("v", F.round(F.coalesce("novelty", F.lit(0.0)), 9))
    placed = ranking.ranked(rows, ["query_id"], [F.desc("v"), "comment_id"], "m")
    prior = top8(placed, 0.5 / (60 + F.col("place")) + 0.5 / (60 + F.col("m")))
    parts = {"pool": placed.filter("place <= 8").select(*PAIR, F.col("place").cast("bigint").alias("rank")), "model": placed.filter("m <= 8").select(*PAIR, F.col("m").cast("bigint").alias("rank")), "prior": prior}
    return union(parts, "arm", [*PAIR, "rank"])


@query("e31_routes_in_the_judged_pool", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(dense_rank, 1000000000), comment_id) AS BIGINT) AS rank FROM pool JOIN (SELECT query_id, comment_id FROM judged WHERE utility IS NOT NULL) USING (query_id, comment_id)", "pool", "judged"))
def e31(spark: SparkSession, d: str) -> DataFrame:
    """The judged candidates in the dense route's order, those without a rank last."""
    rows = t.pool(spark, d).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR), PAIR)
    return ranking.ranked(rows.withColumn("at", F.coalesce("dense_rank", F.lit(1_000_000_000))), ["query_id"], ["at", "comment_id"]).select(*PAIR, *big("rank"))


@query("e33_rankings_from_scores", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(lexical, 0) - 0.2 * coalesce(novelty, 0), 9) DESC, comment_id) AS BIGINT) AS rank FROM pool", "pool"))
def e33(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a model, here a difference of two features, as rankings."""
    s = t.pool(spark, d).withColumn("s", F.round(F.coalesce("lexical", F.lit(0.0)) - 0.2 * F.coalesce("novelty", F.lit(0.0)), 9))
    return ranking.ranked(s, ["query_id"], [F.desc("s"), "comment_id"]).select(*PAIR, *big("rank"))


@query("e34_route_order", sql("SELECT query_id, comment_id, CAST(place AS BIGINT) AS place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY dense_rank, comment_id) AS place FROM pool WHERE dense_rank > 0) WHERE place <= 8", "pool"))
def e34(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(t.pool(spark, d).filter("dense_rank > 0"), ["query_id"], ["dense_rank", "comment_id"], 8, "place").select(*PAIR, *big("place"))


@query("e35_reciprocal_ranks", sql("SELECT query_id, comment_id, round(CASE WHEN dense_rank > 0 THEN 1.0 / (60 + dense_rank) ELSE 0.0 END, 9) AS value FROM pool", "pool"))
def e35(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).select(*PAIR, F.round(ranking.reciprocal_rank(F.col("dense_rank")), 9).alias("value"))


@query("e37_with_and_without_graph", sql("SELECT graph, query_id, comment_id, CAST(rank AS BIGINT) AS rank FROM (SELECT graph, query_id, comment_id, row_number() OVER (PARTITION BY graph, query_id ORDER BY coalesce(lexical, 0) DESC, comment_id) AS rank FROM pool, (SELECT unnest([true, false]) AS graph) WHERE graph OR source_pool <> 'graph4') WHERE rank <= 8", "pool"))
def e37(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by a score, with the graph's and without."""
    rows = t.pool(spark, d).withColumn("graph", F.explode(F.array(F.lit(True), F.lit(False)))).filter("graph OR source_pool <> 'graph4'").withColumn("s", F.coalesce("lexical", F.lit(0.0)))
    return ranking.top_k(rows, ["graph", "query_id"], [F.desc("s"), "comment_id"], 8).select("graph", *PAIR, *big("rank"))


@query("e38_native_dense_order", sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_rank NULLS LAST, sbert DESC NULLS LAST, comment_id) AS BIGINT) AS rank, dense_rank IS NULL AS control FROM pool WHERE source_pool <> 'graph4'", "pool"))
def e38(spark: SparkSession, d: str) -> DataFrame:
    """The dense list as it was stored, then the candidates beyond its depth by similarity."""
    rows = t.pool(spark, d).filter("source_pool <> 'graph4'")
    return ranking.ranked(rows, ["query_id"], [F.asc_nulls_last("dense_rank"), F.desc_nulls_last("sbert"), "comment_id"]).select(*PAIR, *big("rank"), F.col("dense_rank").isNull().alias("control"))


_MM0 = "CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


@query("e40_query_minmax", sql(f"SELECT query_id, comment_id, round({_MM0.format(c='length')}, 6) AS value FROM pool WINDOW w AS (PARTITION BY query_id)", "pool"))
def e40(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).select(*PAIR, r6(ranking.minmax(F.col("length"), ["query_id"], 0.0), "value"))


@query("e41_scaled_maps", sql(f"SELECT source_pool, query_id, count(*) AS n, round(sum(v), 6) AS total, round(max(v), 6) AS largest FROM (SELECT source_pool, query_id, {_MM0.format(c='sbert')} AS v FROM pool WHERE sbert IS NOT NULL WINDOW w AS (PARTITION BY source_pool, query_id)) GROUP BY ALL", "pool"))
def e41(spark: SparkSession, d: str) -> DataFrame:
    """Scores scaled within query and source, as a map of each group would hold them."""
    v = t.pool(spark, d).filter("sbert IS NOT NULL").select("source_pool", "query_id", ranking.minmax(F.col("sbert"), ["source_pool", "query_id"], 0.0).alias("v"))
    return v.groupBy("source_pool", "query_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), "total"), r6(F.max("v"), "largest"))


@query("e48_slot_orders", sql("SELECT slot, query_id, comment_id, CAST(place AS BIGINT) AS place FROM (SELECT slot, query_id, comment_id, row_number() OVER (PARTITION BY slot, query_id ORDER BY CASE slot WHEN 'uncertain' THEN round(abs(utility - 4), 6) ELSE -utility END, coalesce(dense_rank, 9999), comment_id) AS place FROM pool JOIN judged USING (query_id, comment_id), (SELECT unnest(['uncertain', 'useful']) AS slot) WHERE utility IS NOT NULL) WHERE place <= 3", "pool", "judged"))
def e48(spark: SparkSession, d: str) -> DataFrame:
    """What comes first for a slot: the least certain or the most useful, then the better ranked."""
    rows = t.pool(spark, d).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).withColumn("slot", F.explode(F.array(F.lit("uncertain"), F.lit("useful"))))
    rows = rows.withColumn("o", F.when(F.col("slot") == "uncertain", F.round(F.abs(F.col("utility") - 4), 6)).otherwise(-F.col("utility")))
    return ranking.top_k(rows, ["slot", "query_id"], ["o", F.coalesce("dense_rank", F.lit(9999)), "comment_id"], 3, "place").select("slot", *PAIR, *big("place"))


@query("e51_flattened_rankings", sql("SELECT query_id, CAST(row_number() OVER (ORDER BY query_id, rank) AS BIGINT) AS place, comment_id FROM run WHERE route = 'dense' AND rank <= 3", "run"))
def e51(spark: SparkSession, d: str) -> DataFrame:
    """Nested rankings as one list by query and rank, numbered through."""
    top = t.run(spark, d).filter("route = 'dense' AND rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "comment_id"))).alias("l"))
    flat = top.select("query_id", F.explode("l").alias("x")).select("query_id", "x.rank", "x.comment_id").withColumn("all", F.lit(1))
    return ranking.ranked_split(flat, ["all"], ["query_id", "rank"], "place").select("query_id", *big("place"), "comment_id")


# sets and oracles


def budget_sql(pool: str, budget: int, scores: str = "u", base: str = "base") -> str:
    """SELECT of (query_id, comment_id, source, score): the t-th best outsider for the t-th worst of the baseline."""
    worst = f"SELECT b.query_id, b.comment_id, coalesce(score, -1e300) AS s, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(score, -1e300), b.comment_id DESC) AS t FROM {base} b LEFT JOIN {scores} USING (query_id, comment_id)"
    best = f"SELECT query_id, comment_id AS new, score AS ns, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS t FROM (SELECT DISTINCT query_id, comment_id FROM ({pool})) JOIN {scores} USING (query_id, comment_id) WHERE (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM {base}) QUALIFY t <= {budget}"
    return f"SELECT query_id, CASE WHEN ns > s + 1e-12 THEN new ELSE comment_id END AS comment_id, CASE WHEN ns > s + 1e-12 THEN 'pool' ELSE 'baseline' END AS source, CASE WHEN ns > s + 1e-12 THEN ns ELSE s END AS score FROM ({worst}) LEFT JOIN ({best}) USING (query_id, t)"


_BASE = "SELECT query_id, comment_id FROM routes WHERE route = 'sbert' AND rank <= 8"
_U = "SELECT query_id, comment_id, utility AS score FROM judged WHERE utility IS NOT NULL"
_DEPTH = "SELECT query_id, comment_id FROM routes WHERE route = 'sbert' AND rank <= {n}"


def oracle_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    run = t.routes(spark, d)
    return run.filter("route = 'sbert' AND rank <= 8"), run, t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, F.col("utility").alias("score"))


def mean_known(chosen: DataFrame, u: DataFrame) -> DataFrame:
    """(query_id, value): the mean utility of what is judged of each query's set."""
    return chosen.select(*PAIR).join(u.select(*PAIR, F.col("score").alias("u")), PAIR).groupBy("query_id").agg(F.avg("u").alias("value"))


_CELLS = [(depth, budget) for depth in (12, 20, 50) for budget in (1, 4)]
_SWEEP = " UNION ALL ".join(f"SELECT 'depth {m}, budget {b}' AS cell, query_id, avg(u.score) AS value FROM ({budget_sql(f'SELECT query_id, comment_id FROM routes WHERE rank <= {m}', b)}) x JOIN u USING (query_id, comment_id) GROUP BY ALL" for m, b in _CELLS)
ORACLE["o27_budget_sweep"] = sql("SELECT * FROM (" + bootstrapped("cells", "query_id", "value", "cell") + ")", "routes", "judged", base=_BASE, u=_U, cells=_SWEEP)


@query("f3_oracle_headroom", sql(" UNION ALL ".join(f"SELECT {m} AS depth, {b} AS budget, count(*) AS queries, round(avg(o.v - x.v), 6) AS headroom FROM (SELECT query_id, avg(u.score) AS v FROM ({budget_sql(_DEPTH.format(n=m), b)}) z JOIN u USING (query_id, comment_id) GROUP BY 1) o JOIN (SELECT query_id, avg(score) AS v FROM base JOIN u USING (query_id, comment_id) GROUP BY 1) x USING (query_id)" for m, b in _CELLS), "routes", "judged", base=_BASE, u=_U))
def f3(spark: SparkSession, d: str) -> DataFrame:
    """What the best set of a pool's depth gains over the baseline by the number of replacements it may make."""
    base, run, u = oracle_inputs(spark, d)
    old = mean_known(base, u).withColumnRenamed("value", "old")
    out = None
    for m, b in _CELLS:
        best = mean_known(selection.budgeted_set(base, run.filter(f"route = 'sbert' AND rank <= {m}"), u, b), u).join(old, "query_id")
        part = best.agg(F.lit(m).cast("bigint").alias("depth"), F.lit(b).cast("bigint").alias("budget"), F.count(F.lit(1)).alias("queries"), r6(F.avg(F.col("value") - F.col("old")), "headroom"))
        out = part if out is None else out.unionByName(part)
    return out


_CHOSEN = budget_sql(_DEPTH.format(n=30), 3)
ORACLE["f2_replacements"] = sql(
    "SELECT query_id, CAST(slot AS BIGINT) AS slot, entered, removed, round((ue - ur) / 8, 6) AS contribution FROM (SELECT query_id, comment_id AS entered, utility AS ue, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC NULLS LAST, comment_id) AS slot FROM c LEFT JOIN (SELECT query_id, comment_id, score AS utility FROM u) USING (query_id, comment_id) WHERE source = 'pool') "
    "JOIN (SELECT query_id, comment_id AS removed, utility AS ur, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC NULLS LAST, comment_id) AS slot FROM base ANTI JOIN c USING (query_id, comment_id) LEFT JOIN (SELECT query_id, comment_id, score AS utility FROM u) USING (query_id, comment_id)) USING (query_id, slot)",
    "routes", "judged", base=_BASE, u=_U, c=_CHOSEN,
)
_MEAN = "SELECT query_id, avg(u.score) AS {n} FROM ({s}) z JOIN u USING (query_id, comment_id) GROUP BY 1"
ORACLE["f4_decomposition"] = sql(
    "SELECT query_id, round(pool - base, 6) AS access, round(pool - feasible, 6) AS action_loss, round(feasible - base, 6) AS feasible, round(feasible - learned, 6) AS learning_loss, round(learned - base, 6) AS gain FROM "
    f"({_MEAN.format(n='base', s='SELECT * FROM base')}) LEFT JOIN (SELECT query_id, CASE WHEN max(n) >= 8 THEN avg(CASE WHEN place <= 8 THEN score END) END AS pool, 1 AS held FROM (SELECT query_id, u.score, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY u.score DESC, comment_id) AS place FROM ({_DEPTH.format(n=30)}) JOIN u USING (query_id, comment_id)) GROUP BY 1) USING (query_id) "
    f"JOIN ({_MEAN.format(n='feasible', s=_CHOSEN)}) USING (query_id) JOIN ({_MEAN.format(n='learned', s=budget_sql(_DEPTH.format(n=30), 3, 'lex'))}) USING (query_id) WHERE held = 1",
    "routes", "judged", base=_BASE, u=_U, lex="SELECT query_id, comment_id, score FROM routes WHERE route = 'lexical'",
)


@query("f6_candidate_quality", sql("SELECT query_id, comment_id, round(greatest(0.0, least(1.0, (utility - 1) / 6)), 6) AS quality FROM judged WHERE utility IS NOT NULL", "judged"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    """Utilities as qualities of 0 to 1."""
    return t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, r6(selection.candidate_quality(F.col("utility")), "quality"))


@query("f9_static_features", sql("SELECT query_id, comment_id, round(coalesce(sbert, 0), 6) AS similarity, round(CASE WHEN dense_rank IS NULL THEN 0.0 ELSE 1 - (dense_rank - 1) / 99.0 END, 6) AS percentile, dense_rank IS NULL AS missing, round(coalesce(length, 0), 6) AS length, round(coalesce(lexical, 0), 6) AS overlap, round(coalesce(d8_max, 0), 6) AS near, round(coalesce(d8_mean, 0), 6) AS around, round(1 - coalesce(d8_max, 0), 6) AS novelty FROM pool WHERE dense_rank IS NULL OR dense_rank BETWEEN 1 AND 100", "pool"))
def f9(spark: SparkSession, d: str) -> DataFrame:
    """Eight features of each candidate that need no judgment; missing values are 0."""
    known = lambda c, n: r6(F.coalesce(c, F.lit(0.0)), n)
    p = t.pool(spark, d).filter("dense_rank IS NULL OR dense_rank BETWEEN 1 AND 100")
    return p.select(*PAIR, known("sbert", "similarity"), r6(ranking.depth_percentile(F.col("dense_rank"), 100), "percentile"), F.col("dense_rank").isNull().alias("missing"), known("length", "length"), known("lexical", "overlap"), known("d8_max", "near"), known("d8_mean", "around"), r6(1 - F.coalesce("d8_max", F.lit(0.0)), "novelty"))


_BEST = "SELECT x.query_id, CASE WHEN s > {t} THEN action_id ELSE 'NOOP' END AS action_id, CASE WHEN s > {t} THEN reward ELSE 0.0 END AS reward, coalesce(s, 0.0) AS margin FROM (SELECT DISTINCT query_id FROM base) x LEFT JOIN (SELECT query_id, action_id, reward, reward AS s FROM a WHERE reward IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reward DESC, action_id DESC) = 1) USING (query_id)"
ORACLE["f11_best_actions"] = sql("SELECT query_id, action_id, round(reward, 6) AS reward, round(margin, 6) AS margin FROM (" + _BEST.format(t=0.05) + ")", "routes", "judged", base=_BASE, a=_ACTIONS)
ORACLE["f13_thresholds"] = sql("SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(r), 6) AS mean_reward, round(stddev_samp(r) / sqrt(count(*)), 6) AS standard_error, round(avg(r) - 0.5 * stddev_samp(r) / sqrt(count(*)), 6) AS guarded, round(avg(CASE WHEN margin > threshold THEN 1.0 ELSE 0.0 END), 6) AS action_rate, round(avg(CASE WHEN margin > threshold AND reward < 0 THEN 1.0 ELSE 0.0 END), 6) AS harm_rate FROM (SELECT *, CASE WHEN margin > threshold THEN reward ELSE 0.0 END AS r FROM (" + _BEST.format(t=0) + "), (SELECT unnest([0.0, 0.1, 0.25, 0.5]) AS threshold)) GROUP BY 1", "routes", "judged", base=_BASE, a=_ACTIONS)


def actions(spark: SparkSession, d: str) -> DataFrame:
    return selection.one_swap_actions(*swap_inputs(spark, d))


@query("f12_threshold_candidates", sql("SELECT 0.0 AS level, 0.0 AS threshold" + "".join(f" UNION ALL SELECT {q}, round(quantile_cont(margin, {q}), 6) FROM (" + _BEST.format(t=0) + ") WHERE margin > 0" for q in (0.25, 0.5, 0.75)), "routes", "judged", base=_BASE, a=_ACTIONS))
def f12(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds to try: none, and quantiles of the margins above 0."""
    margins = selection.best_action(actions(spark, d), "reward").filter("margin > 0")
    levels = [0.25, 0.5, 0.75]
    q = margins.agg(F.percentile("margin", levels).alias("p")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("p").alias("threshold"))).alias("x")).select("x.level", r6("x.threshold", "threshold"))
    return q.unionByName(spark.createDataFrame([(0.0, 0.0)], "level double, threshold double"))


@query("f14_best_rewards", sql("SELECT query_id, round(greatest(max(reward), 0.0), 6) AS best FROM (SELECT query_id, reward FROM a UNION ALL SELECT DISTINCT query_id, 0.0 FROM base) GROUP BY 1", "routes", "judged", base=_BASE, a=_ACTIONS))
def f14(spark: SparkSession, d: str) -> DataFrame:
    """The largest reward of each query; doing nothing is worth 0."""
    return actions(spark, d).groupBy("query_id").agg(r6(F.max("reward"), "best"))


@query("f15_oracle_summary", sql("SELECT slots, count(*) AS queries, round(avg(b), 6) AS mean_best, count(*) FILTER (b > 0) AS improvable FROM (SELECT slots, query_id, greatest(coalesce(max(reward), 0), 0) AS b FROM base LEFT JOIN a USING (query_id), (SELECT unnest([1, 4, 8]) AS slots) WHERE br IS NULL OR br > 8 - slots GROUP BY ALL) GROUP BY 1", "routes", "judged", base=_BASE, a=_ACTIONS))
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the best rewards where only the last, the last four or any item may be replaced."""
    base, fresh, judged = swap_inputs(spark, d)
    ranks = base.select("query_id", F.col("comment_id").alias("replaced_id"), F.col("rank").alias("br"))
    a = selection.one_swap_actions(base, fresh, judged).join(ranks, ["query_id", "replaced_id"], "left").withColumn("slots", F.explode(F.array(F.lit(1), F.lit(4), F.lit(8))))
    per = a.filter("br IS NULL OR br > 8 - slots").groupBy("slots", "query_id").agg(F.max("reward").alias("b"))
    return per.groupBy(F.col("slots").cast("bigint").alias("slots")).agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("b"), "mean_best"), F.count_if(F.col("b") > 0).alias("improvable"))


@query("f16_downside_weights", sql("SELECT query_id, round(sum(CASE WHEN reward >= 0 THEN reward ELSE 2.0 * reward END), 6) AS weighted, round(sum(reward), 6) AS plain FROM a WHERE reward IS NOT NULL GROUP BY 1", "routes", "judged", a=_ACTIONS))
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Rewards in which losses count twice."""
    a = actions(spark, d).filter("reward IS NOT NULL AND action_id <> 'NOOP'")
    return a.groupBy("query_id").agg(r6(F.sum(selection.downside_weighted(F.col("reward"), 2.0)), "weighted"), r6(F.sum("reward"), "plain"))


@query("f17_final_ids", sql("SELECT query_id, string_agg(CASE WHEN action_id = comment_id || '>' || split_part(action_id, '>', 2) THEN split_part(action_id, '>', 2) ELSE comment_id END, ' ' ORDER BY rank) AS ids FROM (" + _BEST.format(t=0) + ") JOIN (SELECT query_id, comment_id, rank FROM routes WHERE route = 'sbert' AND rank <= 8) USING (query_id) GROUP BY 1", "routes", "judged", base=_BASE, a=_ACTIONS))
def f17(spark: SparkSession, d: str) -> DataFrame:
    """The eight items after the best swap, which keeps the place of the one it replaces."""
    base = swap_inputs(spark, d)[0].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "comment_id"))), lambda x: x["comment_id"]).alias("ids"))
    best = selection.best_action(actions(spark, d), "reward").select("query_id", F.split("action_id", ">").alias("a"))
    swap = F.size("a") == 2
    return base.join(best, "query_id").select("query_id", F.concat_ws(" ", selection.apply_swap(F.col("ids"), F.when(swap, F.get("a", F.lit(0))), F.when(swap, F.get("a", F.lit(1))))).alias("ids"))


_LABEL_PARTS = {c.removeprefix("label_"): w for c, w in ut.WEIGHTS.items()}
_RESCUE = "SELECT a.*, " + ", ".join(f"({w} * (c.label_{n} - r.label_{n})) / 8 AS {n}" for n, w in _LABEL_PARTS.items()) + " FROM a JOIN judged c ON c.query_id = a.query_id AND c.comment_id = candidate JOIN judged r ON r.query_id = a.query_id AND r.comment_id = replaced"


def action_labels(spark: SparkSession, d: str) -> DataFrame:
    """The judged swaps with what each label's difference adds to the mean utility of eight."""
    a, j = actions(spark, d).filter("action_id <> 'NOOP'"), t.judged(spark, d)
    side = lambda s, i: j.select("query_id", F.col("comment_id").alias(i), *[F.col(f"label_{n}").alias(f"{s}_{n}") for n in _LABEL_PARTS])
    both = a.join(side("c", "candidate_id"), ["query_id", "candidate_id"]).join(side("r", "replaced_id"), ["query_id", "replaced_id"])
    return both.select("query_id", "action_id", "replaced_id", "candidate_id", "reward", *[(w * (F.col(f"c_{n}") - F.col(f"r_{n}")) / 8).alias(n) for n, w in _LABEL_PARTS.items()])


@query("f19_action_dimensions", sql("SELECT query_id, action_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _LABEL_PARTS) + ", round(reward - (" + " + ".join(_LABEL_PARTS) + "), 6) AS safety_gate FROM x", "routes", "judged", a=_ACTIONS, x=_RESCUE))
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Each label's part of a swap's reward, and what the cap of unsafe items adds."""
    total = sum((F.col(n) for n in list(_LABEL_PARTS)[1:]), F.col(next(iter(_LABEL_PARTS))))
    return action_labels(spark, d).select("query_id", "action_id", *[r6(n, n) for n in _LABEL_PARTS], r6(F.col("reward") - total, "safety_gate"))


_DRIFT = "SELECT query_id, comment_id AS replaced FROM judged WHERE label_relevance <= 3 OR label_usefulness <= 3 OR label_safety <= 2"


@query("f18_rescues", sql("SELECT query_id, action_id, round(reward, 6) AS reward FROM (SELECT a.query_id, action_id, reward, row_number() OVER (PARTITION BY a.query_id ORDER BY reward DESC, action_id) AS n FROM a JOIN (" + _DRIFT + ") USING (query_id, replaced) WHERE reward IS NOT NULL) WHERE n = 1", "routes", "judged", a=_ACTIONS))
def f18(spark: SparkSession, d: str) -> DataFrame:
    """The best swap for an item that misses the question, helps little or is unsafe."""
    drift = t.judged(spark, d).filter("label_relevance <= 3 OR label_usefulness <= 3 OR label_safety <= 2").select("query_id", F.col("comment_id").alias("replaced_id"))
    rows = actions(spark, d).filter("reward IS NOT NULL").join(drift, ["query_id", "replaced_id"])
    return ranking.top_k(rows, ["query_id"], [F.desc("reward"), "action_id"], 1).select("query_id", "action_id", r6("reward", "reward"))


_LINEAR = " + ".join(f"CAST({c} AS DOUBLE) * {w}" for c, w in ut.WEIGHTS.items())


@query("f20_linear_utilities", sql(f"SELECT query_id, comment_id, round({_LINEAR}, 6) AS linear FROM judged WHERE ({_LINEAR}) IS NOT NULL", "judged"))
def f20(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).select(*PAIR, r6(ut.linear(), "linear")).filter("linear IS NOT NULL")


@query("f21_safety_residuals", sql(f"SELECT count(*) AS capped, round(min(utility - l), 6) AS largest, round(avg(utility - l), 6) AS mean FROM (SELECT utility, {_LINEAR} AS l FROM judged WHERE label_safety <= 2) WHERE utility IS NOT NULL AND l IS NOT NULL", "judged"))
def f21(spark: SparkSession, d: str) -> DataFrame:
    """What the cap takes from the utility of unsafe items."""
    rows = t.judged(spark, d).filter("label_safety <= 2").select((F.col("utility") - ut.linear()).alias("r")).filter("r IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("capped"), r6(F.min("r"), "largest"), r6(F.avg("r"), "mean"))


def _oracle_sql(pool: str, k: int = 8, tie: str = "comment_id") -> str:
    return f"SELECT query_id, CASE WHEN max(n) >= {k} THEN avg(CASE WHEN place <= {k} THEN score END) END AS v FROM (SELECT query_id, score, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS place FROM (SELECT DISTINCT query_id, comment_id FROM ({pool})) JOIN u USING (query_id, comment_id)) GROUP BY 1"


_D20 = _DEPTH.format(n=20)
_G = "SELECT query_id, comment_id FROM pool WHERE source_pool = 'graph4'"


@query("f22_oracle_levels", sql(f"SELECT query_id, round(a.v, 6) AS d8, round(b.v, 6) AS d20, round(c.v, 6) AS with_graph, coalesce(c.v > b.v + 1e-12, false) AS opportunity FROM ({_oracle_sql(f'{_D20} UNION ALL {_G}')}) c LEFT JOIN ({_oracle_sql('SELECT * FROM base')}) a USING (query_id) LEFT JOIN ({_oracle_sql(_D20)}) b USING (query_id)", "routes", "judged", base=_BASE, u=_U))
def f22(spark: SparkSession, d: str) -> DataFrame:
    """The best eight of the first eight, of the first twenty, and with the graph's candidates."""
    base, run, u = oracle_inputs(spark, d)
    judged = u.withColumnRenamed("score", "utility")
    d20, g = run.filter("route = 'sbert' AND rank <= 20").select(*PAIR), t.pool(spark, d).filter("source_pool = 'graph4'").select(*PAIR)
    best = lambda p, n: metrics.oracle_utility(p, judged).select("query_id", F.col("oracle").alias(n))
    all_ = best(d20.unionByName(g), "c").join(best(base, "a"), "query_id", "left").join(best(d20, "b"), "query_id", "left")
    return all_.select("query_id", r6("a", "d8"), r6("b", "d20"), r6("c", "with_graph"), F.coalesce(F.col("c") > F.col("b") + 1e-12, F.lit(False)).alias("opportunity"))


@query("f23_matched_pilot", sql("SELECT arm, count(*) AS queries, count(v) AS complete, round(avg(v), 6) AS oracle FROM (SELECT arm, query_id, CASE WHEN count(score) = count(*) THEN max(best) END AS v FROM (SELECT p.arm, p.query_id, u.score, avg(u.score) OVER (PARTITION BY p.arm, p.query_id) AS best FROM p LEFT JOIN u USING (query_id, comment_id)) GROUP BY ALL) GROUP BY 1", "routes", "judged", base=_BASE, u=_U, p="SELECT 'deep' AS arm, query_id, comment_id FROM routes WHERE route = 'sbert' AND rank BETWEEN 9 AND 12 UNION ALL SELECT 'graph', query_id, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sbert DESC, comment_id) AS n FROM pool WHERE source_pool = 'graph4' AND (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM base)) WHERE n <= 4"))
def f23(spark: SparkSession, d: str) -> DataFrame:
    """Four deeper items against four of the graph: means only where all of an arm are judged."""
    base, run, u = oracle_inputs(spark, d)
    deep = run.filter("route = 'sbert' AND rank BETWEEN 9 AND 12").select(*PAIR)
    graph = ranking.top_k(t.pool(spark, d).filter("source_pool = 'graph4'").join(base.select(*PAIR), PAIR, "left_anti"), ["query_id"], [F.desc("sbert"), "comment_id"], 4, "n").select(*PAIR)
    rows = union({"deep": deep, "graph": graph}, "arm", PAIR).join(u, PAIR, "left")
    per = rows.groupBy("arm", "query_id").agg(F.when(F.count("score") == F.count(F.lit(1)), F.avg("score")).alias("v"))
    return per.groupBy("arm").agg(F.count(F.lit(1)).alias("queries"), F.count("v").alias("complete"), r6(F.avg("v"), "oracle"))


@query("f24_top_judged", sql("SELECT query_id, n, round(CASE WHEN n >= 8 THEN m END, 6) AS mean, ids FROM (SELECT query_id, max(n) AS n, avg(score) FILTER (place <= 8) AS m, string_agg(comment_id, ' ' ORDER BY place) FILTER (place <= 8) AS ids FROM (SELECT query_id, comment_id, score, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS place FROM pool JOIN u USING (query_id, comment_id)) GROUP BY 1)", "pool", "judged", u=_U))
def f24(spark: SparkSession, d: str) -> DataFrame:
    """The eight best judged candidates of each query, and their mean where there are eight."""
    rows = t.pool(spark, d).select(*PAIR).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR)
    top = ranking.top_k(rows, ["query_id"], [F.desc("utility"), "comment_id"], 8)
    per = top.groupBy("query_id").agg(F.avg("utility").alias("m"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "comment_id"))), lambda x: x["comment_id"])).alias("ids"))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(per, "query_id").select("query_id", "n", F.round(F.when(F.col("n") >= 8, F.col("m")), 6).alias("mean"), "ids")


@query("f26_oracle_by_last_id", sql(f"SELECT query_id, round(v, 6) AS oracle FROM ({_oracle_sql(_D20, 8, 'comment_id DESC')})", "routes", "judged", u=_U))
def f26(spark: SparkSession, d: str) -> DataFrame:
    """The best eight of the first twenty; of equal ones the larger id, which changes no mean."""
    _, run, u = oracle_inputs(spark, d)
    known = run.filter("route = 'sbert' AND rank <= 20").select(*PAIR).join(u, PAIR)
    top = ranking.top_k(known, ["query_id"], [F.desc("score"), F.desc("comment_id")], 8)
    return known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(top.groupBy("query_id").agg(F.avg("score").alias("m")), "query_id").select("query_id", r6(F.when(F.col("n") >= 8, F.col("m")), "oracle"))


@query("f7_mmr_of_texts")
def f7(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of eight candidates by similarity to the query and distance of their texts, as weighted terms."""
    from pyspark.sql import types as T

    c = t.comments(spark, d)
    weights = tx.tfidf(c.join(t.pool(spark, d).select("comment_id").distinct(), "comment_id", "left_semi"), "comment_id", "comment_text", tx.idf(c, "comment_id", "comment_text"))
    slot = F.pmod(F.xxhash64("term"), F.lit(512)).cast("int")  # terms share 512 slots, so that vectors are short
    slots = weights.groupBy("comment_id", slot.alias("i")).agg(F.sum("value").alias("v"))
    sparse = slots.groupBy("comment_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    from rankloom.functions.vectors import l2_normalized

    vec = sparse.select("comment_id", l2_normalized(dense).cast(T.ArrayType(T.DoubleType())).alias("vec"))
    pool = t.pool(spark, d).join(vec, "comment_id", "left").select(*PAIR, F.col("sbert").alias("quality"), "vec", F.lit(False).alias("in_baseline"))
    return selection.mmr(pool, 0.3, 8, None)


# SQL of orders defined elsewhere

ORACLE["e32_residual_slots"] = sql("SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS BIGINT) AS rank FROM (SELECT query_id, comment_id, min(o) AS o FROM (SELECT query_id, comment_id, CASE WHEN rank <= 6 THEN rank ELSE 2000000 + rank END AS o FROM routes WHERE route = 'sbert' UNION ALL SELECT query_id, comment_id, 1000000 + n FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS n FROM routes r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.route = 'sbert' AND o.rank <= 6 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE n <= 2) GROUP BY ALL) QUALIFY rank <= 8", "routes")
ORACLE["k35_one_standard_error"] = sql(
    "SELECT CAST(budget AS BIGINT) AS budget, round(mean, 6) AS mean FROM (SELECT c.budget, avg(c.value) AS mean, avg(b.value - c.value) AS gap, coalesce(stddev_samp(b.value - c.value) / sqrt(count(*)), 0) AS se FROM c JOIN (SELECT * FROM c WHERE budget = (SELECT budget FROM (SELECT budget, avg(value) AS m FROM c GROUP BY 1) ORDER BY m DESC, budget LIMIT 1)) b USING (query_id) GROUP BY 1) WHERE gap <= se ORDER BY budget LIMIT 1",
    "routes", "judged", base=_BASE, u=_U, lex="SELECT query_id, comment_id, score FROM routes WHERE route = 'lexical'",
    c=" UNION ALL ".join(f"SELECT {b} AS budget, query_id, avg(u.score) AS value FROM ({'SELECT * FROM base' if b == 0 else budget_sql(_DEPTH.format(n=30), b, 'lex')}) z JOIN u USING (query_id, comment_id) GROUP BY ALL" for b in (0, 1, 2, 4)),
)
