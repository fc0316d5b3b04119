"""Queries of metrics, statistics and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import table
from rankloom.operators import metrics, ranking, setops, stats

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


def rounded(df: DataFrame) -> DataFrame:
    """Floats to 6 digits, integers as bigint."""
    cast = {"double": lambda c: F.round(c, 6), "int": lambda c: F.col(c).cast("bigint")}
    return df.select(*[cast[k](c).alias(c) if k in cast else F.col(c) for c, k in df.dtypes])


def _ideal(n: str, k: int) -> str:
    return f"list_sum(list_transform(range(1, CAST(greatest(1, least({n}, {k})) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"


def _binary(ks: tuple[int, ...]) -> str:
    out = ["coalesce(max(n_gold), 0) AS n_gold", "round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 6) AS mrr", "round(CASE WHEN coalesce(max(n_gold), 0) > 0 THEN sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) / max(n_gold) ELSE 0 END, 6) AS ap"]
    for k in ks:
        h = f"count(CASE WHEN hit = 1 AND rank <= {k} THEN 1 END)"
        rec, pre = f"(CASE WHEN coalesce(max(n_gold), 0) > 0 THEN {h} / CAST(max(n_gold) AS DOUBLE) ELSE 0 END)", f"({h} / {float(k)})"
        out += [f"round({rec}, 6) AS recall_{k}", f"round({pre}, 6) AS precision_{k}", f"round(CASE WHEN {rec} + {pre} > 0 THEN 2 * {rec} * {pre} / ({rec} + {pre}) ELSE 0 END, 6) AS f1_{k}", f"CAST(CASE WHEN {h} > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_{k}",
                f"round(CASE WHEN coalesce(max(n_gold), 0) > 0 THEN sum(CASE WHEN hit = 1 AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / {_ideal('max(n_gold)', k)} ELSE 0 END, 6) AS ndcg_{k}",
                f"CAST(CASE WHEN coalesce(max(n_gold), 0) > 0 AND {h} = max(n_gold) THEN 1 ELSE 0 END AS BIGINT) AS joint_{k}"]
    return f"SELECT route, query_id, {', '.join(out)} FROM marked GROUP BY ALL"


_MARKED = "SELECT r.*, g.hit, s.n_gold, CAST(sum(coalesce(g.hit, 0)) OVER (PARTITION BY route, r.query_id ORDER BY rank) AS DOUBLE) AS so_far FROM routes r LEFT JOIN (SELECT *, 1 AS hit FROM gold) g USING (query_id, comment_id) LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) s USING (query_id)"


@query("h9_binary_metrics", sql(_binary((5, 8, 20)), "routes", "gold", marked=_MARKED))
def h9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary_metrics(t.routes(spark, d), t.gold(spark, d), [5, 8, 20]))


@query("h10_mean_metrics", sql("SELECT route, count(*) AS queries, round(avg(mrr), 5) AS mrr, round(avg(ap), 5) AS ap, round(avg(recall_8), 5) AS recall_8, round(avg(ndcg_8), 5) AS ndcg_8 FROM per GROUP BY 1", "routes", "gold", marked=_MARKED, per=_binary((8,)).replace("round(", "(").replace(", 6)", ")")))
def h10(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.binary_metrics(t.routes(spark, d), t.gold(spark, d), [8]).select("route", "query_id", "mrr", "ap", "recall_8", "ndcg_8")
    return metrics.mean_metrics(per, ["route"], 5)


_GAIN = "(pow(2.0, greatest(utility, 0.0)) - 1)"
_IDEAL = f"SELECT query_id, sum({_GAIN} / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS place FROM judged WHERE utility IS NOT NULL) WHERE place <= 8 GROUP BY 1"


@query("h7_graded_ndcg", sql(f"SELECT route, query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM (SELECT route, r.query_id, sum(coalesce({_GAIN}, 0) / log2(rank + 1)) AS dcg FROM routes r LEFT JOIN judged j USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL) LEFT JOIN ideal USING (query_id)", "routes", "judged", ideal=_IDEAL))
def h7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8))


@query(
    "h25_condensed_ndcg",
    sql(f"SELECT route, query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg END, 6) AS ndcg FROM (SELECT route, query_id, sum({_GAIN} / log2(place + 1)) AS dcg FROM (SELECT route, r.query_id, utility, row_number() OVER (PARTITION BY route, r.query_id ORDER BY rank) AS place FROM routes r JOIN judged j USING (query_id, comment_id) WHERE utility IS NOT NULL) WHERE place <= 8 GROUP BY ALL) JOIN ideal USING (query_id)", "routes", "judged", ideal=_IDEAL),
)
def h25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.condensed_ndcg(t.routes(spark, d), t.judged(spark, d), 8))


@query("h35_ideal_gains", sql("SELECT query_id, round(idcg, 6) AS idcg FROM ideal", "judged", ideal=_IDEAL))
def h35(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ideal_gains(t.judged(spark, d), 8))


_SET = "SELECT route, r.query_id, count(DISTINCT comment_id) AS n, count(utility) AS n_judged, count(DISTINCT comment_id) = 8 AND count(utility) = 8 AS complete, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 THEN avg(utility) END AS utility, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 THEN avg(CASE WHEN utility >= 4 THEN 1.0 ELSE 0.0 END) END AS good_share FROM routes r LEFT JOIN judged USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL"


@query("h37_set_utility", sql("SELECT route, query_id, n, n_judged, complete, round(utility, 6) AS utility, round(good_share, 6) AS good_share FROM s", "routes", "judged", s=_SET))
def h37(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.set_utility(t.routes(spark, d), t.judged(spark, d), 8))


@query("h36_completeness", sql("SELECT route, count(*) AS queries, count(utility) AS complete, round(avg(utility), 6) AS utility FROM s GROUP BY 1", "routes", "judged", s=_SET))
def h36(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.set_utility(t.routes(spark, d), t.judged(spark, d), 8)
    return rounded(per.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), F.count("utility").alias("complete"), F.avg("utility").alias("utility")))


_KNOWN = "SELECT query_id, comment_id, utility FROM (SELECT DISTINCT query_id, comment_id FROM routes) JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL"
_ORACLE8 = "SELECT query_id, max(n) AS n_judged, CASE WHEN max(n) >= 8 THEN avg(CASE WHEN place <= 8 THEN utility END) END AS oracle FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, comment_id) AS place FROM known) GROUP BY 1"


@query("f25_oracle_utility", sql("SELECT query_id, n_judged, round(oracle, 6) AS oracle FROM o", "routes", "judged", known=_KNOWN, o=_ORACLE8))
def f25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.oracle_utility(t.routes(spark, d), t.judged(spark, d), 8))


def _spearman(x: str, y: str, source: str) -> str:
    ranks = f"SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY {x}) + (count(*) OVER (PARTITION BY query_id, {x}) - 1) / 2.0 AS x, rank() OVER (PARTITION BY query_id ORDER BY {y}) + (count(*) OVER (PARTITION BY query_id, {y}) - 1) / 2.0 AS y FROM ({source}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    return f"SELECT query_id, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS rho FROM ({ranks}) GROUP BY 1"


_LABELLED = "SELECT p.*, utility FROM pool p JOIN judged USING (query_id, comment_id) WHERE utility IS NOT NULL"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return t.pool(spark, d).join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR)


@query("h34_within_query_spearman", sql(_spearman("sbert", "utility", "SELECT * FROM l"), "pool", "judged", l=_LABELLED))
def h34(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.within_query_spearman(labelled(spark, d), "sbert", "utility"))


@query("c21_pairwise_accuracy", sql("SELECT a.query_id, count(*) AS pairs, round(avg(CASE WHEN a.sbert > b.sbert THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l a JOIN l b ON a.query_id = b.query_id AND a.utility - b.utility >= 1.0 GROUP BY 1", "pool", "judged", l=_LABELLED))
def c21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pairwise_accuracy(labelled(spark, d), "sbert", "utility", 1.0))


_SHARED = "SELECT depth, query_id, count(*) FILTER (a <= depth AND b <= depth) AS shared, count(*) FILTER (coalesce(a <= depth, false) OR coalesce(b <= depth, false)) AS either FROM (SELECT query_id, comment_id, min(rank) FILTER (route = 'dense') AS a, min(rank) FILTER (route = 'bm25') AS b FROM run GROUP BY ALL), (SELECT unnest([8, 20, 50, 100]) AS depth) GROUP BY ALL"


@query("d9_overlap_by_depth", sql("SELECT CAST(depth AS BIGINT) AS depth, query_id, shared, round(CASE WHEN either > 0 THEN shared / CAST(either AS DOUBLE) ELSE 0.0 END, 6) AS jaccard FROM s", "run", s=_SHARED))
def d9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(setops.overlap_by_depth(t.run(spark, d), "dense", "bm25", [8, 20, 50, 100]))


@query("d16_agreement_by_rank", sql("SELECT query_id, shared_8, shared_100, first_difference IS NULL AS same_order, CAST(first_difference AS BIGINT) AS first_difference FROM (SELECT query_id, max(shared) FILTER (depth = 8) AS shared_8, max(shared) FILTER (depth = 100) AS shared_100 FROM s GROUP BY 1) JOIN (SELECT query_id, min(rank) FILTER (a IS DISTINCT FROM b) AS first_difference FROM (SELECT query_id, rank, comment_id AS a FROM run WHERE route = 'dense') FULL JOIN (SELECT query_id, rank, comment_id AS b FROM run WHERE route = 'bm25') USING (query_id, rank) GROUP BY 1) USING (query_id)", "run", s=_SHARED))
def d16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(setops.agreement_by_rank(t.run(spark, d), "dense", "bm25"))


# statistics

_PER = "SELECT route, query_id, ndcg FROM (SELECT route, query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM (SELECT route, r.query_id, sum(coalesce((pow(2.0, greatest(utility, 0.0)) - 1), 0) / log2(rank + 1)) AS dcg FROM routes r LEFT JOIN judged j USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL) LEFT JOIN ideal USING (query_id))"
_DELTA = "SELECT a.query_id, a.ndcg AS \"left\", b.ndcg AS \"right\", a.ndcg - b.ndcg AS delta FROM per a JOIN per b ON a.query_id = b.query_id AND a.route = 'sbert' AND b.route = 'lexical'"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired(metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8), "route", "sbert", "lexical", "ndcg")


@query("i21_paired", sql('SELECT query_id, round("left", 6) AS "left", round("right", 6) AS "right", round(delta, 6) AS delta FROM dl', "routes", "judged", ideal=_IDEAL, per=_PER, dl=_DELTA))
def i21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_deltas(spark, d))


@query("i34_win_tie_loss", sql("SELECT count(*) AS n, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(avg(delta) / stddev_samp(delta), 6) AS effect FROM dl", "routes", "judged", ideal=_IDEAL, per=_PER, dl=_DELTA))
def i34(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.win_tie_loss(_deltas(spark, d), []))


def drawn(units: str, seed: int, draws: int, digits: int) -> str:
    """SQL for the rows of `units` (with a column u) in every draw: draw 0 is the sample, x the digits of the others."""
    many = 64 // digits
    return f"SELECT * EXCLUDE (h, block), CASE WHEN draw > 0 THEN substr(h, (draw - 1) % {many} * {digits} + 1, {digits}) END AS x FROM (SELECT *, CASE WHEN draw > 0 THEN sha256(u || '#{seed}#' || CAST(block AS VARCHAR)) END AS h FROM (SELECT *, (draw - 1) // {many} AS block FROM ({units}), (SELECT unnest(range({draws} + 1)) AS draw)))"


def bootstrapped(per: str, unit: str, value: str, by: str, draws: int = 2000, seed: int = 7) -> str:
    """SELECT of (by, n, mean, low, high) over the rows of `per`."""
    times = "CASE WHEN draw = 0 THEN 1 " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END"
    units = f"SELECT {by}, {unit} AS u, count(*) AS n, sum({value}) AS s FROM {per} WHERE {value} IS NOT NULL GROUP BY ALL"
    means = f"SELECT {by}, draw, CAST(sum(w * n) AS BIGINT) AS n, round(sum(w * s) / sum(w * n), 12) AS m FROM (SELECT *, {times} AS w FROM ({drawn(units, seed, draws, 4)})) WHERE w > 0 GROUP BY ALL"
    return f"SELECT {by}, max(n) FILTER (draw = 0) AS n, round(max(m) FILTER (draw = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (draw > 0), 6) AS high FROM ({means}) GROUP BY ALL"


@query("i1_bootstrap_mean", sql("SELECT *, CASE WHEN low > 0.5 THEN 'better' WHEN high < 0.5 THEN 'worse' ELSE 'open' END AS verdict FROM (" + bootstrapped("per", "query_id", "ndcg", "route") + ")", "routes", "judged", ideal=_IDEAL, per=_PER))
def i1(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean nDCG of each route, and how it compares with 0.5."""
    ci = rounded(stats.bootstrap_mean(metrics.graded_ndcg(t.routes(spark, d), t.judged(spark, d), 8), "query_id", "ndcg", ["route"]))
    return ci.withColumn("verdict", stats.verdict(F.col("low") - 0.5, F.col("high") - 0.5))


@query("i29_sign_flip", sql("SELECT n, round(seen / n, 6) AS mean, round((count(*) FILTER (draw > 0 AND abs(t) >= abs(seen) - 1e-9) + 1) / 10001.0, 6) AS p FROM (SELECT *, max(t) FILTER (draw = 0) OVER () AS seen, CAST(max(c) OVER () AS BIGINT) AS n FROM (SELECT draw, sum(n) AS c, sum(CASE WHEN draw = 0 OR x >= '8' THEN s ELSE -s END) AS t FROM (" + drawn("SELECT query_id AS u, count(*) AS n, sum(delta) AS s FROM dl GROUP BY 1", 7, 10_000, 1) + ") GROUP BY 1)) GROUP BY ALL", "routes", "judged", ideal=_IDEAL, per=_PER, dl=_DELTA))
def i29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.sign_flip(_deltas(spark, d), "query_id", "delta"))


def _moments(rank: bool) -> str:
    v = (lambda c: f"rank() OVER (PARTITION BY query_id ORDER BY {c}) + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2.0") if rank else (lambda c: f"CAST({c} AS DOUBLE)")
    base = f"SELECT query_id, {v('sbert')} AS x, {v('utility')} AS y, {v('length')} AS z FROM l WHERE sbert IS NOT NULL AND length IS NOT NULL"
    c = f"SELECT query_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM ({base}) WINDOW w AS (PARTITION BY query_id)"
    return f"SELECT query_id, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz FROM ({c}) GROUP BY 1 HAVING count(*) >= 3 AND sum(x * x) > 1e-12 AND sum(y * y) > 1e-12"


@query("i8_sufficient", sql("SELECT query_id, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM m", "pool", "judged", l=_LABELLED, m=_moments(False)))
def i8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.sufficient(labelled(spark, d), "sbert", "utility", "length"))


@query("i11_pooled_correlations", sql("SELECT count(*) AS units, CAST(sum(n) AS BIGINT) AS n, round(sum(xy) / sqrt(sum(xx) * sum(yy)), 6) AS r, round((sum(xy) * sum(zz) - sum(xz) * sum(yz)) / sqrt((sum(xx) * sum(zz) - pow(sum(xz), 2)) * (sum(yy) * sum(zz) - pow(sum(yz), 2))), 6) AS partial_r FROM m", "pool", "judged", l=_LABELLED, m=_moments(True)))
def i11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.pooled_correlations(stats.sufficient(labelled(spark, d), "sbert", "utility", "length", ranks=True)))


@query("i15_tertiles", sql("SELECT round(quantile_cont(length, 0.3333333333333333), 6) AS low, round(quantile_cont(length, 0.6666666666666666), 6) AS high FROM pool", "pool"))
def i15(spark: SparkSession, d: str) -> DataFrame:
    p = t.pool(spark, d).agg(F.percentile("length", [1 / 3, 2 / 3]).alias("p"))
    return p.select(r6(F.col("p")[0], "low"), r6(F.col("p")[1], "high"))


@query("i16_deciles", sql("SELECT CAST(part AS BIGINT) AS part, count(*) AS units, round(avg(m), 6) AS mean FROM (SELECT query_id, part, avg(utility) AS m FROM (SELECT query_id, utility, floor((row_number() OVER (PARTITION BY query_id ORDER BY sbert, comment_id) - 0.5) / count(*) OVER (PARTITION BY query_id) * 10) AS part FROM l WHERE sbert IS NOT NULL) GROUP BY ALL) GROUP BY 1", "pool", "judged", l=_LABELLED))
def i16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.deciles(labelled(spark, d), "sbert", "utility"))


@query("i30_agreement", sql("SELECT n, round(same / CAST(n AS DOUBLE), 6) AS exact, round(near / CAST(n AS DOUBLE), 6) AS within_one, round(1 - seen * n / chance, 6) AS kappa FROM (SELECT CAST(sum(c) AS BIGINT) AS n, sum(c) FILTER (a = b) AS same, sum(c) FILTER (abs(a - b) <= 1) AS near, CAST(sum((a - b) * (a - b) * c) AS DOUBLE) AS seen FROM g), (SELECT CAST(sum((x.a - y.b) * (x.a - y.b) * x.c * y.c) AS DOUBLE) AS chance FROM (SELECT a, sum(c) AS c FROM g GROUP BY 1) x, (SELECT b, sum(c) AS c FROM g GROUP BY 1) y)", "judged", g="SELECT label_relevance AS a, label_usefulness AS b, count(*) AS c FROM judged WHERE label_relevance BETWEEN 1 AND 7 AND label_usefulness BETWEEN 1 AND 7 GROUP BY ALL"))
def i30(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two of the labels as of two raters."""
    return rounded(stats.agreement(t.judged(spark, d), "label_relevance", "label_usefulness"))


@query("i39_risk_coverage", sql("SELECT 'sbert' AS arm, coverage, round(sum(CASE WHEN p <= round(coverage * n) THEN delta ELSE 0 END) / count(*), 6) AS mean_reward FROM (SELECT delta, row_number() OVER (ORDER BY abs(delta) DESC, query_id) AS p, count(*) OVER () AS n FROM dl), (SELECT CAST(unnest(range(11)) AS DOUBLE) / 10 AS coverage) GROUP BY ALL", "routes", "judged", ideal=_IDEAL, per=_PER, dl=_DELTA))
def i39(spark: SparkSession, d: str) -> DataFrame:
    rows = _deltas(spark, d).select("query_id", F.abs("delta").alias("margin"), F.col("delta").alias("reward")).withColumn("arm", F.lit("sbert"))
    return rounded(stats.risk_coverage(rows, "query_id", "margin", "reward", ["arm"]))


@query("i32_label_shares", sql("SELECT utility_grade, count(*) AS n, round(avg(CASE WHEN label_safety <= 2 THEN 1.0 ELSE 0.0 END), 6) AS unsafe, round(avg(label_relevance), 6) AS relevance, round(avg(label_usefulness), 6) AS usefulness FROM (SELECT *, CAST(greatest(0, least(6, round_even(utility, 0) - 1)) AS BIGINT) AS utility_grade FROM judged WHERE utility IS NOT NULL) GROUP BY 1", "judged"))
def i32(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.functions.utility import grade

    rows = t.judged(spark, d).filter("utility IS NOT NULL").withColumn("utility_grade", grade(F.col("utility")))
    return rounded(rows.groupBy("utility_grade").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("label_safety") <= 2, 1.0).otherwise(0.0)).alias("unsafe"), F.avg("label_relevance").alias("relevance"), F.avg("label_usefulness").alias("usefulness")))


@query("i56_profile", "SELECT \"column\", value, count(*) AS n FROM (SELECT unnest([{'column': 'source', 'value': source}, {'column': 'scenario', 'value': scenario}, {'column': 'tier', 'value': tier}, {'column': 'use_bucket', 'value': use_bucket}, {'column': 'post_role', 'value': post_role}], recursive := true) FROM queries) GROUP BY ALL")
def i56(spark: SparkSession, d: str) -> DataFrame:
    return stats.profile(table(spark, d, "queries"), ["source", "scenario", "tier", "use_bucket", "post_role"])


@query("i22_two_level_means", sql("SELECT source_pool, count(*) AS queries, round(avg(m), 6) AS mean FROM (SELECT source_pool, query_id, avg(utility) AS m FROM l GROUP BY ALL) GROUP BY 1", "pool", "judged", l=_LABELLED))
def i22(spark: SparkSession, d: str) -> DataFrame:
    """Means of each query first, then over queries."""
    per = labelled(spark, d).groupBy("source_pool", "query_id").agg(F.avg("utility").alias("m"))
    return rounded(per.groupBy("source_pool").agg(F.count(F.lit(1)).alias("queries"), F.avg("m").alias("mean")))


@query("h21_route_votes", sql("SELECT votes, count(*) AS pairs, round(avg(utility), 6) AS utility FROM (SELECT query_id, comment_id, count(*) AS votes FROM routes WHERE rank <= 8 GROUP BY ALL) LEFT JOIN judged USING (query_id, comment_id) GROUP BY 1", "routes", "judged"))
def h21(spark: SparkSession, d: str) -> DataFrame:
    """How many routes have an item among their first eight, and what such items are worth."""
    votes = t.routes(spark, d).filter("rank <= 8").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("votes"))
    return rounded(votes.join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left").groupBy("votes").agg(F.count(F.lit(1)).alias("pairs"), F.avg("utility").alias("utility")))


@query("h22_rank_spread", sql("SELECT query_id, comment_id, CAST(max(rank) - min(rank) AS BIGINT) AS spread, round(stddev_pop(rank), 6) AS deviation FROM routes GROUP BY ALL", "routes"))
def h22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.routes(spark, d).groupBy(*PAIR).agg((F.max("rank") - F.min("rank")).alias("spread"), F.stddev_pop("rank").alias("deviation")))


@query("h33_top_by_prediction", sql("SELECT round(avg(m), 6) AS utility FROM (SELECT query_id, avg(utility) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sbert DESC, comment_id) AS place FROM l) WHERE place <= 8 GROUP BY 1)", "pool", "judged", l=_LABELLED))
def h33(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.top_k(labelled(spark, d), ["query_id"], [F.desc("sbert"), "comment_id"], 8)
    return rounded(top.groupBy("query_id").agg(F.avg("utility").alias("m")).agg(F.avg("m").alias("utility")))


@query("h31_mean_error", sql("SELECT round(avg(e), 6) AS mae FROM (SELECT query_id, avg(abs(utility - (1 + 6 * sbert))) AS e FROM l GROUP BY 1)", "pool", "judged", l=_LABELLED))
def h31(spark: SparkSession, d: str) -> DataFrame:
    per = labelled(spark, d).groupBy("query_id").agg(F.avg(F.abs(F.col("utility") - (1 + 6 * F.col("sbert")))).alias("e"))
    return rounded(per.agg(F.avg("e").alias("mae")))
