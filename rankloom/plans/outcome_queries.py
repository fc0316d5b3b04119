"""Queries of cross-fitted choices, oracle contrasts, gates and outcomes of composed studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import cut, table
from rankloom.functions import text as tx
from rankloom.operators import guards, learn, metrics, ranking, sampling, selection, setops, stats

from . import tables as t
from .contract_queries import _ACTIONS, _L, count_by, labelled, swap_inputs
from .measure_queries import _IDEAL, bootstrapped
from .metric_queries import _AT3, at_three
from .order_queries import _BASE, _BEST, _DEPTH, _SYSTEM_ROWS, _SYSTEMS, _TWO, _U, _oracle_sql, actions, budget_sql, fixed_systems, mean_known, oracle_inputs, system_rows, union
from .record_queries import FEATURES
from .runner_queries import _F3, _GRID, grid_values, mixed_split
from .runner_queries import _SPLIT as SPLIT_SQL
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


# scorers in folds

_FOLD5 = "CAST(CAST(('0x' || substr(md5(query_id || '#7#' || repeat), 1, 15)) AS BIGINT) % 5 AS BIGINT)"
_ROWS5 = f"SELECT p.query_id, p.comment_id, coalesce(sbert, 0) AS x, utility, repeat, {_FOLD5.replace('query_id', 'p.query_id')} AS fold FROM pool p LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id), (SELECT CAST(unnest(range(2)) AS BIGINT) AS repeat)"
_LINES5 = "SELECT r.repeat, f.fold, regr_slope(utility, x) AS b, regr_intercept(utility, x) AS a FROM rows5 r, (SELECT CAST(unnest(range(5)) AS BIGINT) AS fold) f WHERE r.fold <> f.fold AND utility IS NOT NULL GROUP BY ALL"


def folded_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The candidates with their folds in two repeats of five, and each fold's straight line fitted on the other four.

    A line is an aggregate, so all folds are fitted in one pass; the lines are ten rows.
    """
    rows = t.pool(spark, d).select(*PAIR, F.coalesce("sbert", F.lit(0.0)).alias("x")).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    placed = rows.join(sampling.folds(rows, "query_id", 5, 2), "query_id")
    other = placed.filter("utility IS NOT NULL").withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("own <> fold")
    lines = other.groupBy("repeat", "fold").agg(F.regr_slope("utility", "x").alias("b"), F.regr_intercept("utility", "x").alias("a"))
    return placed, lines


@query("k30_repeated_out_of_fold", sql("SELECT query_id, comment_id, round(avg(greatest(1, least(7, a + b * x))), 5) AS score FROM rows5 JOIN lines5 USING (repeat, fold) GROUP BY ALL", "pool", "judged", rows5=_ROWS5, lines5=_LINES5))
def k30(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate scored by the fits that did not see its query, averaged over repeats."""
    placed, lines = folded_lines(spark, d)
    s = F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.col("a") + F.col("b") * F.col("x")))
    return placed.join(F.broadcast(lines), ["repeat", "fold"]).groupBy(*PAIR).agg(F.round(F.avg(s), 5).alias("score"))  # ten lines


@query("k28_calibrated_baseline", sql("SELECT repeat, fold, round(a, 5) AS intercept, round(b, 5) AS slope FROM lines5", "pool", "judged", rows5=_ROWS5, lines5=_LINES5))
def k28(spark: SparkSession, d: str) -> DataFrame:
    """The calibrating line of each fold."""
    return folded_lines(spark, d)[1].select(*big("repeat", "fold"), F.round("a", 5).alias("intercept"), F.round("b", 5).alias("slope"))


@query("k29_tuned_by_error", sql("SELECT repeat, fold, setting FROM (SELECT repeat, fold, setting, row_number() OVER (PARTITION BY repeat, fold ORDER BY e, setting) AS n FROM (SELECT repeat, fold, setting, round(avg(e), 9) AS e FROM (SELECT repeat, f.fold, setting, abs(utility - greatest(1, least(7, setting + 2 * x))) AS e FROM rows5 r, (SELECT CAST(unnest(range(5)) AS BIGINT) AS fold) f, (SELECT unnest([3.0, 3.5, 4.0, 4.5]) AS setting) WHERE r.fold <> f.fold AND utility IS NOT NULL) GROUP BY ALL)) WHERE n = 1", "pool", "judged", rows5=_ROWS5))
def k29(spark: SparkSession, d: str) -> DataFrame:
    """Of a grid the setting of least mean error on each fold's training queries."""
    placed, _ = folded_lines(spark, d)
    rows = placed.filter("utility IS NOT NULL").withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("own <> fold").withColumn("setting", F.explode(F.array(*[F.lit(x) for x in (3.0, 3.5, 4.0, 4.5)])))
    e = F.abs(F.col("utility") - F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.col("setting") + 2 * F.col("x"))))
    per = rows.groupBy("repeat", "fold", "setting").agg(F.round(F.avg(e), 9).alias("m"))
    return ranking.top_k(per, ["repeat", "fold"], ["m", "setting"], 1, "n").select(*big("repeat", "fold"), "setting")


_MARGINS = "SELECT query_id, action_id, s, reward FROM (SELECT a.query_id, action_id, reward, c.lexical - r.lexical AS s, row_number() OVER (PARTITION BY a.query_id ORDER BY round(c.lexical - r.lexical, 9) DESC, action_id) AS n FROM a JOIN (SELECT query_id, comment_id AS candidate, coalesce(lexical, 0) AS lexical FROM pool) c USING (query_id, candidate) JOIN (SELECT query_id, comment_id AS replaced, coalesce(lexical, 0) AS lexical FROM pool) r USING (query_id, replaced) WHERE reward IS NOT NULL) WHERE n = 1"
_TUNED = f"SELECT repeat, fold, threshold, kappa FROM (SELECT repeat, fold, threshold, kappa, row_number() OVER (PARTITION BY repeat, fold ORDER BY g DESC, threshold, kappa) AS n FROM (SELECT repeat, fold, threshold, kappa, round(avg(w) - 0.5 * stddev_samp(w) / sqrt(count(*)), 9) AS g FROM (SELECT repeat, f.fold, threshold, kappa, CASE WHEN s <= threshold THEN 0.0 WHEN reward < 0 THEN kappa * reward ELSE reward END AS w FROM m, (SELECT CAST(unnest(range(2)) AS BIGINT) AS repeat), (SELECT CAST(unnest(range(3)) AS BIGINT) AS fold) f, (SELECT unnest([0.0, 0.1, 0.3]) AS threshold), (SELECT unnest([1.0, 2.0]) AS kappa) WHERE {_F3} <> f.fold) GROUP BY ALL)) WHERE n = 1"


def lexical_margins(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, action_id, s, reward): of each query the judged swap that gains most of one feature."""
    p = t.pool(spark, d).select(*PAIR, F.coalesce("lexical", F.lit(0.0)).alias("v"))
    a = actions(spark, d).filter("action_id <> 'NOOP' AND reward IS NOT NULL")
    a = a.join(p.select("query_id", F.col("comment_id").alias("candidate_id"), F.col("v").alias("c")), ["query_id", "candidate_id"]).join(p.select("query_id", F.col("comment_id").alias("replaced_id"), F.col("v").alias("r")), ["query_id", "replaced_id"])
    a = a.withColumn("s", F.col("c") - F.col("r")).withColumn("o", F.round("s", 9))
    return ranking.top_k(a, ["query_id"], [F.desc("o"), "action_id"], 1, "n").select("query_id", "action_id", "s", "reward")


@query("k27_tuned_policy", sql(_TUNED, "routes", "judged", a=_ACTIONS, m=_MARGINS))
def k27(spark: SparkSession, d: str) -> DataFrame:
    """Threshold and weight of losses for each fold, by the mean less half its standard error on the training queries."""
    m = lexical_margins(spark, d)
    rows = m.join(sampling.folds(m, "query_id", 3, 2).withColumnRenamed("fold", "own"), "query_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("own <> fold")
    rows = rows.withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.3)))).withColumn("kappa", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    w = F.when(F.col("s") <= F.col("threshold"), 0.0).when(F.col("reward") < 0, F.col("kappa") * F.col("reward")).otherwise(F.col("reward"))
    per = rows.withColumn("w", w).groupBy("repeat", "fold", "threshold", "kappa").agg(F.round(F.avg("w") - 0.5 * F.stddev_samp("w") / F.sqrt(F.count(F.lit(1))), 9).alias("g"))
    return ranking.top_k(per, ["repeat", "fold"], [F.desc("g"), "threshold", "kappa"], 1, "n").select(*big("repeat", "fold"), "threshold", "kappa")


def _network(loss: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
        return learn.out_of_fold(rows, sampling.folds(rows, "query_id", 2), 2, lambda a, b: learn.fit_network(a, b, FEATURES, "utility", loss))

    run.__doc__ = f"Out-of-fold scores of a small network fitted by {loss} steps."
    return run


QUERIES["k4_network_regression"] = _network("huber")
QUERIES["k8_network_pairs"] = _network("pairs")


# oracle contrasts


_D20, _D12 = _DEPTH.format(n=20), _DEPTH.format(n=12)


@query("o69_oracle_contrast", sql(f"SELECT count(*) AS n, round(avg(a.v - b.v), 6) AS mean, count(*) FILTER (a.v - b.v > 1e-12) AS wins, count(*) FILTER (abs(a.v - b.v) <= 1e-12) AS ties, count(*) < 79 AS limited FROM ({_oracle_sql(_D20)}) a JOIN ({_oracle_sql(_D12)}) b USING (query_id) WHERE a.v IS NOT NULL AND b.v IS NOT NULL", "routes", "judged", u=_U))
def o69(spark: SparkSession, d: str) -> DataFrame:
    """The best eight of twenty against the best eight of twelve; fewer than 79 queries are marked as few."""
    _, run, u = oracle_inputs(spark, d)
    judged = u.withColumnRenamed("score", "utility")
    best = lambda k, n: metrics.oracle_utility(run.filter(f"route = 'sbert' AND rank <= {k}"), judged).filter("oracle IS NOT NULL").select("query_id", F.col("oracle").alias(n))
    x = best(20, "a").join(best(12, "b"), "query_id").select((F.col("a") - F.col("b")).alias("x"))
    return x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x"), "mean"), F.count_if(F.col("x") > 1e-12).alias("wins"), F.count_if(F.abs("x") <= 1e-12).alias("ties"), (F.count(F.lit(1)) < 79).alias("limited"))


@query("o65_reproduced_oracle", sql(f"SELECT query_id, round(v, 6) AS oracle, round(w, 6) AS again, round(v, 6) = round(w, 6) AS same FROM ({_oracle_sql(_D20)}) JOIN (SELECT query_id, CASE WHEN count(*) >= 8 THEN list_avg(list_slice(list_reverse_sort(list(score)), 1, 8)) END AS w FROM ({_D20}) JOIN u USING (query_id, comment_id) GROUP BY 1) USING (query_id) WHERE v IS NOT NULL", "routes", "judged", u=_U))
def o65(spark: SparkSession, d: str) -> DataFrame:
    """The oracle by two ways, a window and a sorted array."""
    _, run, u = oracle_inputs(spark, d)
    pool = run.filter("route = 'sbert' AND rank <= 20")
    a = metrics.oracle_utility(pool, u.withColumnRenamed("score", "utility")).filter("oracle IS NOT NULL")
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 8)
    b = pool.select(*PAIR).join(u, PAIR).groupBy("query_id").agg((F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / 8).alias("w"))
    return a.join(b, "query_id").select("query_id", r6("oracle", "oracle"), r6("w", "again"), (F.round("oracle", 6) == F.round("w", 6)).alias("same"))


@query("o26_depth_preflight", sql("SELECT route, CAST(depth AS BIGINT) AS depth, count(*) AS pairs, count(j) AS judged, round(count(j) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM (SELECT route, depth, query_id, comment_id FROM run, (SELECT unnest([8, 20, 50, 100]) AS depth) WHERE rank <= depth) LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) GROUP BY ALL", "run", "judged"))
def o26(spark: SparkSession, d: str) -> DataFrame:
    rows = t.run(spark, d).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in (8, 20, 50, 100)]))).filter("rank <= depth")
    return setops.coverage(rows, t.judged(spark, d), ["route", "depth"]).select("route", *big("depth"), "pairs", "judged", r6("coverage", "coverage"))


_BUDGETS = " UNION ALL ".join(f"SELECT {b} AS budget, query_id, avg(u.score) AS value FROM ({'SELECT * FROM base' if b == 0 else budget_sql(_DEPTH.format(n=30), b, 'lex')}) z JOIN u USING (query_id, comment_id) GROUP BY ALL" for b in (0, 1, 2))
_LEX = "SELECT query_id, comment_id, score FROM routes WHERE route = 'lexical'"


def budget_values(spark: SparkSession, d: str) -> DataFrame:
    """(budget, query_id, value): the mean utility of each query's set by how many items a model may replace."""
    base, run, u = oracle_inputs(spark, d)
    lexical, out = run.filter("route = 'lexical'").select(*PAIR, "score"), None
    for b in (0, 1, 2):
        part = mean_known(selection.budgeted_set(base, run.filter("route = 'sbert' AND rank <= 30"), lexical, b), u).select(F.lit(b).alias("budget"), "query_id", "value")
        out = part if out is None else out.unionByName(part)
    return cut(out)


@query("o29_nested_budgets", sql(f"SELECT fold, CAST(budget AS BIGINT) AS budget FROM (SELECT fold, budget, row_number() OVER (PARTITION BY fold ORDER BY m DESC, budget) AS n FROM (SELECT f.fold, budget, round(avg(value), 9) AS m FROM (SELECT v.*, {_F3} AS own FROM v, (SELECT 0 AS repeat)) x, (SELECT CAST(unnest(range(3)) AS BIGINT) AS fold) f WHERE own <> f.fold GROUP BY ALL)) WHERE n = 1", "routes", "judged", base=_BASE, u=_U, lex=_LEX, v=_BUDGETS))
def o29(spark: SparkSession, d: str) -> DataFrame:
    """The budget that each fold's training queries choose."""
    v = budget_values(spark, d)
    rows = v.join(sampling.folds(v, "query_id", 3).select("query_id", F.col("fold").alias("own")), "query_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("own <> fold")
    per = rows.groupBy("fold", "budget").agg(F.round(F.avg("value"), 9).alias("m"))
    return ranking.top_k(per, ["fold"], [F.desc("m"), "budget"], 1, "n").select(*big("fold", "budget"))


@query("o129_symmetric_selection", sql(f"SELECT 'budget' AS axis, CAST(budget AS DOUBLE) AS setting FROM (SELECT budget FROM v GROUP BY 1 ORDER BY round(avg(value), 9) DESC, budget LIMIT 1) UNION ALL SELECT 'weight', setting FROM (SELECT setting FROM ({_GRID}) GROUP BY 1 ORDER BY round(avg(value), 9) DESC, setting LIMIT 1)", "routes", "judged", base=_BASE, u=_U, lex=_LEX, v=_BUDGETS))
def o129(spark: SparkSession, d: str) -> DataFrame:
    """The best setting along each of two axes."""
    pick = lambda df, c, n: df.groupBy(c).agg(F.round(F.avg("value"), 9).alias("m")).orderBy(F.desc("m"), c).limit(1).select(F.lit(n).alias("axis"), F.col(c).cast("double").alias("setting"))
    return pick(budget_values(spark, d), "budget", "budget").unionByName(pick(grid_values(spark, d), "setting", "weight"))


# outcomes


_M0 = {"two": _TWO, "s": _SYSTEMS, "ideal": _IDEAL, "m0": _SYSTEM_ROWS}


@query("o94_scorer_rankings", sql("SELECT system, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(p), 6) AS precision_8 FROM (SELECT system, query_id, coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr, count(CASE WHEN hit = 1 THEN 1 END) / 8.0 AS p FROM s LEFT JOIN (SELECT query_id, comment_id, 1 AS hit FROM gold) USING (query_id, comment_id) GROUP BY ALL) GROUP BY 1", "routes", "gold", two=_TWO, s=_SYSTEMS))
def o94(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of every system against the gold items."""
    run = fixed_systems(spark, d).select(F.col("system").alias("route"), *PAIR, F.col("rank").cast("int").alias("rank"))
    m = metrics.binary_metrics(run, t.gold(spark, d), [8])
    return m.groupBy(F.col("route").alias("system")).agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("mrr"), "mrr"), r6(F.avg("precision_8"), "precision_8"))


@query("o97_primary_contrast", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("c", "query_id", "delta", "key", 1000) + ")", "routes", "judged", **_M0, c="SELECT 'rrf_1-dense' AS key, query_id, a.utility - b.utility AS delta FROM m0 a JOIN m0 b USING (query_id) WHERE a.system = 'rrf_1' AND b.system = 'dense' AND a.utility IS NOT NULL AND b.utility IS NOT NULL"))
def o97(spark: SparkSession, d: str) -> DataFrame:
    """The one contrast that a study stated beforehand, with its interval."""
    p = stats.paired(system_rows(spark, d), "system", "rrf_1", "dense", "utility").withColumn("key", F.lit("rrf_1-dense"))
    return stats.bootstrap_mean(p, "query_id", "delta", ["key"], 1000).select("key", "n", *[r6(c, c) for c in ("mean", "low", "high")])


@query("o93_joined_results", sql("SELECT study, arm, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'systems' AS study, system AS arm, utility AS value FROM m0 UNION ALL SELECT 'budgets', CAST(budget AS VARCHAR), value FROM v UNION ALL SELECT 'three', route, utility FROM at3) WHERE value IS NOT NULL GROUP BY ALL", "routes", "judged", **_M0, base=_BASE, u=_U, lex=_LEX, v=_BUDGETS, at3=_AT3))
def o93(spark: SparkSession, d: str) -> DataFrame:
    """Results of several studies in one table."""
    parts = {
        "systems": system_rows(spark, d).select(F.col("system").alias("arm"), F.col("utility").alias("value")), "budgets": budget_values(spark, d).select(F.col("budget").cast("string").alias("arm"), "value"),
        "three": at_three(spark, d).select(F.col("route").alias("arm"), F.col("utility").alias("value")),
    }
    return union(parts, "study", ["arm", "value"]).filter("value IS NOT NULL").groupBy("study", "arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("o104_exact_utility", sql("SELECT count(*) AS complete, round(avg(u), 6) AS mean, count(*) = (SELECT count(DISTINCT query_id) FROM routes) AS every FROM (SELECT avg(utility) AS u FROM routes JOIN judged USING (query_id, comment_id) WHERE route = 'sbert' AND rank <= 8 AND utility IS NOT NULL GROUP BY query_id HAVING count(*) = 8)", "routes", "judged"))
def o104(spark: SparkSession, d: str) -> DataFrame:
    """Exact utilities of eight, and whether every query has one, without which a study stops."""
    s = metrics.set_utility(t.routes(spark, d).filter("route = 'sbert'"), t.judged(spark, d), 8)
    return s.agg(F.count_if("complete").alias("complete"), r6(F.avg("utility"), "mean"), F.bool_and("complete").alias("every"))


@query("o114_query_outcomes", sql("SELECT query_id, action_id <> 'NOOP' AS acts, round(margin, 6) AS margin, n AS options FROM (" + _BEST.format(t=0.1) + ") JOIN (SELECT query_id, count(*) AS n FROM a GROUP BY 1) USING (query_id)", "routes", "judged", base=_BASE, a=_ACTIONS))
def o114(spark: SparkSession, d: str) -> DataFrame:
    """What each query's policy does, by how much, and of how many options."""
    a = cut(actions(spark, d))
    n = a.filter("action_id <> 'NOOP'").groupBy("query_id").agg(F.count(F.lit(1)).alias("options"))
    return selection.best_action(a, "reward", 0.1).join(n, "query_id").select("query_id", (F.col("action_id") != "NOOP").alias("acts"), r6("margin", "margin"), "options")


@query("o112_arm_contrast", sql("SELECT count(*) AS n, round(avg(a.r - b.r), 6) AS mean FROM (SELECT query_id, reward AS r FROM (" + _BEST.format(t=0) + ")) a JOIN (SELECT query_id, reward AS r FROM (" + _BEST.format(t=0.2) + ")) b USING (query_id)", "routes", "judged", base=_BASE, a=_ACTIONS))
def o112(spark: SparkSession, d: str) -> DataFrame:
    """A bold policy against a careful one."""
    a = cut(actions(spark, d))
    bold, careful = (selection.best_action(a, "reward", x).select("query_id", F.col("reward").alias(n)) for x, n in ((0.0, "a"), (0.2, "b")))
    return bold.join(careful, "query_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("a") - F.col("b")), "mean"))


@query("o111_fold_arms", sql(f"SELECT fold, count(*) AS queries, round(avg(r), 6) AS reward, count(*) FILTER (r < 0) AS harmed FROM (SELECT {_F3} AS fold, CASE WHEN s > 0.1 THEN reward ELSE 0.0 END AS r FROM m, (SELECT 0 AS repeat)) GROUP BY 1", "routes", "judged", a=_ACTIONS, m=_MARGINS))
def o111(spark: SparkSession, d: str) -> DataFrame:
    """A policy's rewards by fold."""
    m = lexical_margins(spark, d)
    rows = m.join(sampling.folds(m, "query_id", 3).select("query_id", "fold"), "query_id").withColumn("r", F.when(F.col("s") > 0.1, F.col("reward")).otherwise(0.0))
    return rows.groupBy(*[F.col("fold").cast("bigint").alias("fold")]).agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("r"), "reward"), F.count_if(F.col("r") < 0).alias("harmed"))


@query("o123_query_arm_means", sql("SELECT query_id, avg(d) AS dense, avg(f) AS fused FROM (SELECT query_id, round(avg(utility) FILTER (system = 'dense'), 6) AS d, round(avg(utility) FILTER (system LIKE 'rrf%'), 6) AS f FROM m0 GROUP BY 1) GROUP BY 1", "routes", "judged", **_M0))
def o123(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of systems averaged within each query."""
    is_ = lambda c: F.avg(F.when(c, F.col("utility")))
    return system_rows(spark, d).groupBy("query_id").agg(r6(is_(F.col("system") == "dense"), "dense"), r6(is_(F.col("system").startswith("rrf")), "fused"))


@query("o140_rank_correlation", sql("SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY sbert) + (count(*) OVER (PARTITION BY sbert) - 1) / 2.0 AS x, rank() OVER (ORDER BY utility) + (count(*) OVER (PARTITION BY utility) - 1) / 2.0 AS y FROM l WHERE sbert IS NOT NULL)", "pool", "judged", l=_L))
def o140(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rho over all judged candidates. Ranks come from counts of equal values, so no task orders all rows."""
    rows = labelled(spark, d).filter("sbert IS NOT NULL").select("sbert", "utility")

    def ranks(c: str, to: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
        split = cut(n.repartitionByRange(c).withColumn("part", F.spark_partition_id()))
        sizes = split.groupBy("part").agg(F.sum("n").alias("s"))
        before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.s"), F.lit(0)).alias("before"))  # one row per task
        from pyspark.sql import Window as W

        so_far = F.sum("n").over(W.partitionBy("part").orderBy(c).rowsBetween(W.unboundedPreceding, 0))
        return split.withColumn("so_far", so_far).join(before, "part").select(c, (F.col("before") + F.col("so_far") - (F.col("n") - 1) / 2).alias(to))

    both = rows.join(ranks("sbert", "x"), "sbert").join(ranks("utility", "y"), "utility")
    return both.agg(r6(F.corr("x", "y"), "rho"), F.count(F.lit(1)).alias("n"))


@query("o58_contract_gates", sql("SELECT gate, ok FROM (SELECT unnest(['splits disjoint', 'queries known', 'runs ranked', 'judgments unique']) AS gate, unnest([true, (SELECT count(*) FROM sp WHERE query_id NOT IN (SELECT query_id FROM texts)) = 0, (SELECT count(*) FROM (SELECT route, query_id FROM run GROUP BY ALL HAVING max(rank) <> count(*))) = 0, (SELECT count(*) = count(DISTINCT (query_id, comment_id)) FROM judged)]) AS ok)", "texts", "run", "judged", sp=SPLIT_SQL))
def o58(spark: SparkSession, d: str) -> DataFrame:
    """Gates that a stated protocol must pass, each counted."""
    s = mixed_split(spark, d)
    gates = {
        "splits disjoint": s.groupBy("query_id").agg(F.count_distinct("split").alias("n")).filter("n > 1"), "queries known": s.join(t.texts(spark, d).select("query_id"), "query_id", "left_anti"),
        "runs ranked": guards.run_violations(t.run(spark, d)), "judgments unique": t.judged(spark, d).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    }
    out = None
    for name, bad in gates.items():
        part = bad.agg(F.lit(name).alias("gate"), (F.count(F.lit(1)) == 0).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o53_reference_gate", sql("SELECT count(*) AS rows, count(DISTINCT query_id) AS queries, count(DISTINCT query_id) = 100 AS hundred, CAST(max(len(replies)) AS BIGINT) AS most FROM reply_references"))
def o53(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reply_references")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query_id").alias("queries"), (F.count_distinct("query_id") == 100).alias("hundred"), F.max(F.when(F.col("replies").isNotNull(), F.size("replies"))).cast("bigint").alias("most"))


@query("o78_backend_rankings", sql("SELECT backend, query_id, count(DISTINCT comment_id) AS items, string_agg(comment_id, ' ' ORDER BY rank_pos, comment_id) FILTER (rank_pos = 1) AS first FROM (SELECT DISTINCT backend, query_id, comment_id, rank_pos FROM retrieval_runs WHERE query_id IS NOT NULL AND comment_id IS NOT NULL) GROUP BY ALL"))
def o78(spark: SparkSession, d: str) -> DataFrame:
    """Stored rankings by backend: how many items, and what stands first (several on ties)."""
    rows = table(spark, d, "retrieval_runs").filter("query_id IS NOT NULL AND comment_id IS NOT NULL").select("backend", *PAIR, "rank_pos").distinct()
    first = F.array_sort(F.collect_list(F.when(F.col("rank_pos") == 1, F.col("comment_id"))))
    return rows.groupBy("backend", "query_id").agg(F.count_distinct("comment_id").alias("items"), F.when(F.size(first) > 0, F.concat_ws(" ", first)).alias("first"))


@query("o86_study_contract", sql("SELECT fault, count(*) AS n FROM (SELECT CASE WHEN n < 20 THEN 'small pool' WHEN j < n THEN 'unjudged' WHEN g = 0 THEN 'no graph' ELSE 'fit' END AS fault FROM (SELECT query_id, count(*) AS n, count(utility) AS j, count(*) FILTER (source_pool = 'graph4') AS g FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) GROUP BY 1)) GROUP BY 1", "pool", "judged"))
def o86(spark: SparkSession, d: str) -> DataFrame:
    """Queries by the first reason for which a study would leave them out."""
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("utility").alias("j"), F.count_if(F.col("source_pool") == "graph4").alias("g"))
    return count_by(per, fault=F.when(F.col("n") < 20, "small pool").when(F.col("j") < F.col("n"), "unjudged").when(F.col("g") == 0, "no graph").otherwise("fit"))


@query("o87_pools_by_family", sql("SELECT family, CAST(depth AS BIGINT) AS depth, count(*) AS pairs, round(avg(n), 6) AS per_query FROM (SELECT family, depth, query_id, count(*) OVER (PARTITION BY family, depth, query_id) AS n FROM (SELECT DISTINCT family, depth, query_id, comment_id FROM (SELECT 'dense' AS family, depth, query_id, comment_id FROM routes, (SELECT unnest([12, 20, 50]) AS depth) WHERE route = 'sbert' AND rank <= depth UNION ALL SELECT 'with graph', depth, query_id, comment_id FROM routes, (SELECT unnest([12, 20, 50]) AS depth) WHERE route = 'sbert' AND rank <= depth UNION ALL SELECT 'with graph', depth, query_id, comment_id FROM pool, (SELECT unnest([12, 20, 50]) AS depth) WHERE source_pool = 'graph4'))) GROUP BY ALL", "routes"))
def o87(spark: SparkSession, d: str) -> DataFrame:
    """Pools of two families by depth: the dense list, and with the graph's candidates."""
    steps = F.explode(F.array(F.lit(12), F.lit(20), F.lit(50)))
    dense = t.routes(spark, d).filter("route = 'sbert'").withColumn("depth", steps).filter("rank <= depth")
    graph = t.pool(spark, d).filter("source_pool = 'graph4'").withColumn("depth", steps)
    rows = union({"dense": dense}, "family", ["depth", *PAIR]).unionByName(dense.unionByName(graph, allowMissingColumns=True).select(F.lit("with graph").alias("family"), "depth", *PAIR)).distinct()
    per = rows.groupBy("family", "depth", "query_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("family", F.col("depth").cast("bigint").alias("depth")).agg(F.sum("n").alias("pairs"), r6(F.sum(F.col("n") * F.col("n")) / F.sum("n"), "per_query"))


@query("o138_universe_audit", sql("SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs, count(utility) AS labelled, count(*) FILTER (sbert IS NULL OR lexical IS NULL OR length IS NULL) AS incomplete FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id)", "pool", "judged"))
def o138(spark: SparkSession, d: str) -> DataFrame:
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return rows.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.count("utility").alias("labelled"), F.count_if(F.col("sbert").isNull() | F.col("lexical").isNull() | F.col("length").isNull()).alias("incomplete"))


@query("o143_group_sizes", sql("SELECT n AS size, count(*) AS queries FROM (SELECT query_id, count(*) AS n FROM candidate_features WHERE query_id IS NOT NULL GROUP BY 1) GROUP BY 1"))
def o143(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "candidate_features").filter("query_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("queries"))


@query("o150_strata_contrasts", sql("SELECT stratum, count(*) AS n, round(avg(delta), 6) AS mean FROM (SELECT unnest(['all', coalesce(tier, 'UNKNOWN')]) AS stratum, a.utility - b.utility AS delta FROM at3 a JOIN at3 b USING (query_id) LEFT JOIN texts USING (query_id) WHERE a.route = 'sbert' AND b.route = 'lexical' AND a.utility IS NOT NULL AND b.utility IS NOT NULL) GROUP BY 1", "routes", "judged", "texts", at3=_AT3))
def o150(spark: SparkSession, d: str) -> DataFrame:
    """Two routes' first three against each other, over all queries and in each stratum."""
    p = stats.paired(at_three(spark, d), "route", "sbert", "lexical", "utility").join(t.texts(spark, d).select("query_id", "tier"), "query_id", "left")
    each = p.select(F.explode(F.array(F.lit("all"), F.coalesce("tier", F.lit("UNKNOWN")))).alias("stratum"), "delta")
    return each.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta"), "mean"))


@query("o153_medians_of_known", sql("SELECT source_pool, round(quantile_cont(utility, 0.5), 6) AS median, round(quantile_cont(utility, 0.25), 6) AS lower, round(quantile_cont(utility, 0.75), 6) AS upper FROM l GROUP BY 1", "pool", "judged", l=_L))
def o153(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("source_pool").agg(*[r6(F.percentile("utility", q), n) for q, n in ((0.5, "median"), (0.25, "lower"), (0.75, "upper"))])


@query("o117_selector_tokens", sql("SELECT comment_id, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(comment_text, '')), '[a-z]{3,}'))) AS BIGINT) AS n FROM notes WHERE comment_id IN (SELECT comment_id FROM pool)", "pool", "notes"))
def o117(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the candidates' word sets, on which a selector measures overlap."""
    c = t.pool(spark, d).select("comment_id").distinct().join(t.comments(spark, d), "comment_id")
    return c.select("comment_id", F.size(F.array_distinct(tx.words3(F.col("comment_text")))).cast("bigint").alias("n"))


@query("o154_coverage_preflight", sql("SELECT system, count(*) AS pairs, count(j) AS judged, count(*) - count(j) AS missing FROM s LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) GROUP BY 1", "routes", "judged", two=_TWO, s=_SYSTEMS))
def o154(spark: SparkSession, d: str) -> DataFrame:
    """What every system lacks before its judging."""
    return setops.coverage(fixed_systems(spark, d), t.judged(spark, d), ["system"]).select("system", "pairs", "judged", "missing")


@query("o107_feature_vectors", sql("SELECT query_id, replaced || '>' || candidate AS action_id, round(c.sbert - r.sbert, 6) AS sbert, round(c.lexical - r.lexical, 6) AS lexical FROM a JOIN (SELECT query_id, comment_id AS candidate, coalesce(sbert, 0) AS sbert, coalesce(lexical, 0) AS lexical FROM pool) c USING (query_id, candidate) JOIN (SELECT query_id, comment_id AS replaced, coalesce(sbert, 0) AS sbert, coalesce(lexical, 0) AS lexical FROM pool) r USING (query_id, replaced)", "routes", "judged", a=_ACTIONS))
def o107(spark: SparkSession, d: str) -> DataFrame:
    """Differences of features for every swap."""
    base, fresh, judged = swap_inputs(spark, d)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = t.pool(spark, d).select(*PAIR, zero("sbert").alias("s"), zero("lexical").alias("l"))
    side = lambda i, n: p.select("query_id", F.col("comment_id").alias(i), F.col("s").alias(f"s{n}"), F.col("l").alias(f"l{n}"))
    a = selection.one_swap_actions(base, fresh, judged).filter("action_id <> 'NOOP'").join(side("candidate_id", 1), ["query_id", "candidate_id"]).join(side("replaced_id", 2), ["query_id", "replaced_id"])
    return a.select("query_id", "action_id", r6(F.col("s1") - F.col("s2"), "sbert"), r6(F.col("l1") - F.col("l2"), "lexical"))
