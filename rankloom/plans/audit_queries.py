"""Queries of resampled summaries, rebuilt tables, audits and ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import cut, table
from rankloom.functions import text as tx
from rankloom.operators import graph, learn, metrics, pools, ranking, sampling, selection, setops, stats

from . import tables as t
from .contract_queries import _ACTIONS, _L, _digest_sql, labelled
from .measure_queries import bootstrapped, drawn
from .metric_queries import _AT3, at_three
from .order_queries import _BASE, _BEST, _DEPTH, _LABEL_PARTS, _RESCUE, _SYSTEMS, _TWO, _U, action_labels, actions, budget_sql, fixed_systems, mean_known, oracle_inputs, union
from .outcome_queries import _BUDGETS, _LEX, _MARGINS, budget_values, lexical_margins
from .record_queries import _CANON, _PAIRTEXT, _redacted_sql, _vectors, pair_texts
from .runner_queries import _F3, _GRID, grid_values, mixed_split
from .runner_queries import _SPLIT as SPLIT_SQL
from .scan_queries import big, graph_run, r6
from .study_queries import _alignment_inputs
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


_TIMES = "CASE WHEN draw = 0 THEN 1 " + " ".join(f"WHEN CAST('0x' || x AS BIGINT) < {top} THEN {k}" for k, top in enumerate(stats.POISSON)) + " END"


def interval(spark: SparkSession, df: DataFrame, key: str, value: str, unit: str = "query_id", draws: int = 1000) -> DataFrame:
    return stats.bootstrap_mean(df, unit, value, [key], draws).select(key, "n", *[r6(c, c) for c in ("mean", "low", "high")])


# summaries


@query("i14_median_interval", sql("SELECT round(max(m) FILTER (draw = 0), 6) AS median, round(quantile_cont(m, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (draw > 0), 6) AS high FROM (SELECT draw, quantile_cont(v, 0.5) AS m FROM (SELECT draw, v, unnest(range(w)) FROM (SELECT *, " + _TIMES + " AS w FROM (" + drawn("SELECT query_id AS u, avg(utility) AS v FROM judged WHERE utility IS NOT NULL GROUP BY 1", 7, 200, 4) + ")) WHERE w > 0) GROUP BY 1)", "judged"))
def i14(spark: SparkSession, d: str) -> DataFrame:
    """The median over queries of their mean utility, with an interval: a unit counts in a draw as often as it is drawn."""
    per = t.judged(spark, d).filter("utility IS NOT NULL").groupBy("query_id").agg(F.avg("utility").alias("v"))
    m = stats.weights(per, "query_id", 200).filter("weight > 0").groupBy("draw").agg(F.percentile("v", 0.5, F.col("weight").cast("bigint")).alias("m"))
    sampled = F.when(F.col("draw") > 0, F.col("m"))
    return m.agg(r6(F.max(F.when(F.col("draw") == 0, F.col("m"))), "median"), r6(F.percentile(sampled, 0.025), "low"), r6(F.percentile(sampled, 0.975), "high"))


_RANKED = "SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY sbert) + (count(*) OVER (PARTITION BY query_id, sbert) - 1) / 2.0 AS a, rank() OVER (PARTITION BY query_id ORDER BY utility) + (count(*) OVER (PARTITION BY query_id, utility) - 1) / 2.0 AS b FROM l WHERE sbert IS NOT NULL"


@query("i18_rank_correlation_interval", sql("SELECT round(max(r) FILTER (draw = 0), 6) AS rho, round(quantile_cont(r, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(r, 0.975) FILTER (draw > 0), 6) AS high FROM (SELECT draw, round(sum(w * ab) / sqrt(sum(w * aa) * sum(w * bb)), 12) AS r FROM (SELECT *, " + _TIMES + " AS w FROM (" + drawn("SELECT query_id AS u, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM (SELECT query_id, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM k WINDOW w AS (PARTITION BY query_id)) GROUP BY 1", 7, 500, 4) + ")) WHERE w > 0 GROUP BY 1)", "pool", "judged", l=_L, k=_RANKED))
def i18(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation pooled over queries, with an interval over whole queries; ranks are those of the sample."""
    rows = labelled(spark, d).filter("sbert IS NOT NULL").select("query_id", ranking.average_rank(F.col("sbert"), ["query_id"]).alias("a"), ranking.average_rank(F.col("utility"), ["query_id"]).alias("b"))
    c = rows.select("query_id", learn.centred("a").alias("a"), learn.centred("b").alias("b"))
    sums = c.groupBy("query_id").agg(*[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in (("a", "a"), ("b", "b"), ("a", "b"))])
    w = stats.weights(sums, "query_id", 500).filter("weight > 0").groupBy("draw").agg(*[F.sum(F.col("weight") * F.col(x)).alias(x) for x in ("aa", "bb", "ab")])
    r = w.withColumn("r", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 12))
    sampled = F.when(F.col("draw") > 0, F.col("r"))
    return r.agg(r6(F.max(F.when(F.col("draw") == 0, F.col("r"))), "rho"), r6(F.percentile(sampled, 0.025), "low"), r6(F.percentile(sampled, 0.975), "high"))


@query("i19_mean_with_interval", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("x", "query_id", "v", "key", 1000) + ")", x="SELECT 'replies' AS key, query_id, CAST(len(replies) AS DOUBLE) AS v FROM reply_references WHERE replies IS NOT NULL"))
def i19(spark: SparkSession, d: str) -> DataFrame:
    """How many replies a reference has."""
    rows = table(spark, d, "reply_references").filter("replies IS NOT NULL").select(F.lit("replies").alias("key"), "query_id", F.size("replies").cast("double").alias("v"))
    return interval(spark, rows, "key", "v")


_RECALL = "SELECT o.route, g.query_id, count(*) FILTER (o.rank <= {k}) / CAST(max(g.n) AS DOUBLE) AS v FROM (SELECT query_id, comment_id, count(*) OVER (PARTITION BY query_id) AS n FROM gold) g JOIN routes o USING (query_id, comment_id) GROUP BY ALL"


@query("i23_recall_deltas", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("x", "query_id", "v", "key", 2000) + ")", "routes", "gold", r=_RECALL.format(k=20), x="SELECT 'sbert-lexical' AS key, a.query_id, a.v - b.v AS v FROM r a JOIN r b USING (query_id) WHERE a.route = 'sbert' AND b.route = 'lexical'"))
def i23(spark: SparkSession, d: str) -> DataFrame:
    """The difference of two routes' recall with its interval."""
    g = t.gold(spark, d)
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    per = g.join(t.routes(spark, d), PAIR).groupBy("route", "query_id").agg(F.count_if(F.col("rank") <= 20).alias("h")).join(n, "query_id").select("route", "query_id", (F.col("h") / F.col("n")).alias("v"))
    p = stats.paired(per, "route", "sbert", "lexical", "v").select(F.lit("sbert-lexical").alias("key"), "query_id", F.col("delta").alias("v"))
    return interval(spark, p, "key", "v", draws=2000)


@query("i25_arm_comparison", sql("SELECT count(*) AS n, round(avg(a.utility - b.utility), 6) AS mean, round(avg(CASE WHEN a.utility > b.utility THEN 1.0 ELSE 0.0 END), 6) AS positive, round(stddev_samp(a.utility - b.utility), 6) AS deviation FROM m a JOIN m b USING (query_id) WHERE a.route = 'sbert' AND b.route = 'length' AND a.utility IS NOT NULL AND b.utility IS NOT NULL", "routes", "judged", m=_AT3))
def i25(spark: SparkSession, d: str) -> DataFrame:
    p = stats.paired(at_three(spark, d), "route", "sbert", "length", "utility")
    return p.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta"), "mean"), r6(F.avg((F.col("delta") > 0).cast("double")), "positive"), r6(F.stddev_samp("delta"), "deviation"))


@query("i31_pairwise_with_p", sql("SELECT n, round(seen / n, 6) AS mean, round((count(*) FILTER (draw > 0 AND abs(t) >= abs(seen) - 1e-9) + 1) / 2001.0, 6) AS p FROM (SELECT *, max(t) FILTER (draw = 0) OVER () AS seen, CAST(max(c) OVER () AS BIGINT) AS n FROM (SELECT draw, sum(n) AS c, sum(CASE WHEN draw = 0 OR x >= '8' THEN s ELSE -s END) AS t FROM (" + drawn("SELECT query_id AS u, 1 AS n, a.utility - b.utility AS s FROM m a JOIN m b USING (query_id) WHERE a.route = 'lexical' AND b.route = 'length' AND a.utility IS NOT NULL AND b.utility IS NOT NULL", 11, 2000, 1) + ") GROUP BY 1)) GROUP BY ALL", "routes", "judged", m=_AT3))
def i31(spark: SparkSession, d: str) -> DataFrame:
    """A paired difference with the chance of one as large if signs were random."""
    p = stats.paired(at_three(spark, d), "route", "lexical", "length", "utility")
    return stats.sign_flip(p, "query_id", "delta", None, 2000, 11).select("n", r6("mean", "mean"), r6("p", "p"))


@query("i36_rescue_summary", sql("SELECT count(*) AS swaps, round(avg(CASE WHEN reward > 0 THEN 1.0 ELSE 0.0 END), 6) AS better, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in _LABEL_PARTS) + " FROM x WHERE reward IS NOT NULL", "routes", "judged", a=_ACTIONS, x=_RESCUE))
def i36(spark: SparkSession, d: str) -> DataFrame:
    """How many swaps help, and by which labels on average."""
    x = action_labels(spark, d).filter("reward IS NOT NULL")
    return x.agg(F.count(F.lit(1)).alias("swaps"), r6(F.avg((F.col("reward") > 0).cast("double")), "better"), *[r6(F.avg(n), n) for n in _LABEL_PARTS])


@query("i46_group_summary", sql("SELECT setting, tier, coalesce(scenario, 'UNKNOWN') AS scenario, count(*) AS queries, round(avg(value), 6) AS value FROM v JOIN texts USING (query_id) GROUP BY ALL", "pool", "judged", "texts", v=_GRID))
def i46(spark: SparkSession, d: str) -> DataFrame:
    rows = grid_values(spark, d).join(t.texts(spark, d).select("query_id", "tier", F.coalesce("scenario", F.lit("UNKNOWN")).alias("scenario")), "query_id")
    return rows.groupBy("setting", "tier", "scenario").agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("value"), "value"))


_AGAINST0 = "SELECT a.setting, a.query_id, a.value - b.value AS delta FROM v a JOIN v b USING (query_id) WHERE a.setting > 0 AND b.setting = 0"


def against_zero(spark: SparkSession, d: str) -> DataFrame:
    """(setting, query_id, delta): each setting's value less that of setting 0."""
    v = cut(grid_values(spark, d))
    zero = v.filter("setting = 0").select("query_id", F.col("value").alias("b"))
    return v.filter("setting > 0").join(zero, "query_id").select("setting", "query_id", (F.col("value") - F.col("b")).alias("delta"))


@query("i47_setting_contrasts", sql("SELECT setting, count(*) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (abs(delta) > 1e-12) AS changed FROM x GROUP BY 1", "pool", "judged", v=_GRID, x=_AGAINST0))
def i47(spark: SparkSession, d: str) -> DataFrame:
    return against_zero(spark, d).groupBy("setting").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta"), "mean"), F.count_if(F.abs("delta") > 1e-12).alias("changed"))


@query("i49_setting_intervals", sql("SELECT CAST(key AS DOUBLE) AS setting, n, mean, low, high FROM (" + bootstrapped("y", "query_id", "delta", "key", 1000) + ")", "pool", "judged", v=_GRID, x=_AGAINST0, y="SELECT CAST(setting AS VARCHAR) AS key, query_id, delta FROM x"))
def i49(spark: SparkSession, d: str) -> DataFrame:
    return interval(spark, against_zero(spark, d), "setting", "delta")


_OVER_BASE = "SELECT 'budget ' || a.budget AS key, a.query_id, a.value - b.value AS delta FROM v a JOIN v b USING (query_id) WHERE a.budget > 0 AND b.budget = 0"


def over_base(spark: SparkSession, d: str) -> DataFrame:
    v = budget_values(spark, d)
    zero = v.filter("budget = 0").select("query_id", F.col("value").alias("b"))
    return v.filter("budget > 0").join(zero, "query_id").select(F.concat(F.lit("budget "), F.col("budget").cast("string")).alias("key"), "query_id", (F.col("value") - F.col("b")).alias("delta"))


_B = {"base": _BASE, "u": _U, "lex": _LEX, "v": _BUDGETS}


@query("i57_summaries_by_shared_draws", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("x", "query_id", "delta", "key", 1000) + ")", "routes", "judged", **_B, x=_OVER_BASE))
def i57(spark: SparkSession, d: str) -> DataFrame:
    """Two budgets' gains over the baseline on the same draws of queries."""
    return interval(spark, over_base(spark, d), "key", "delta")


@query("o96_paired_summary", sql("SELECT key, count(*) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (delta < -1e-12) AS losses FROM x GROUP BY 1", "routes", "judged", **_B, x=_OVER_BASE))
def o96(spark: SparkSession, d: str) -> DataFrame:
    w = stats.win_tie_loss(over_base(spark, d), ["key"])
    # a tie in the seventh digit is one only without the noise of sums, which is far under 12 digits
    return w.select("key", "n", *[r6(F.round(f"{x}_delta", 12), x) for x in ("mean", "median")], "wins", "losses")


# rebuilt tables


@query("o12_rebuilt_graph", sql("SELECT * FROM (" + _digest_sql("(SELECT DISTINCT author AS src, link_id AS dst FROM comments WHERE author IS NOT NULL AND link_id IS NOT NULL)", "dst", "src") + "), (SELECT true AS same)"))
def o12(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a graph built from rows in two orders: digest, number, and whether both are the same."""
    c = table(spark, d, "comments").filter("author IS NOT NULL AND link_id IS NOT NULL")
    edges = lambda df: df.select(F.col("author").alias("src"), F.col("link_id").alias("dst"))
    a, b = setops.set_digest(edges(c), ["src", "dst"]), setops.set_digest(edges(c.repartition(5, "link_id")).distinct(), ["dst", "src"])
    return a.crossJoin(b.select(F.col("digest").alias("again"))).select("digest", "n", (F.col("digest") == F.col("again")).alias("same"))  # one row each


@query("o14_partition_digests", sql(" UNION ALL ".join(f"SELECT '{s}' AS split, * FROM ({_digest_sql(f'(SELECT query_id, tier FROM sp WHERE split = {chr(39)}{s}{chr(39)})', 'query_id', 'tier')})" for s in ("validation", "test", "reserve")), "texts", sp=SPLIT_SQL))
def o14(spark: SparkSession, d: str) -> DataFrame:
    """Digests of a split's parts, by which a rebuilt one is compared."""
    rows, out = cut(mixed_split(spark, d)), None
    for name in ("validation", "test", "reserve"):
        part = setops.set_digest(rows.filter(F.col("split") == name), ["query_id", "tier"]).select(F.lit(name).alias("split"), "digest", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("o16_cohorts", sql("SELECT cohort, count(*) AS n FROM (SELECT unnest(CASE WHEN g THEN CASE WHEN f THEN ['all', 'judged', 'judged with text'] ELSE ['all', 'judged'] END ELSE ['all'] END) AS cohort FROM (SELECT query_id IN (SELECT query_id FROM judged) AS g, trim(coalesce(query_text, '')) NOT IN ('', '[deleted]', '[removed]') AS f FROM texts)) GROUP BY 1", "texts", "judged"))
def o16(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts of which each is part of the one before."""
    held = t.judged(spark, d).select("query_id").distinct().withColumn("g", F.lit(True))
    rows = t.texts(spark, d).join(held, "query_id", "left").withColumn("f", ~F.trim(F.coalesce("query_text", F.lit(""))).isin(tx.TOMBSTONES))
    return rows.select(F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("g"), "judged"), F.when(F.col("g") & F.col("f"), "judged with text")))).alias("cohort")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("o18_reproduced_ranks", sql("SELECT route, count(*) AS pairs, count(*) FILTER (rank = p) AS same, CAST(max(abs(rank - p)) AS BIGINT) AS largest FROM run JOIN (SELECT backend AS route, query_id, comment_id, min(rank_pos) AS p FROM retrieval_runs GROUP BY ALL) USING (route, query_id, comment_id) GROUP BY 1", "run"))
def o18(spark: SparkSession, d: str) -> DataFrame:
    """Ranks made anew from the stored scores against the stored ranks."""
    stored = table(spark, d, "retrieval_runs").groupBy(F.col("backend").alias("route"), *PAIR).agg(F.min("rank_pos").alias("p"))
    both = t.run(spark, d).join(stored, ["route", *PAIR])
    return both.groupBy("route").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("rank") == F.col("p")).alias("same"), F.max(F.abs(F.col("rank") - F.col("p"))).cast("bigint").alias("largest"))


@query("o23_community_workload", sql("SELECT count(*) AS texts, count(*) FILTER (n > 1) AS shared FROM (SELECT sha256(" + _CANON.format(c="comment_text") + ") AS h, count(DISTINCT comment_id) AS n FROM notes WHERE comment_text IS NOT NULL AND comment_id IN (SELECT comment_id FROM pool) GROUP BY 1)", "notes", "pool"))
def o23(spark: SparkSession, d: str) -> DataFrame:
    """Different texts of the candidates, and those that several candidates share."""
    c = t.pool(spark, d).select("comment_id").distinct().join(t.comments(spark, d), "comment_id").filter("comment_text IS NOT NULL").groupBy(tx.text_digest(F.col("comment_text")).alias("h")).agg(F.count_distinct("comment_id").alias("n"))
    return c.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > 1).alias("shared"))


@query("o28_label_means", sql("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in t.LABELS) + ", count(*) AS n FROM judged", "judged"))
def o28(spark: SparkSession, d: str) -> DataFrame:
    return t.judged(spark, d).agg(*[r6(F.avg(c), c) for c in t.LABELS], F.count(F.lit(1)).alias("n"))


# audits


@query("o35_frozen_payloads", sql(f"SELECT part, count(*) AS n, count(*) FILTER (r <> comment_text) AS redacted FROM (SELECT CASE WHEN (query_id, comment_id) IN (SELECT (query_id, comment_id) FROM judged) THEN 'anchor' ELSE 'residual' END AS part, comment_text, {_redacted_sql('comment_text')} AS r FROM x WHERE comment_text IS NOT NULL) GROUP BY 1", "pool", "texts", "notes", "judged", x=_PAIRTEXT))
def o35(spark: SparkSession, d: str) -> DataFrame:
    """What a judge would be sent, by whether it was judged before, and how many texts were redacted."""
    held = t.judged(spark, d).select(*PAIR, F.lit(True).alias("j"))
    rows = pair_texts(spark, d).filter("comment_text IS NOT NULL").join(held, PAIR, "left").withColumn("r", tx.redacted(F.col("comment_text")))
    return rows.groupBy(F.when(F.col("j"), "anchor").otherwise("residual").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") != F.col("comment_text")).alias("redacted"))


@query("o37_link_audit", sql("SELECT CAST(least(n, 5) AS BIGINT) AS links, count(*) AS documents, CAST(sum(kinds) AS BIGINT) AS kinds FROM (SELECT doc_id, len(l) AS n, len(list_distinct(list_transform(l, lambda u: CASE " + " ".join(f"WHEN regexp_matches(lower(u), '{p}') THEN '{k}'" for k, p in tx.LINK_KINDS) + " ELSE 'other' END))) AS kinds FROM (SELECT doc_id, max(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s)\\]>]+')) AS l FROM documents GROUP BY 1)) GROUP BY 1"))
def o37(spark: SparkSession, d: str) -> DataFrame:
    """Documents by how many links they have, and of how many kinds these are."""
    rows = table(spark, d, "documents").groupBy("doc_id").agg(F.max(tx.links(F.col("text"))).alias("l"))
    kinds = F.size(F.array_distinct(F.transform("l", tx.link_kind)))
    return rows.groupBy(F.least(F.size("l"), F.lit(5)).cast("bigint").alias("links")).agg(F.count(F.lit(1)).alias("documents"), F.sum(kinds).alias("kinds"))


@query("o39_affected_systems", sql("SELECT system, count(DISTINCT query_id) AS queries, count(*) AS pairs FROM s JOIN (SELECT query_id, comment_id FROM qrels GROUP BY ALL HAVING count(DISTINCT judged_at) > 1) USING (query_id, comment_id) GROUP BY 1", "routes", two=_TWO, s=_SYSTEMS))
def o39(spark: SparkSession, d: str) -> DataFrame:
    """Systems whose lists hold pairs that were judged again."""
    again = table(spark, d, "qrels").groupBy(*PAIR).agg(F.count_distinct("judged_at").alias("n")).filter("n > 1").select(*PAIR)
    return fixed_systems(spark, d).join(again, PAIR).groupBy("system").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"))


@query("o41_label_budget", sql("SELECT system, CAST(budget AS BIGINT) AS budget, count(*) FILTER (missing <= budget) AS complete FROM (SELECT system, query_id, count(*) - count(j) AS missing FROM s LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged WHERE utility IS NOT NULL) USING (query_id, comment_id) GROUP BY ALL), (SELECT unnest([0, 1, 2, 4]) AS budget) GROUP BY ALL", "routes", "judged", two=_TWO, s=_SYSTEMS))
def o41(spark: SparkSession, d: str) -> DataFrame:
    """How many lists would be complete with so many more labels for each."""
    j = t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, F.lit(1).alias("j"))
    per = fixed_systems(spark, d).join(j, PAIR, "left").groupBy("system", "query_id").agg((F.count(F.lit(1)) - F.count("j")).alias("missing"))
    each = per.withColumn("budget", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(4))))
    return each.groupBy("system", F.col("budget").cast("bigint").alias("budget")).agg(F.count_if(F.col("missing") <= F.col("budget")).alias("complete"))


@query("o66_fold_actions", sql(f"SELECT fold, count(*) AS actions, count(DISTINCT query_id) AS queries, round(avg(reward), 6) AS reward FROM (SELECT a.query_id, reward, {_F3.replace('query_id', 'a.query_id')} AS fold FROM a, (SELECT 0 AS repeat)) WHERE reward IS NOT NULL GROUP BY 1", "routes", "judged", a=_ACTIONS))
def o66(spark: SparkSession, d: str) -> DataFrame:
    """Judged swaps by the fold of their query."""
    a = actions(spark, d).filter("action_id <> 'NOOP' AND reward IS NOT NULL")
    rows = a.join(sampling.folds(a, "query_id", 3).select("query_id", "fold"), "query_id")
    return rows.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("query_id").alias("queries"), r6(F.avg("reward"), "reward"))


@query("o95_selector_results", sql(" UNION ALL ".join(f"SELECT '{n}' AS scorer, {b} AS budget, count(*) AS queries, round(avg(value), 6) AS utility FROM (SELECT query_id, avg(u.score) AS value FROM ({budget_sql(_DEPTH.format(n=30), b, n)}) z JOIN u USING (query_id, comment_id) GROUP BY 1)" for n in ("lexical", "length") for b in (1, 4)), "routes", "judged", base=_BASE, u=_U, lexical=_LEX, length="SELECT query_id, comment_id, score FROM routes WHERE route = 'length'"))
def o95(spark: SparkSession, d: str) -> DataFrame:
    """Two scorers at two budgets."""
    base, run, u = oracle_inputs(spark, d)
    pool, out = run.filter("route = 'sbert' AND rank <= 30"), None
    for name in ("lexical", "length"):
        scores = run.filter(F.col("route") == name).select(*PAIR, "score")
        for b in (1, 4):
            v = mean_known(selection.budgeted_set(base, pool, scores, b), u)
            part = v.agg(F.lit(name).alias("scorer"), F.lit(b).cast("bigint").alias("budget"), F.count(F.lit(1)).alias("queries"), r6(F.avg("value"), "utility"))
            out = part if out is None else out.unionByName(part)
    return out


@query("o103_interval_by_setting", sql("SELECT CAST(key AS DOUBLE) AS setting, n, mean, low, high FROM (" + bootstrapped("y", "query_id", "value", "key", 1000) + ")", "pool", "judged", v=_GRID, y="SELECT CAST(setting AS VARCHAR) AS key, query_id, value FROM v"))
def o103(spark: SparkSession, d: str) -> DataFrame:
    return interval(spark, grid_values(spark, d), "setting", "value")


@query("o109_padded_actions", sql("SELECT query_id, count(*) + 1 AS rows, max(count(*) + 1) OVER () AS padded FROM a GROUP BY 1", "routes", "judged", a=_ACTIONS))
def o109(spark: SparkSession, d: str) -> DataFrame:
    """Actions of each query, doing nothing included, and to how many all are padded."""
    n = actions(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
    return n.crossJoin(F.broadcast(n.agg(F.max("rows").alias("padded"))))


@query("o72_two_policies", sql("SELECT count(*) AS n, round(avg(x - y), 6) AS mean, count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses FROM (SELECT query_id, CASE WHEN s > 0 THEN reward ELSE 0.0 END AS x FROM m) JOIN (SELECT query_id, CASE WHEN s > 0.2 THEN reward ELSE 0.0 END AS y FROM m) USING (query_id)", "routes", "judged", a=_ACTIONS, m=_MARGINS))
def o72(spark: SparkSession, d: str) -> DataFrame:
    """One score under two thresholds, query by query."""
    m = lexical_margins(spark, d)
    x, y = (F.when(F.col("s") > at, F.col("reward")).otherwise(0.0) for at in (0.0, 0.2))
    return m.select(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("x") - F.col("y")), "mean"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"))


@query("o113_against_the_oracle", sql("SELECT count(*) AS n, round(avg(o.reward - coalesce(m.r, 0)), 6) AS regret, count(*) FILTER (o.reward > coalesce(m.r, 0) + 1e-12) AS missed FROM (SELECT query_id, reward FROM (" + _BEST.format(t=0) + ")) o LEFT JOIN (SELECT query_id, CASE WHEN s > 0 THEN reward ELSE 0.0 END AS r FROM m) m USING (query_id)", "routes", "judged", base=_BASE, a=_ACTIONS, m=_MARGINS))
def o113(spark: SparkSession, d: str) -> DataFrame:
    """What a policy leaves of the best possible swap."""
    best = selection.best_action(actions(spark, d), "reward").select("query_id", "reward")
    own = lexical_margins(spark, d).select("query_id", F.when(F.col("s") > 0, F.col("reward")).otherwise(0.0).alias("r"))
    gap = F.col("reward") - F.coalesce("r", F.lit(0.0))
    return best.join(own, "query_id", "left").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(gap), "regret"), F.count_if(gap > 1e-12).alias("missed"))


@query("o124_arm_contrasts", sql("SELECT a.route || '-' || b.route AS contrast, count(*) AS n, round(avg(a.ndcg - b.ndcg), 6) AS mean FROM m a JOIN m b USING (query_id) WHERE a.route < b.route AND a.ndcg IS NOT NULL AND b.ndcg IS NOT NULL GROUP BY 1", "routes", "judged", m=_AT3))
def o124(spark: SparkSession, d: str) -> DataFrame:
    rows, out = cut(at_three(spark, d)), None
    for a, b in (("length", "lexical"), ("length", "sbert"), ("lexical", "sbert")):
        part = stats.paired(rows, "route", a, b, "ndcg").agg(F.lit(f"{a}-{b}").alias("contrast"), F.count(F.lit(1)).alias("n"), r6(F.avg("delta"), "mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o148_correlations_of_sources", sql("SELECT source_pool, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS rho FROM (SELECT source_pool, rank() OVER (PARTITION BY source_pool, query_id ORDER BY lexical) + (count(*) OVER (PARTITION BY source_pool, query_id, lexical) - 1) / 2.0 AS x, rank() OVER (PARTITION BY source_pool, query_id ORDER BY utility) + (count(*) OVER (PARTITION BY source_pool, query_id, utility) - 1) / 2.0 AS y FROM l WHERE lexical IS NOT NULL) GROUP BY 1", "pool", "judged", l=_L))
def o148(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of ranks within query and source, by source; null where it is not defined."""
    keys = ["source_pool", "query_id"]
    rows = labelled(spark, d).filter("lexical IS NOT NULL").select("source_pool", ranking.average_rank(F.col("lexical"), keys).alias("x"), ranking.average_rank(F.col("utility"), keys).alias("y"))
    n = F.count(F.lit(1))
    return rows.groupBy("source_pool").agg(n.alias("n"), r6(F.when((n >= 3) & (F.var_pop("x") > 0) & (F.var_pop("y") > 0), F.corr("x", "y")), "rho"))


# ablations and merges without SQL


@query("d5_graph_round_robin")
def d5(spark: SparkSession, d: str) -> DataFrame:
    """The graph's native routes taking turns, without what the dense list's head has, with the route that brought each item."""
    g = graph_run(spark, d).select(*PAIR, F.explode("native").alias("route", "score"))
    run = ranking.ranked(g, ranking.KEYS, [F.desc("score"), "comment_id"])
    return pools.round_robin(run, ["fact", "passage"], t.routes(spark, d).filter("route = 'sbert' AND rank <= 8"), 4)


@query("g38_alignment_of_sets")
def g38(spark: SparkSession, d: str) -> DataFrame:
    """How near each query's set is to its reference replies: both coverages, their mean F, and sizes."""
    c, r = _alignment_inputs(spark, d)
    sizes = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates")).join(r.groupBy("query_id").agg(F.count(F.lit(1)).alias("replies")), "query_id")
    return metrics.alignment(c, r, 0.6).select("query_id", *[r6(x, x) for x in ("cra", "rcc", "f1")]).join(sizes, "query_id")


@query("o101_diversity_ablation")
def o101(spark: SparkSession, d: str) -> DataFrame:
    """Utility and mean distance of sets chosen with more and more weight on being different."""
    v = cut(_vectors(spark, d).withColumn("in_baseline", F.lit(False)))
    judged, out = t.judged(spark, d), None
    for lam in (0.0, 0.3, 0.6):
        chosen = cut(selection.mmr(v, lam, 8))
        u = metrics.set_utility(chosen.select(F.lit("mmr").alias("route"), *PAIR, F.col("pick").alias("rank")), judged, 8).select("query_id", "utility")
        far = selection.intra_list_distance(chosen.join(v.select(*PAIR, "vec"), PAIR))
        part = far.join(u, "query_id").agg(F.lit(lam).alias("weight"), F.count(F.lit(1)).alias("queries"), r6(F.avg("utility"), "utility"), r6(F.avg("ild"), "distance"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o84_walk_trace")
def o84(spark: SparkSession, d: str) -> DataFrame:
    """Where walks from two facts of each query enter the graph of authors and threads: the ten heaviest nodes."""
    c = cut(t.comments(spark, d).filter("author IS NOT NULL AND link_id IS NOT NULL").select("comment_id", "author", "link_id"))
    e = c.select(F.concat(F.lit("a:"), "author").alias("src"), F.col("link_id").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    facts = ranking.top_k(graph_run(spark, d).filter("native['fact'] IS NOT NULL").withColumn("s", F.col("native")["fact"]), ["query_id"], [F.desc("s"), "comment_id"], 2)
    seeds = facts.join(c.select("comment_id", F.col("link_id").alias("node")), "comment_id").select("query_id", "node", F.col("s").alias("weight"))
    seeds = cut(seeds)
    walked = graph.pagerank(both, seeds, 0.5, 2, 5, 10)
    return ranking.top_k(walked, ["query_id"], [F.desc(F.round("score", 12)), "node"], 10).select("query_id", "node", r6("score", "score"), *big("rank"))


