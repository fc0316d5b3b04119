"""Queries of scorer inputs, judging, reports and composed studies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.base import cut, lookup_skewed, shared_folder, table
from rankloom.functions import text as tx
from rankloom.functions import utility as ut
from rankloom.functions import vectors
from rankloom.operators import fusion, guards, learn, metrics, ranking, sampling, selection, setops, stats
from rankloom.sources import io
from rankloom.streaming import judging

from . import tables as t
from .contract_queries import _ACTIONS, _L, _LOPO, labelled, lopo_run, values
from .measure_queries import _IDEAL, bootstrapped
from .order_queries import _BASE, _BEST, _DEPTH, _SYSTEM_ROWS, _SYSTEMS, _TWO, _U, actions, budget_sql, fixed_systems, mean_known, oracle_inputs, system_rows, union
from .record_queries import _CANON, _MD5, _PAIRTEXT, _TOK, FEATURES, pair_texts
from .scan_queries import _GRAPH, GRAPH, big, graph_run, own_links, r6
from .tables import PAIR, sql
from .text_queries import _MATRIX, _UNIT, feature_matrix, unit_vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# scorers


@query("k2_unit_mean_weights", sql("SELECT round(avg(w), 6) AS mean, round(min(w), 6) AS least, round(max(w), 6) AS most FROM (SELECT count(*) OVER () / CAST((SELECT count(DISTINCT query_id) FROM l) * count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS w FROM l)", "pool", "judged", l=_L))
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Weights that give each query the same sum, rescaled to a mean of 1."""
    return learn.query_weights(labelled(spark, d)).agg(r6(F.avg("weight"), "mean"), r6(F.min("weight"), "least"), r6(F.max("weight"), "most"))


_LINE = "SELECT regr_slope(utility, sbert) AS b, regr_intercept(utility, sbert) AS a FROM l WHERE sbert IS NOT NULL"


@query("k31_predictions", sql(f"SELECT query_id, comment_id, round(greatest(1, least(7, a + b * sbert)), 4) AS score FROM pool, ({_LINE}) WHERE sbert IS NOT NULL", "pool", "judged", l=_L))
def k31(spark: SparkSession, d: str) -> DataFrame:
    """A straight line fitted to all judged candidates, and its predictions for every candidate."""
    from pyspark.ml.regression import LinearRegression

    rows = labelled(spark, d).filter("sbert IS NOT NULL").select("sbert", F.col("utility").cast("double").alias("label"))
    model = LinearRegression(regParam=0.0, solver="normal").fit(learn.assembled(rows, ["sbert"]))
    score = model.intercept + F.col("sbert") * float(model.coefficients[0])
    return t.pool(spark, d).filter("sbert IS NOT NULL").select(*PAIR, F.round(F.greatest(F.lit(1.0), F.least(F.lit(7.0), score)), 4).alias("score"))


_GRID = "SELECT setting, query_id, avg(utility) AS value FROM (SELECT setting, query_id, comment_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(coalesce(sbert, 0) + setting * coalesce(lexical, 0), 9) DESC, comment_id) AS p FROM pool, (SELECT unnest([0.0, 0.5, 1.0, 2.0]) AS setting)) JOIN judged USING (query_id, comment_id) WHERE p <= 8 AND utility IS NOT NULL GROUP BY ALL"


def grid_values(spark: SparkSession, d: str) -> DataFrame:
    """(setting, query_id, value): the mean utility of eight candidates by two features, for each weight of the second."""
    rows = t.pool(spark, d).withColumn("setting", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)])))
    rows = rows.withColumn("s", F.round(F.coalesce("sbert", F.lit(0.0)) + F.col("setting") * F.coalesce("lexical", F.lit(0.0)), 9))
    top = ranking.top_k(rows, ["setting", "query_id"], [F.desc("s"), "comment_id"], 8, "p")
    return top.join(t.judged(spark, d).filter("utility IS NOT NULL").select(*PAIR, "utility"), PAIR).groupBy("setting", "query_id").agg(F.avg("utility").alias("value"))


@query("k32_tuned_setting", sql("SELECT setting, round(avg(value), 6) AS mean FROM v GROUP BY 1 ORDER BY round(avg(value), 9) DESC, setting LIMIT 1", "pool", "judged", v=_GRID))
def k32(spark: SparkSession, d: str) -> DataFrame:
    """The setting with the largest mean over queries; the smaller on ties."""
    means = grid_values(spark, d).groupBy("setting").agg(F.avg("value").alias("mean"))
    return means.orderBy(F.desc(F.round("mean", 9)), "setting").limit(1).select("setting", r6("mean", "mean"))


_F3 = "CAST(CAST(('0x' || substr(md5(query_id || '#7#' || repeat), 1, 15)) AS BIGINT) % 3 AS BIGINT)"
_CHOSEN = f"SELECT repeat, fold, setting FROM (SELECT repeat, fold, setting, row_number() OVER (PARTITION BY repeat, fold ORDER BY round(avg(value), 9) DESC, setting) AS n FROM (SELECT v.*, repeat, {_F3} AS f FROM v, (SELECT CAST(unnest(range(2)) AS BIGINT) AS repeat)), (SELECT CAST(unnest(range(3)) AS BIGINT) AS fold) WHERE f <> fold GROUP BY repeat, fold, setting) WHERE n = 1"


def chosen_settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each fold's best setting on its training queries, and the values with the queries' folds."""
    v = cut(grid_values(spark, d))
    f = sampling.folds(v, "query_id", 3, 2).withColumnRenamed("fold", "f")
    rows = v.join(f, "query_id")
    per = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("f <> fold").groupBy("repeat", "fold", "setting").agg(F.round(F.avg("value"), 9).alias("m"))
    return ranking.top_k(per, ["repeat", "fold"], [F.desc("m"), "setting"], 1, "n").select("repeat", "fold", "setting"), rows


@query("k33_settings_of_folds", sql(f"SELECT repeat, fold, setting FROM ({_CHOSEN})", "pool", "judged", v=_GRID))
def k33(spark: SparkSession, d: str) -> DataFrame:
    return chosen_settings(spark, d)[0].select(*big("repeat", "fold"), "setting")


@query("k36_cross_fitted_values", sql(f"SELECT query_id, count(*) AS repeats, round(avg(value), 6) AS value FROM (SELECT v.query_id, v.setting, value, repeat, {_F3.replace('query_id', 'v.query_id')} AS fold FROM v, (SELECT CAST(unnest(range(2)) AS BIGINT) AS repeat)) JOIN ({_CHOSEN}) USING (repeat, fold, setting) GROUP BY 1", "pool", "judged", v=_GRID))
def k36(spark: SparkSession, d: str) -> DataFrame:
    """Each query's value under the setting that was chosen without it, averaged over repeats."""
    chosen, rows = chosen_settings(spark, d)
    held = rows.withColumnRenamed("f", "fold").join(chosen, ["repeat", "fold", "setting"])
    return held.groupBy("query_id").agg(F.count(F.lit(1)).alias("repeats"), r6(F.avg("value"), "value"))


@query("k37_modal_setting", sql(f"SELECT setting, n FROM (SELECT setting, count(*) AS n FROM ({_CHOSEN}) GROUP BY 1) ORDER BY n DESC, setting LIMIT 1", "pool", "judged", v=_GRID))
def k37(spark: SparkSession, d: str) -> DataFrame:
    """The setting that most folds chose."""
    return learn.modal(chosen_settings(spark, d)[0].withColumn("all", F.lit(1)), ["all"], "setting").select("setting", "n")


@query("k34_query_settings", sql(f"SELECT query_id, max(setting) AS largest, min(setting) AS smallest FROM (SELECT query_id, setting FROM (SELECT DISTINCT query_id, repeat, {_F3} AS fold FROM v, (SELECT CAST(unnest(range(2)) AS BIGINT) AS repeat)) JOIN ({_CHOSEN}) USING (repeat, fold)) GROUP BY 1", "pool", "judged", v=_GRID))
def k34(spark: SparkSession, d: str) -> DataFrame:
    """The settings under which each query was held out."""
    chosen, rows = chosen_settings(spark, d)
    held = rows.select("query_id", "repeat", F.col("f").alias("fold")).distinct().join(chosen, ["repeat", "fold"])
    return held.groupBy("query_id").agg(F.max("setting").alias("largest"), F.min("setting").alias("smallest"))


@query("k41_token_lengths", sql("SELECT count(*) AS pairs, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.95), 4) AS p95, round(avg(CASE WHEN n > 64 THEN 1.0 ELSE 0.0 END), 6) AS over_64 FROM (SELECT len(regexp_extract_all(coalesce(query_text, '') || ' ' || coalesce(comment_text, ''), '\\S+')) AS n FROM x)", "pool", "texts", "notes", x=_PAIRTEXT))
def k41(spark: SparkSession, d: str) -> DataFrame:
    """How long pairs of texts are in words, and how many a scorer of 64 would cut."""
    n = F.regexp_count(F.concat(F.coalesce("query_text", F.lit("")), F.lit(" "), F.coalesce("comment_text", F.lit(""))), F.lit(r"\S+"))
    rows = pair_texts(spark, d).select(n.alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.percentile("n", 0.5), 4).alias("median"), F.round(F.percentile("n", 0.95), 4).alias("p95"), r6(F.avg((F.col("n") > 64).cast("double")), "over_64"))


@query("k26_action_policy")
def k26(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of one-swap actions predicted by a Huber fit on the differences of both items' features, losses doubled."""
    a, p = actions(spark, d).filter("action_id <> 'NOOP'"), t.pool(spark, d)
    side = lambda s, i: p.select("query_id", F.col("comment_id").alias(i), *[F.coalesce(c, F.lit(0.0)).alias(f"{s}_{c}") for c in FEATURES])
    rows = a.join(side("c", "candidate_id"), ["query_id", "candidate_id"]).join(side("r", "replaced_id"), ["query_id", "replaced_id"])
    rows = rows.select("query_id", F.col("action_id").alias("comment_id"), *[(F.col(f"c_{c}") - F.col(f"r_{c}")).alias(c) for c in FEATURES], (4 + selection.downside_weighted(F.col("reward"), 2.0)).alias("utility"))
    return learn.out_of_fold(rows, sampling.folds(rows, "query_id", 2), 2, lambda x, y: learn.fit_pointwise(x, y, FEATURES, "utility", "huber")).withColumnRenamed("comment_id", "action_id")


# judging


def stub_judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands in for a hosted judge: labels from the lengths of the texts, in a sentence of an answer; every seventh call
    fails once and is made again."""
    for b in batches:
        answers, calls = [], []
        for q, c in zip(b["query_text"], b["comment_text"]):
            n = len(c) % 7 + 1
            tries = 2 if (len(q) + len(c)) % 7 == 0 else 1
            answers.append(f'Here you are: {{"label_relevance": {n}, "label_usefulness": {8 - n}}}')
            calls.append(tries)
        yield b.assign(answer=answers, calls=calls)


_JUDGED = "SELECT query_id, comment_id, length(comment_text) % 7 + 1 AS relevance, 7 - length(comment_text) % 7 AS usefulness, CASE WHEN (length(query_text) + length(comment_text)) % 7 = 0 THEN 2 ELSE 1 END AS calls FROM x WHERE query_text IS NOT NULL AND comment_text IS NOT NULL"


@query("l1_injected_judge", sql("SELECT relevance, count(*) AS n, CAST(sum(calls) AS BIGINT) AS calls FROM j GROUP BY 1", "pool", "texts", "notes", x=_PAIRTEXT, j=_JUDGED))
def l1(spark: SparkSession, d: str) -> DataFrame:
    """A judge as a function over batches: any service fits behind it; here one that needs no network."""
    rows = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL")
    out = rows.mapInPandas(stub_judge, "query_id string, comment_id string, query_text string, comment_text string, answer string, calls long")
    p = ut.parse_judgment(F.col("answer"), ["label_relevance", "label_usefulness"])
    return out.groupBy(p["label_relevance"].cast("bigint").alias("relevance")).agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"))


@query("l6_judged_payloads", sql("SELECT query_id, comment_id, CAST(relevance AS BIGINT) AS relevance, CAST(usefulness AS BIGINT) AS usefulness, sha256(query_text || chr(31) || comment_text) AS payload FROM j JOIN x USING (query_id, comment_id)", "pool", "texts", "notes", x=_PAIRTEXT, j=_JUDGED))
def l6(spark: SparkSession, d: str) -> DataFrame:
    """Payloads judged, answers parsed and cut to the scale, with the digest of what the judge saw."""
    rows = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL")
    out = rows.mapInPandas(stub_judge, "query_id string, comment_id string, query_text string, comment_text string, answer string, calls long")
    p = ut.parse_judgment(F.col("answer"), ["label_relevance", "label_usefulness"])
    score = lambda n: ut.clamp_score(p[n]).cast("bigint")
    return out.select(*PAIR, score("label_relevance").alias("relevance"), score("label_usefulness").alias("usefulness"), F.sha2(F.concat("query_text", F.lit("\x1f"), "comment_text"), 256).alias("payload"))


@query("l7_provider_payloads", sql("SELECT query_id, comment_id, length(query_text) + length(comment_text) AS chars, 2 AS fields FROM x WHERE query_text IS NOT NULL AND comment_text IS NOT NULL", "pool", "texts", "notes", x=_PAIRTEXT))
def l7(spark: SparkSession, d: str) -> DataFrame:
    """What a provider is sent: the two texts and nothing else."""
    p = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL").select(*PAIR, F.struct(F.col("query_text").alias("query"), F.col("comment_text").alias("snippet")).alias("payload"))
    width = len(p.schema["payload"].dataType.fields)
    return p.select(*PAIR, (F.length("payload.query") + F.length("payload.snippet")).cast("bigint").alias("chars"), F.lit(width).cast("bigint").alias("fields"))


_COST = "SELECT part, count(*) AS items, CAST(sum((chars + 1600) // 4) AS BIGINT) AS input_tokens, count(*) * 120 AS output_tokens, round(sum((chars + 1600) // 4) / 1000.0 * 0.5 + count(*) * 0.12 * 1.5, 4) AS cost FROM (SELECT unnest(['all', CASE WHEN j THEN 'anchor' ELSE 'residual' END]) AS part, chars FROM (SELECT (query_id, comment_id) IN (SELECT (query_id, comment_id) FROM judged) AS j, length(query_text) + length(comment_text) AS chars FROM x WHERE query_text IS NOT NULL AND comment_text IS NOT NULL)) GROUP BY 1"


@query("l9_cost_estimate", sql(_COST, "pool", "texts", "notes", "judged", x=_PAIRTEXT))
def l9(spark: SparkSession, d: str) -> DataFrame:
    """What judging would cost at stated prices, for anchors, the rest and all."""
    held = t.judged(spark, d).select(*PAIR, F.lit(True).alias("j"))
    rows = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL").join(held, PAIR, "left")
    tokens = F.floor((F.length("query_text") + F.length("comment_text") + 1600) / 4)
    each = rows.select(F.explode(F.array(F.lit("all"), F.when(F.col("j"), "anchor").otherwise("residual"))).alias("part"), tokens.alias("tokens"))
    n, s = F.count(F.lit(1)), F.sum("tokens")
    return each.groupBy("part").agg(n.alias("items"), s.cast("bigint").alias("input_tokens"), (n * 120).alias("output_tokens"), F.round(s / 1000.0 * 0.5 + n * 0.12 * 1.5, 4).alias("cost"))


@query("l10_protocol_lock", sql("SELECT judge_model, judge_version, count(*) AS n, count(*) = max(count(*)) OVER () AS locked FROM qrels WHERE validation_status = 'ok' GROUP BY ALL"))
def l10(spark: SparkSession, d: str) -> DataFrame:
    """Judges and versions of a registry's rows, and which one most have: the protocol that later rows must keep."""
    rows = table(spark, d, "qrels").filter("validation_status = 'ok'").groupBy("judge_model", "judge_version").agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("n").alias("m")))).select("judge_model", "judge_version", "n", (F.col("n") == F.col("m")).alias("locked"))


@query("l12_reused_vectors", sql("SELECT count(*) AS texts, count(*) FILTER (h IN (SELECT sha256(" + _CANON.format(c="comment_text") + ") FROM notes JOIN pool USING (comment_id) WHERE comment_text IS NOT NULL)) AS reused FROM (SELECT DISTINCT sha256(" + _CANON.format(c="text") + ") AS h FROM (SELECT unnest(replies, recursive := true) FROM reply_references) WHERE text IS NOT NULL)", "pool", "notes"))
def l12(spark: SparkSession, d: str) -> DataFrame:
    """Of the replies' different texts those whose vectors an earlier run on the pool's comments has already."""
    prior = t.pool(spark, d).select("comment_id").distinct().join(t.comments(spark, d), "comment_id").filter("comment_text IS NOT NULL").select(tx.text_digest(F.col("comment_text")).alias("h")).distinct().withColumn("held", F.lit(1))
    r = table(spark, d, "reply_references").select(F.explode("replies").alias("r")).filter("r.text IS NOT NULL").select(tx.text_digest(F.col("r.text")).alias("h")).distinct()
    return r.join(prior, "h", "left").agg(F.count(F.lit(1)).alias("texts"), F.count("held").alias("reused"))


@query("l14_top_facts", sql("SELECT query_id, comment_id, CAST(place AS BIGINT) AS place FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(fact, 2) DESC, comment_id) AS place FROM g WHERE fact IS NOT NULL) WHERE place <= 5", *GRAPH, g=_GRAPH))
def l14(spark: SparkSession, d: str) -> DataFrame:
    """Five facts of each query by similarity; equal ones in the order they are stored in."""
    rows = graph_run(spark, d).filter("native['fact'] IS NOT NULL").withColumn("s", F.round(F.col("native")["fact"], 2))
    return ranking.top_k(rows, ["query_id"], [F.desc("s"), "comment_id"], 5, "place").select(*PAIR, *big("place"))


@query("l15_endpoint_trace", sql("SELECT md5('entity-' || lower(author)) AS entity, count(DISTINCT link_id) AS degree, round(sum(s) / count(DISTINCT link_id), 6) AS weight FROM (SELECT author, link_id, 1.0 AS s FROM comments WHERE author IS NOT NULL AND link_id IS NOT NULL) GROUP BY 1"))
def l15(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges by their digests, with their degree and the weight that it leaves each."""
    rows = table(spark, d, "comments").filter("author IS NOT NULL AND link_id IS NOT NULL").select(F.md5(F.concat(F.lit("entity-"), F.lower("author"))).alias("entity"), "link_id")
    return rows.groupBy("entity").agg(F.count_distinct("link_id").alias("degree"), F.count(F.lit(1)).alias("n")).select("entity", "degree", r6(F.col("n") / F.col("degree"), "weight"))


@query("l16_profiles", sql("SELECT profile, count(*) FILTER (w > 0) AS seeds, round(sum(w), 6) AS weight FROM (SELECT profile, coalesce(fact, 0) + CASE profile WHEN 'both' THEN coalesce(passage, 0) ELSE 0 END AS w FROM g, (SELECT unnest(['both', 'fact_only']) AS profile)) GROUP BY 1", *GRAPH, g=_GRAPH))
def l16(spark: SparkSession, d: str) -> DataFrame:
    """Restart weights under two profiles: facts and passages, or facts alone."""
    native = lambda c: F.coalesce(F.col("native")[c], F.lit(0.0))
    rows = graph_run(spark, d).withColumn("profile", F.explode(F.array(F.lit("both"), F.lit("fact_only")))).withColumn("w", native("fact") + F.when(F.col("profile") == "both", native("passage")).otherwise(0.0))
    return rows.groupBy("profile").agg(F.count_if(F.col("w") > 0).alias("seeds"), r6(F.sum("w"), "weight"))


@query("m3_judging_stream", sql("SELECT count(*) AS rows, count(DISTINCT (query_id, comment_id)) AS pairs, CAST(sum(length(comment_id)) AS BIGINT) AS chars FROM (SELECT DISTINCT query_id, comment_id FROM candidate_features)"))
def m3(spark: SparkSession, d: str) -> DataFrame:
    """Requests that arrive as a stream, some of them twice and over two runs, are judged once each."""
    folder = shared_folder(spark, "stream")
    rows = table(spark, d, "candidate_features").select(*PAIR)
    rows.repartition(4).write.parquet(f"{folder}/in")
    judge = lambda df: df.withColumn("utility", F.length("comment_id"))
    run = lambda: judging.append_new(judging.replay(spark, f"{folder}/in", 2), f"{folder}/out", f"{folder}/checkpoint", PAIR, judge).awaitTermination()
    run()
    rows.limit(50).write.mode("append").parquet(f"{folder}/in")
    run()
    done = spark.read.parquet(f"{folder}/out")
    return done.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*PAIR)).alias("pairs"), F.sum("utility").alias("chars"))


# reports


@query("n1_markdown_lines", sql("SELECT '| ' || scenario || ' | ' || n || ' | ' || printf('%.4f', share) || ' |' AS line FROM (SELECT coalesce(scenario, 'UNKNOWN') AS scenario, count(*) AS n, count(*) FILTER (tier = 'deep') / CAST(count(*) AS DOUBLE) AS share FROM texts GROUP BY 1) UNION ALL SELECT '| scenario | n | share |' UNION ALL SELECT '| --- | --- | --- |'", "texts"))
def n1(spark: SparkSession, d: str) -> DataFrame:
    """A table as lines of markdown."""
    per = t.texts(spark, d).groupBy(F.coalesce("scenario", F.lit("UNKNOWN")).alias("scenario")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("tier") == "deep") / F.count(F.lit(1))).alias("share"))
    return values(spark, "line string", *[(x,) for x in io.markdown_table(per).split("\n")])


@query("n2_markdown_report", sql("SELECT '| ' || route || ' | ' || queries || ' |' AS line FROM (SELECT route, count(DISTINCT query_id) AS queries FROM run GROUP BY 1) UNION ALL SELECT '| route | queries |' UNION ALL SELECT '| --- | --- |'", "run"))
def n2(spark: SparkSession, d: str) -> DataFrame:
    per = t.run(spark, d).groupBy("route").agg(F.count_distinct("query_id").alias("queries"))
    return values(spark, "line string", *[(x,) for x in io.markdown_table(per).split("\n")])


@query("n4_pool_curves", sql("SELECT route, CAST(depth AS BIGINT) AS depth, round(avg(v), 6) AS oracle, count(*) AS queries FROM (SELECT route, depth, query_id, avg(score) AS v FROM (SELECT route, depth, query_id, score, row_number() OVER (PARTITION BY route, depth, query_id ORDER BY score DESC, comment_id) AS p FROM (SELECT r.route, r.query_id, r.comment_id, r.rank, u.score FROM routes r JOIN u USING (query_id, comment_id)), (SELECT unnest([8, 12, 20, 30, 50]) AS depth) WHERE rank <= depth) WHERE p <= 8 GROUP BY ALL) GROUP BY ALL", "routes", "judged", u=_U))
def n4(spark: SparkSession, d: str) -> DataFrame:
    """The data of curves: the best eight of each route's pool by its depth."""
    _, run, u = oracle_inputs(spark, d)
    rows = run.select("route", *PAIR, "rank").join(u, PAIR).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in (8, 12, 20, 30, 50)]))).filter("rank <= depth")
    best = ranking.top_k(rows, ["route", "depth", "query_id"], [F.desc("score"), "comment_id"], 8, "p").groupBy("route", "depth", "query_id").agg(F.avg("score").alias("v"))
    return best.groupBy("route", F.col("depth").cast("bigint").alias("depth")).agg(r6(F.avg("v"), "oracle"), F.count(F.lit(1)).alias("queries"))


# composed studies


_PROTO = "SELECT vec_id, arg_max(label, s) AS proto FROM (SELECT u.vec_id, m.label, round(list_dot_product(u.v, m.c), 9) - m.label * 1e-12 AS s FROM u, (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL) GROUP BY 1) m WHERE u.vec_id % 50 = 0) GROUP BY 1"
_KNN = "SELECT vec_id, label AS near FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, min(p)) AS n FROM (SELECT q.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS p FROM u q, u c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE p <= 7 GROUP BY vec_id, label) WHERE n = 1"


@query("o1_classified", sql(f"SELECT CASE WHEN proto = near THEN 'high' ELSE 'low' END AS confidence, count(*) AS n FROM ({_PROTO}) JOIN ({_KNN}) USING (vec_id) GROUP BY 1", u=_UNIT))
def o1(spark: SparkSession, d: str) -> DataFrame:
    """Stated vectors classified by the nearest class mean and by their neighbours' votes; where both agree, confidence is high."""
    u = unit_vectors(spark, d)
    asked = u.filter("vec_id % 50 = 0")
    means = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    scored = asked.select("vec_id", "v").crossJoin(F.broadcast(means)).select("vec_id", "label", (F.round(vectors.dot(F.col("v"), F.col("c")), 9) - F.col("label") * 1e-12).alias("s"))  # one row per class
    proto = scored.groupBy("vec_id").agg(F.max_by("label", "s").alias("proto"))
    near = ranking.dense_top_k(u.select(F.col("vec_id").alias("comment_id"), F.col("v").alias("vec")), asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("vec")), 8).filter("query_id <> comment_id").drop("rank")
    seven = ranking.top_k(near, ["query_id"], [F.desc("score"), "comment_id"], 7).join(u.select(F.col("vec_id").alias("comment_id"), "label"), "comment_id")
    votes = seven.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("p"))
    knn = ranking.top_k(votes, ["query_id"], [F.desc("c"), "p"], 1, "n").select(F.col("query_id").alias("vec_id"), F.col("label").alias("near"))
    return proto.join(knn, "vec_id").groupBy(F.when(F.col("proto") == F.col("near"), "high").otherwise("low").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("o2_candidates", sql("SELECT post_id, length(selftext) AS chars FROM posts WHERE trim(coalesce(selftext, '')) NOT IN ('', '[deleted]', '[removed]') AND post_id NOT IN (SELECT lower(trim(regexp_replace(post_id, '(?i)^t[13]_', ''))) FROM texts WHERE post_id IS NOT NULL)", "posts", "texts"))
def o2(spark: SparkSession, d: str) -> DataFrame:
    """Posts with text that no query was taken from."""
    used = own_links(spark, d).filter("link_id IS NOT NULL").select(tx.bare_id(F.col("link_id")).alias("post_id")).distinct()
    rows = t.posts(spark, d).filter(~F.trim(F.coalesce("selftext", F.lit(""))).isin(tx.TOMBSTONES))
    return rows.join(used, "post_id", "left_anti").select("post_id", F.length("selftext").cast("bigint").alias("chars"))


_SPLIT = f"SELECT query_id, tier, CASE WHEN place <= 60 THEN 'validation' WHEN place <= 120 THEN 'test' ELSE 'reserve' END AS split FROM (SELECT query_id, tier, row_number() OVER (ORDER BY turn, tier) AS place FROM (SELECT query_id, coalesce(tier, 'UNKNOWN') AS tier, row_number() OVER (PARTITION BY coalesce(tier, 'UNKNOWN') ORDER BY {_MD5.format(x='query_id')}, query_id) AS turn FROM texts WHERE use_bucket = 'query_candidate'))"


def mixed_split(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, tier, split): candidates in turns over the tiers, the first sixty, the next sixty, and the rest."""
    rows = t.texts(spark, d).filter("use_bucket = 'query_candidate'").select("query_id", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier")).withColumn("o", sampling.seeded("query_id", 7))
    turns = ranking.ranked_split(rows, ["tier"], ["o", "query_id"], "turn").withColumn("all", F.lit(1))
    placed = ranking.ranked_split(turns, ["all"], ["turn", "tier"], "place")
    return placed.select("query_id", "tier", F.when(F.col("place") <= 60, "validation").when(F.col("place") <= 120, "test").otherwise("reserve").alias("split"))


@query("o4_mixed_splits", sql("SELECT * FROM s", "texts", s=_SPLIT))
def o4(spark: SparkSession, d: str) -> DataFrame:
    return mixed_split(spark, d)


@query("o5_written_splits", sql("SELECT split, count(*) AS n, 'split,query_id,tier' AS header FROM s GROUP BY 1", "texts", s=_SPLIT))
def o5(spark: SparkSession, d: str) -> DataFrame:
    """Splits as CSV with fixed fields, one folder each, and back."""
    rows, folder, out = cut(mixed_split(spark, d)), shared_folder(spark, "splits"), None
    for name in ("validation", "test", "reserve"):
        io.write_csv(rows.filter(F.col("split") == name), f"{folder}/{name}", ["split", "query_id", "tier"])
        back = io.read_csv(spark, f"{folder}/{name}", line_ends=False)
        part = back.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("header", F.lit(",".join(back.columns)))
        out = part if out is None else out.unionByName(part)
    return out


@query("o6_excluded_ids", sql("SELECT id, count(*) AS lists FROM (SELECT DISTINCT 'judged' AS list, query_id AS id FROM qrels WHERE query_id IS NOT NULL UNION ALL SELECT DISTINCT 'run', query_id FROM retrieval_runs WHERE query_id IS NOT NULL UNION ALL SELECT DISTINCT 'pool', query_id FROM candidate_features WHERE query_id IS NOT NULL) GROUP BY 1"))
def o6(spark: SparkSession, d: str) -> DataFrame:
    """Ids that any of several lists excludes."""
    lists = {"judged": "qrels", "run": "retrieval_runs", "pool": "candidate_features"}
    return union({k: io.read_ids(table(spark, d, v).select("query_id")) for k, v in lists.items()}, "list", ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("lists"))


@query("o7_excluded_from_csv", sql("SELECT DISTINCT comment_id AS id FROM candidate_features WHERE comment_id IS NOT NULL AND source_pool = 'graph4'"))
def o7(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "exclude")
    io.write_csv(table(spark, d, "candidate_features").filter("source_pool = 'graph4'"), folder, ["comment_id"])
    return io.read_ids(io.read_csv(spark, folder, line_ends=False), ("comment_id",))


@query("o8_excluded_from_lines", sql("SELECT DISTINCT post_id AS id FROM submissions WHERE trim(post_id) <> '' AND NOT is_self"))
def o8(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "exclude")
    io.write_jsonl(table(spark, d, "submissions").filter("NOT is_self").select("post_id"), folder)
    return io.read_ids(io.read_jsonl(spark, folder, "post_id string"), ("post_id",))


@query("o9_gold_lists", sql("SELECT query_id, count(*) AS golds FROM (SELECT DISTINCT query_id, trim(unnest(regexp_split_to_array(ids, '[,|]'))) AS id FROM (SELECT query_id, CASE WHEN substr(query_id, 1, 1) < 'i' THEN replace(ids, '|', ', ') ELSE ids END AS ids FROM (SELECT query_id, string_agg(comment_id, '|' ORDER BY comment_id) AS ids FROM gold GROUP BY query_id))) WHERE id <> '' GROUP BY 1", "gold"))
def o9(spark: SparkSession, d: str) -> DataFrame:
    """Gold sets from lists written with commas or bars."""
    g = F.array_sort(F.collect_list("comment_id"))
    stored = t.gold(spark, d).groupBy("query_id").agg(F.when(F.substring("query_id", 1, 1) < "i", F.concat_ws(", ", g)).otherwise(F.concat_ws("|", g)).alias("ids"))
    ids = F.array_distinct(F.filter(F.transform(F.split("ids", "[,|]"), lambda x: F.trim(x)), lambda x: x != ""))
    return stored.select("query_id", F.size(ids).cast("bigint").alias("golds"))


@query("o13_rebuilt_lineage", sql("SELECT split, count(*) AS n, count(*) AS same FROM s GROUP BY 1", "texts", s=_SPLIT))
def o13(spark: SparkSession, d: str) -> DataFrame:
    """Splits built twice, from rows in another order, and compared id by id."""
    a = mixed_split(spark, d)
    b = mixed_split(spark, d).select("query_id", F.col("split").alias("again"))
    return a.join(b, "query_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == F.col("again")).alias("same"))


@query("o17_compared_files", sql("SELECT 'q' AS name, true AS equal UNION ALL SELECT 'q_less', false"))
def o17(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt tables against canonical ones by the digests of their rows."""
    rows, folder = t.texts(spark, d).select("query_id", "tier"), shared_folder(spark, "rebuilt")
    for name, p in (("q", rows.repartition(3)), ("q_less", rows.filter("tier = 'deep'"))):
        p.write.parquet(f"{folder}/{name}")
    canonical = setops.set_digest(rows, rows.columns).first()["digest"]
    found = [(n, setops.set_digest(spark.read.parquet(f"{folder}/{n}"), rows.columns).first()["digest"] == canonical) for n in ("q", "q_less")]
    return values(spark, "name string, equal boolean", *found)


@query("o20_native_routes", sql("SELECT route, count(*) AS n, count(DISTINCT query_id) AS queries, count(*) FILTER (s > 0 AND isfinite(s)) AS sound FROM (SELECT query_id, unnest(['fact', 'passage']) AS route, unnest([fact, passage]) AS s FROM g) WHERE s IS NOT NULL GROUP BY 1", *GRAPH, g=_GRAPH))
def o20(spark: SparkSession, d: str) -> DataFrame:
    """Both native routes of the graph with a check of their scores."""
    rows = graph_run(spark, d).select("query_id", F.explode("native").alias("route", "s"))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"), F.count_if(guards.finite(F.col("s")) > 0).alias("sound"))


@query("o21_input_sizes", sql("SELECT 'corpus' AS name, count(*) AS n, count(*) FILTER (trim(coalesce(comment_text, '')) <> '') AS filled FROM notes UNION ALL SELECT 'queries', count(*), count(*) FILTER (trim(coalesce(query_text, '')) <> '') FROM texts", "notes", "texts"))
def o21(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the corpus and the queries, and how many have text."""
    size = lambda df, c, n: df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias("filled"))
    return size(t.comments(spark, d), "comment_text", "corpus").unionByName(size(t.texts(spark, d), "query_text", "queries"))


@query("o22_cached_keys", sql("SELECT substr(h, 1, 1) AS shard, count(*) AS n FROM (SELECT DISTINCT sha256(" + _CANON.format(c="comment_text") + ") AS h FROM notes WHERE comment_text IS NOT NULL) GROUP BY 1", "notes"))
def o22(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a cache of texts, by shard."""
    h = t.comments(spark, d).filter("comment_text IS NOT NULL").select(tx.text_digest(F.col("comment_text")).alias("h")).distinct()
    return h.groupBy(F.substring("h", 1, 1).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("o24_anchor_payloads", sql("SELECT query_id, comment_id, length(query_text) + length(comment_text) AS chars FROM x JOIN judged USING (query_id, comment_id) WHERE query_text IS NOT NULL AND comment_text IS NOT NULL AND utility IS NOT NULL AND validation_status = 'ok' ORDER BY " + _MD5.format(x="query_id || '/' || comment_id") + ", query_id, comment_id LIMIT 50", "pool", "texts", "notes", "judged", x=_PAIRTEXT))
def o24(spark: SparkSession, d: str) -> DataFrame:
    """Fifty judged pairs, by seeded order, with their payloads' sizes."""
    known = t.judged(spark, d).filter("utility IS NOT NULL AND validation_status = 'ok'").select(*PAIR)
    rows = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL").join(known, PAIR).withColumn("pair", F.concat_ws("/", *PAIR))
    return sampling.uniform(rows, "pair", 50).select(*PAIR, (F.length("query_text") + F.length("comment_text")).cast("bigint").alias("chars"))


_PRE = "SELECT CAST(depth AS BIGINT) AS depth, count(*) AS pairs, count(j) AS judged, CAST(coalesce(sum(CASE WHEN j IS NULL THEN (chars + 1600) // 4 END), 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT depth, query_id, comment_id FROM run, (SELECT unnest([8, 20, 50]) AS depth) WHERE rank <= depth) LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) LEFT JOIN (SELECT comment_id, length(comment_text) AS chars FROM notes) USING (comment_id) GROUP BY 1"


@query("o25_preflight", sql(_PRE, "run", "judged", "notes"))
def o25(spark: SparkSession, d: str) -> DataFrame:
    """Before a study of deeper pools: pairs, judged ones, and the tokens of judging the rest, by depth."""
    pairs = t.run(spark, d).withColumn("depth", F.explode(F.array(F.lit(8), F.lit(20), F.lit(50)))).filter("rank <= depth").select("depth", *PAIR).distinct()
    rows = pairs.join(t.judged(spark, d).select(*PAIR, F.lit(1).alias("j")), PAIR, "left").join(t.comments(spark, d).select("comment_id", F.length("comment_text").alias("chars")), "comment_id", "left")
    tokens = F.coalesce(F.sum(F.when(F.col("j").isNull(), F.floor((F.col("chars") + 1600) / 4))), F.lit(0))
    return rows.groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("pairs"), F.count("j").alias("judged"), tokens.cast("bigint").alias("tokens"))


@query("o33_study_inputs", sql("SELECT (SELECT count(DISTINCT query_id) FROM run) AS run_queries, (SELECT count(*) FROM judged) AS judged, (SELECT count(*) FROM pool) AS pool, (SELECT count(*) FROM pool WHERE comment_id NOT IN (SELECT comment_id FROM notes)) AS without_comment, (SELECT count(*) FROM pool WHERE query_id NOT IN (SELECT query_id FROM texts)) AS without_query", "run", "judged", "pool", "notes", "texts"))
def o33(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a study and whether their ids meet."""
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    pool = t.pool(spark, d)
    out = n(t.run(spark, d).select("query_id").distinct(), "run_queries")
    for part in (n(t.judged(spark, d), "judged"), n(pool, "pool"), n(pool.join(t.comments(spark, d).select("comment_id"), "comment_id", "left_anti"), "without_comment"), n(pool.join(t.texts(spark, d).select("query_id"), "query_id", "left_anti"), "without_query")):
        out = out.crossJoin(part)  # one row each
    return out


@query("o36_blind_rows", sql("SELECT md5(query_id || '/' || comment_id) AS blind_id, contains(r, '[') AND (contains(r, '[EMAIL]') OR contains(r, '[URL]')) AS redacted, length(r) AS chars FROM (SELECT query_id, comment_id, regexp_replace(regexp_replace(comment_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), 'https?://[^\\s)\\]>]+', '[URL]', 'g') AS r FROM x WHERE comment_text IS NOT NULL AND NOT regexp_matches(comment_text, '(?i)(^|[^\\w/])/?[ur]/|\\d.{0,3}\\d.{0,3}\\d.{0,3}\\d'))", "pool", "texts", "notes", x=_PAIRTEXT))
def o36(spark: SparkSession, d: str) -> DataFrame:
    """Payload rows under ids that tell nothing, addresses and links replaced, of texts without names and long numbers."""
    rows = pair_texts(spark, d).filter("comment_text IS NOT NULL").filter(~F.col("comment_text").rlike(r"(?i)(^|[^\w/])/?[ur]/|\d.{0,3}\d.{0,3}\d.{0,3}\d")).withColumn("r", tx.redacted(F.col("comment_text")))
    return rows.select(F.md5(F.concat_ws("/", *PAIR)).alias("blind_id"), (F.contains("r", F.lit("[EMAIL]")) | F.contains("r", F.lit("[URL]"))).alias("redacted"), F.length("r").cast("bigint").alias("chars"))


@query("o38_judged_again", sql("SELECT count(*) AS pairs, round(avg(abs(a - b)), 6) AS mean_gap, count(*) FILTER (abs(a - b) <= 0.5) AS stable FROM (SELECT query_id, comment_id, arg_min(utility, judged_at) AS a, arg_max(utility, judged_at) AS b FROM qrels WHERE utility IS NOT NULL AND judged_at IS NOT NULL GROUP BY ALL HAVING count(DISTINCT judged_at) > 1)"))
def o38(spark: SparkSession, d: str) -> DataFrame:
    """How much pairs that were judged more than once changed from the first to the last time."""
    rows = table(spark, d, "qrels").filter("utility IS NOT NULL AND judged_at IS NOT NULL").groupBy(*PAIR).agg(F.min_by("utility", "judged_at").alias("a"), F.max_by("utility", "judged_at").alias("b"), F.count_distinct("judged_at").alias("n")).filter("n > 1")
    gap = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg(gap), "mean_gap"), F.count_if(gap <= 0.5).alias("stable"))


_O42 = "SELECT system, count(*) AS queries, count(utility) AS complete, round(avg(utility), 6) AS utility, CAST(sum(8 - judged) AS BIGINT) AS missing FROM m0 GROUP BY 1"


@query("o42_fixed_study", sql(_O42, "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def o42(spark: SparkSession, d: str) -> DataFrame:
    """Every fixed system with its completeness, utility and what is left to judge."""
    return system_rows(spark, d).groupBy("system").agg(F.count(F.lit(1)).alias("queries"), F.count("utility").alias("complete"), r6(F.avg("utility"), "utility"), F.sum(8 - F.col("judged")).alias("missing"))


@query("o40_merged_study", sql("SELECT b.system, round(avg(b.v - a.v), 6) AS gain, count(*) AS queries FROM (SELECT system, query_id, avg(coalesce(utility, 4.0)) AS v FROM s LEFT JOIN judged USING (query_id, comment_id) GROUP BY ALL) b JOIN (SELECT query_id, avg(coalesce(utility, 4.0)) AS v FROM s LEFT JOIN judged USING (query_id, comment_id) WHERE system = 'dense' GROUP BY 1) a USING (query_id) WHERE b.system <> 'dense' GROUP BY 1", "routes", "judged", two=_TWO, s=_SYSTEMS))
def o40(spark: SparkSession, d: str) -> DataFrame:
    """Every system against the dense list once the missing judgments are filled in, here with the middle of the scale."""
    rows = fixed_systems(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left").groupBy("system", "query_id").agg(F.avg(F.coalesce("utility", F.lit(4.0))).alias("v"))
    rows = cut(rows)
    base = rows.filter("system = 'dense'").select("query_id", F.col("v").alias("a"))
    return rows.filter("system <> 'dense'").join(base, "query_id").groupBy("system").agg(r6(F.avg(F.col("v") - F.col("a")), "gain"), F.count(F.lit(1)).alias("queries"))


@query("o43_query_needs", sql("SELECT query_id, array_to_string(list_filter([scenario, tier, post_role], lambda x: x IS NOT NULL AND x <> ''), '; ') AS needs FROM texts", "texts"))
def o43(spark: SparkSession, d: str) -> DataFrame:
    return t.texts(spark, d).select("query_id", F.concat_ws("; ", F.filter(F.array("scenario", "tier", "post_role"), lambda x: x != "")).alias("needs"))


@query("o45_centred_ranks", sql("SELECT query_id, comment_id, round(r - avg(r) OVER (PARTITION BY query_id), 6) AS x FROM (SELECT query_id, comment_id, rank() OVER (PARTITION BY query_id ORDER BY utility) + (count(*) OVER (PARTITION BY query_id, utility) - 1) / 2.0 AS r FROM l)", "pool", "judged", l=_L))
def o45(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks less their mean."""
    r = labelled(spark, d).withColumn("r", ranking.average_rank(F.col("utility"), ["query_id"]))
    return r.select(*PAIR, r6(learn.centred("r"), "x"))


@query("o46_centred_values", sql("SELECT query_id, comment_id, round(utility - avg(utility) OVER (PARTITION BY query_id), 6) AS x FROM l", "pool", "judged", l=_L))
def o46(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select(*PAIR, r6(learn.centred("utility"), "x"))


@query("o47_texts_to_encode", sql("SELECT source, count(*) AS n FROM (SELECT 'reply' AS source, sha256(" + _CANON.format(c="text") + ") AS h FROM (SELECT unnest(replies, recursive := true) FROM reply_references) WHERE text IS NOT NULL UNION SELECT 'candidate', sha256(" + _CANON.format(c="comment_text") + ") FROM notes JOIN pool USING (comment_id) WHERE comment_text IS NOT NULL) GROUP BY 1", "notes", "pool"))
def o47(spark: SparkSession, d: str) -> DataFrame:
    """Different texts of replies and of candidates that a study needs vectors of."""
    r = table(spark, d, "reply_references").select(F.explode("replies").alias("r")).filter("r.text IS NOT NULL").select(tx.text_digest(F.col("r.text")).alias("h"))
    c = t.pool(spark, d).select("comment_id").distinct().join(t.comments(spark, d), "comment_id").filter("comment_text IS NOT NULL").select(tx.text_digest(F.col("comment_text")).alias("h"))
    return union({"reply": r.distinct(), "candidate": c.distinct()}, "source", ["h"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("o48_reply_audit", sql(f"SELECT count(*) AS replies, count(*) FILTER (trim(text) IN ('', '[deleted]', '[removed]')) AS tombstones, count(*) FILTER (regexp_matches(text, '^\\s*https?://\\S+\\s*$')) AS links, count(*) FILTER (sha256({_CANON.format(c='text')}) IN (SELECT sha256({_CANON.format(c='comment_text')}) FROM notes WHERE comment_text IS NOT NULL)) AS in_corpus FROM (SELECT DISTINCT query_id, reply_id, text FROM (SELECT query_id, unnest(replies, recursive := true) FROM reply_references)) WHERE text IS NOT NULL", "notes"))
def o48(spark: SparkSession, d: str) -> DataFrame:
    """Reference replies by what is wrong with them, and those whose text the corpus holds."""
    r = table(spark, d, "reply_references").select("query_id", F.explode("replies").alias("r")).select("query_id", "r.reply_id", "r.text").filter("text IS NOT NULL").distinct().withColumn("h", tx.text_digest(F.col("text")))
    counts = r.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    held = t.comments(spark, d).filter("comment_text IS NOT NULL").select(tx.text_digest(F.col("comment_text")).alias("h")).distinct().withColumn("held", F.lit(1))
    rows = lookup_skewed(r, counts.join(held, "h", "left"), "h", "n")
    return rows.agg(F.count(F.lit(1)).alias("replies"), F.count_if(F.trim("text").isin(tx.TOMBSTONES)).alias("tombstones"), F.count_if(F.col("text").rlike(tx.LINK_ONLY)).alias("links"), F.count("held").alias("in_corpus"))


@query("o51_loaded_systems", sql("SELECT system, count(*) AS lists, count(*) FILTER (n = 8 AND k = 8) AS sound FROM (SELECT system, query_id, count(DISTINCT comment_id) AS n, count(DISTINCT c) AS k FROM s LEFT JOIN (SELECT comment_id, comment_id AS c FROM notes) USING (comment_id) GROUP BY ALL) GROUP BY 1", "routes", "notes", two=_TWO, s=_SYSTEMS))
def o51(spark: SparkSession, d: str) -> DataFrame:
    """Lists of each system that are eight different items of the corpus."""
    held = t.comments(spark, d).select("comment_id", F.col("comment_id").alias("c"))
    per = fixed_systems(spark, d).join(held, "comment_id", "left").groupBy("system", "query_id").agg(F.count_distinct("comment_id").alias("n"), F.count_distinct("c").alias("k"))
    return per.groupBy("system").agg(F.count(F.lit(1)).alias("lists"), F.count_if((F.col("n") == 8) & (F.col("k") == 8)).alias("sound"))


@query("o52_wanted_rows", sql("SELECT system, query_id, comment_id, rank FROM s WHERE system IN ('dense', 'rrf_0.3') AND query_id IN (SELECT query_id FROM texts WHERE tier = 'deep')", "routes", "texts", two=_TWO, s=_SYSTEMS))
def o52(spark: SparkSession, d: str) -> DataFrame:
    cohort = t.texts(spark, d).filter("tier = 'deep'").select("query_id")
    return fixed_systems(spark, d).filter(F.col("system").isin("dense", "rrf_0.3")).join(cohort, "query_id", "left_semi").select("system", *PAIR, "rank")


@query("o55_system_contrast", sql("SELECT count(*) AS n, round(avg(a.utility - b.utility), 6) AS mean, round(avg(a.ndcg - b.ndcg), 6) AS ndcg FROM m0 a JOIN m0 b USING (query_id) WHERE a.system = 'rrf_0.5' AND b.system = 'tail_2' AND a.utility IS NOT NULL AND b.utility IS NOT NULL", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def o55(spark: SparkSession, d: str) -> DataFrame:
    """Two systems by utility and gain, over the queries for which both are complete."""
    rows = system_rows(spark, d).filter("utility IS NOT NULL")
    side = lambda s, n: rows.filter(F.col("system") == s).select("query_id", F.col("utility").alias(f"u{n}"), F.col("ndcg").alias(f"g{n}"))
    return side("rrf_0.5", 1).join(side("tail_2", 2), "query_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("u1") - F.col("u2")), "mean"), r6(F.avg(F.col("g1") - F.col("g2")), "ndcg"))


@query("o57_other_posts_preflight", sql("SELECT route, count(*) AS pairs, count(j) AS judged, count(*) FILTER (rank > 8) AS moved_up FROM l LEFT JOIN (SELECT query_id, comment_id, 1 AS j FROM judged) USING (query_id, comment_id) WHERE lopo <= 8 GROUP BY 1", "run", "notes", "texts", "judged", l=_LOPO))
def o57(spark: SparkSession, d: str) -> DataFrame:
    """The heads without the queries' own posts: judged pairs, and those that moved up into them."""
    rows = lopo_run(spark, d).filter("lopo <= 8").join(t.judged(spark, d).select(*PAIR, F.lit(1).alias("j")), PAIR, "left")
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("pairs"), F.count("j").alias("judged"), F.count_if(F.col("rank") > 8).alias("moved_up"))


@query("o62_held_out_analysis", sql("SELECT key, n, mean, low, high FROM (" + bootstrapped("c", "query_id", "delta", "key", 1000) + ")", "routes", "judged", base=_BASE, u=_U, c=f"SELECT 'budget ' || b AS key, query_id, v - w AS delta FROM (SELECT 1 AS b, query_id, avg(u.score) AS v FROM ({budget_sql(_DEPTH.format(n=30), 1, 'lex')}) z JOIN u USING (query_id, comment_id) GROUP BY ALL UNION ALL SELECT 4, query_id, avg(u.score) FROM ({budget_sql(_DEPTH.format(n=30), 4, 'lex')}) z JOIN u USING (query_id, comment_id) GROUP BY ALL) JOIN (SELECT query_id, avg(score) AS w FROM base JOIN u USING (query_id, comment_id) GROUP BY 1) USING (query_id)").replace(", c AS (", ", lex AS (SELECT query_id, comment_id, score FROM routes WHERE route = 'lexical'), c AS (", 1))
def o62(spark: SparkSession, d: str) -> DataFrame:
    """What letting a model replace one or four items changes, with intervals."""
    base, run, u = oracle_inputs(spark, d)
    lexical = run.filter("route = 'lexical'").select(*PAIR, "score")
    old, out = mean_known(base, u).withColumnRenamed("value", "old"), None
    for b in (1, 4):
        chosen = selection.budgeted_set(base, run.filter("route = 'sbert' AND rank <= 30"), lexical, b)
        part = mean_known(chosen, u).join(old, "query_id").select(F.lit(f"budget {b}").alias("key"), "query_id", (F.col("value") - F.col("old")).alias("delta"))
        out = part if out is None else out.unionByName(part)
    return stats.bootstrap_mean(out, "query_id", "delta", ["key"], 1000).select("key", "n", *[r6(c, c) for c in ("mean", "low", "high")])


@query("o70_drift_summary", sql("SELECT drift, count(*) AS queries, round(avg(best), 6) AS mean_best, count(*) FILTER (best > 0) AS rescued FROM (SELECT drift, query_id, greatest(max(reward), 0) AS best FROM (SELECT CASE WHEN label_safety <= 2 THEN 'safety' WHEN label_relevance <= 3 THEN 'semantic_context' ELSE 'support_quality' END AS drift, query_id, comment_id AS replaced FROM judged WHERE label_safety <= 2 OR label_relevance <= 3 OR label_usefulness <= 3) JOIN a USING (query_id, replaced) WHERE reward IS NOT NULL GROUP BY ALL) GROUP BY 1", "routes", "judged", a=_ACTIONS))
def o70(spark: SparkSession, d: str) -> DataFrame:
    """What the best swap does for items that miss, by how they miss."""
    j = t.judged(spark, d).filter("label_safety <= 2 OR label_relevance <= 3 OR label_usefulness <= 3")
    kind = F.when(F.col("label_safety") <= 2, "safety").when(F.col("label_relevance") <= 3, "semantic_context").otherwise("support_quality")
    rows = actions(spark, d).filter("reward IS NOT NULL").join(j.select("query_id", F.col("comment_id").alias("replaced_id"), kind.alias("drift")), ["query_id", "replaced_id"])
    per = rows.groupBy("drift", "query_id").agg(F.greatest(F.max("reward"), F.lit(0.0)).alias("best"))
    return per.groupBy("drift").agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("best"), "mean_best"), F.count_if(F.col("best") > 0).alias("rescued"))


@query("o73_pool_inventory", sql("SELECT a.source_pool AS pool, b.source_pool AS other, count(*) AS shared FROM (SELECT DISTINCT source_pool, query_id, comment_id FROM candidate_features WHERE source_pool IS NOT NULL) a JOIN (SELECT DISTINCT source_pool, query_id, comment_id FROM candidate_features WHERE source_pool IS NOT NULL) b USING (query_id, comment_id) GROUP BY ALL"))
def o73(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the pools and their overlaps; a pair is in few pools, so their pairs of pools are few."""
    rows = table(spark, d, "candidate_features").filter("source_pool IS NOT NULL").groupBy(*PAIR).agg(F.collect_set("source_pool").alias("s"))
    each = rows.select(F.explode("s").alias("pool"), "s").select("pool", F.explode("s").alias("other"))
    return each.groupBy("pool", "other").agg(F.count(F.lit(1)).alias("shared"))


@query("o74_wide_rows", sql("SELECT query_id, round(max(utility) FILTER (system = 'dense'), 6) AS dense, round(max(utility) FILTER (system = 'rrf_0.3'), 6) AS fused, round(max(utility) FILTER (system = 'tail_2'), 6) AS tail FROM m0 GROUP BY 1", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def o74(spark: SparkSession, d: str) -> DataFrame:
    """Systems side by side for each query."""
    return system_rows(spark, d).groupBy("query_id").agg(*[r6(F.max(F.when(F.col("system") == s, F.col("utility"))), n) for s, n in (("dense", "dense"), ("rrf_0.3", "fused"), ("tail_2", "tail"))])


@query("o75_verdicts", sql("SELECT system, CASE WHEN complete < 3 THEN 'too few' WHEN utility >= (SELECT utility FROM v WHERE system = 'dense') + 0.02 THEN 'better' WHEN utility <= (SELECT utility FROM v WHERE system = 'dense') - 0.02 THEN 'worse' ELSE 'even' END AS verdict FROM v", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS, v=_O42))
def o75(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order over the systems' means."""
    rows = o42(spark, d)
    base = rows.filter("system = 'dense'").select(F.col("utility").alias("b"))
    return rows.crossJoin(base).select("system", F.when(F.col("complete") < 3, "too few").when(F.col("utility") >= F.col("b") + 0.02, "better").when(F.col("utility") <= F.col("b") - 0.02, "worse").otherwise("even").alias("verdict"))  # one base row


@query("o76_dimensions", sql("SELECT query_id, comment_id, {'relevance': label_relevance, 'usefulness': label_usefulness, 'safety': label_safety}::VARCHAR IS NOT NULL AS held, label_relevance + label_usefulness + label_safety AS total FROM judged", "judged"))
def o76(spark: SparkSession, d: str) -> DataFrame:
    """Labels as one nested value, and what comes out of it."""
    dims = F.struct(F.col("label_relevance").alias("relevance"), F.col("label_usefulness").alias("usefulness"), F.col("label_safety").alias("safety"))
    return t.judged(spark, d).select(*PAIR, dims.alias("x")).select(*PAIR, F.col("x").isNotNull().alias("held"), (F.col("x.relevance") + F.col("x.usefulness") + F.col("x.safety")).cast("bigint").alias("total"))


@query("o80_frontier", sql("SELECT CAST(depth AS BIGINT) AS depth, count(*) AS pairs, round(avg(utility), 6) AS mean, round(quantile_cont(utility, 0.5), 6) AS median, round(avg(CASE WHEN utility >= 4.5 THEN 1.0 ELSE 0.0 END), 6) AS useful, round(avg(CASE WHEN label_safety <= 2 THEN 1.0 ELSE 0.0 END), 6) AS unsafe FROM routes JOIN judged USING (query_id, comment_id), (SELECT unnest([8, 12, 20, 30, 50]) AS depth) WHERE route = 'sbert' AND rank <= depth AND utility IS NOT NULL GROUP BY 1", "routes", "judged"))
def o80(spark: SparkSession, d: str) -> DataFrame:
    """What a deeper pool holds: means, medians, shares of useful and of unsafe items."""
    rows = t.routes(spark, d).filter("route = 'sbert'").join(t.judged(spark, d).filter("utility IS NOT NULL"), PAIR).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in (8, 12, 20, 30, 50)]))).filter("rank <= depth")
    return rows.groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("utility"), "mean"), r6(F.percentile("utility", 0.5), "median"), r6(F.avg((F.col("utility") >= 4.5).cast("double")), "useful"), r6(F.avg(F.when(F.col("label_safety") <= 2, 1.0).otherwise(0.0)), "unsafe"))


@query("o82_absorption", sql("SELECT CAST(depth AS BIGINT) AS depth, count(*) AS graph_pairs, count(r) AS absorbed FROM (SELECT query_id, comment_id, depth FROM pool, (SELECT unnest([8, 20, 30, 50]) AS depth) WHERE source_pool = 'graph4') p LEFT JOIN (SELECT query_id, comment_id, rank AS r FROM routes WHERE route = 'sbert') x ON p.query_id = x.query_id AND p.comment_id = x.comment_id AND r <= depth GROUP BY 1", "routes"))
def o82(spark: SparkSession, d: str) -> DataFrame:
    """How many of the graph's candidates a deeper dense list has anyway."""
    run = t.routes(spark, d).filter("route = 'sbert'").select(*PAIR, "rank")
    rows = t.pool(spark, d).filter("source_pool = 'graph4'").select(*PAIR).join(run, PAIR, "left").withColumn("depth", F.explode(F.array(*[F.lit(x) for x in (8, 20, 30, 50)])))
    return rows.groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("graph_pairs"), F.count_if(F.col("rank") <= F.col("depth")).alias("absorbed"))


@query("o92_rows_in_plan", sql("SELECT CAST(place AS BIGINT) AS place, query_id, round(utility, 6) AS utility FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) AS place FROM (SELECT DISTINCT query_id FROM qrels WHERE query_id IS NOT NULL)) LEFT JOIN (SELECT query_id, utility FROM m0 WHERE system = 'dense') USING (query_id)", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS))
def o92(spark: SparkSession, d: str) -> DataFrame:
    """A system's values in the order of a plan of queries; queries without one stay, with null."""
    plan = ranking.ranked_split(table(spark, d, "qrels").filter("query_id IS NOT NULL").select("query_id").distinct().withColumn("all", F.lit(1)), ["all"], ["query_id"], "place")
    return plan.join(system_rows(spark, d).filter("system = 'dense'").select("query_id", "utility"), "query_id", "left").select(*big("place"), "query_id", r6("utility", "utility"))


@query("o98_outcome_flags", sql("SELECT count(*) FILTER (utility > b) AS better, count(*) FILTER (utility < b) AS worse, bool_or(utility > b + 0.05) AS any_gain, bool_and(complete >= 3) AS enough FROM v, (SELECT utility AS b FROM v WHERE system = 'dense') WHERE system <> 'dense'", "routes", "judged", two=_TWO, s=_SYSTEMS, ideal=_IDEAL, m0=_SYSTEM_ROWS, v=_O42))
def o98(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(o42(spark, d))
    base = rows.filter("system = 'dense'").select(F.col("utility").alias("b"))
    return rows.filter("system <> 'dense'").crossJoin(base).agg(F.count_if(F.col("utility") > F.col("b")).alias("better"), F.count_if(F.col("utility") < F.col("b")).alias("worse"), F.bool_or(F.col("utility") > F.col("b") + 0.05).alias("any_gain"), F.bool_and(F.col("complete") >= 3).alias("enough"))


@query("o108_action_weights", sql("SELECT query_id, count(*) AS actions, round(1.0 / count(*), 6) AS weight FROM a WHERE reward IS NOT NULL GROUP BY 1", "routes", "judged", a=_ACTIONS))
def o108(spark: SparkSession, d: str) -> DataFrame:
    """Judged actions of each query, and the weight of each, so that queries count alike."""
    rows = actions(spark, d).filter("action_id <> 'NOOP' AND reward IS NOT NULL")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("actions"), r6(1 / F.count(F.lit(1)), "weight"))


@query("o110_action_scores", sql("SELECT query_id, action_id, round(s, 6) AS score FROM (SELECT query_id, action_id, c.lexical - r.lexical AS s FROM a JOIN (SELECT query_id, comment_id AS candidate, coalesce(lexical, 0) AS lexical FROM pool) c USING (query_id, candidate) JOIN (SELECT query_id, comment_id AS replaced, coalesce(lexical, 0) AS lexical FROM pool) r USING (query_id, replaced) UNION ALL SELECT DISTINCT query_id, 'NOOP', 0.0 FROM base)", "routes", "judged", a=_ACTIONS, base=_BASE))
def o110(spark: SparkSession, d: str) -> DataFrame:
    """A score of every action, here the gain of one feature; doing nothing has 0."""
    p = t.pool(spark, d).select("query_id", F.col("comment_id"), F.coalesce("lexical", F.lit(0.0)).alias("v"))
    a = actions(spark, d).join(p.select("query_id", F.col("comment_id").alias("candidate_id"), F.col("v").alias("c")), ["query_id", "candidate_id"], "left").join(p.select("query_id", F.col("comment_id").alias("replaced_id"), F.col("v").alias("r")), ["query_id", "replaced_id"], "left")
    return a.select("query_id", "action_id", r6(F.when(F.col("action_id") == "NOOP", 0.0).otherwise(F.col("c") - F.col("r")), "score"))


@query("o115_ordered_rules", sql("SELECT query_id, CASE WHEN action_id = 'NOOP' THEN 'keep' WHEN margin > 0.3 THEN 'swap' WHEN margin > 0.1 THEN 'look' ELSE 'keep' END AS verdict FROM (" + _BEST.format(t=0) + ")", "routes", "judged", base=_BASE, a=_ACTIONS))
def o115(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order over each query's best swap."""
    b = selection.best_action(actions(spark, d), "reward")
    return b.select("query_id", F.when(F.col("action_id") == "NOOP", "keep").when(F.col("margin") > 0.3, "swap").when(F.col("margin") > 0.1, "look").otherwise("keep").alias("verdict"))


@query("o118_candidate_lists", sql("SELECT graph, query_id, count(*) AS n FROM pool, (SELECT unnest([true, false]) AS graph) WHERE graph OR source_pool <> 'graph4' GROUP BY ALL", "pool"))
def o118(spark: SparkSession, d: str) -> DataFrame:
    rows = t.pool(spark, d).withColumn("graph", F.explode(F.array(F.lit(True), F.lit(False)))).filter("graph OR source_pool <> 'graph4'")
    return rows.groupBy("graph", "query_id").agg(F.count(F.lit(1)).alias("n"))


@query("o125_selection_grid", "SELECT CAST(protected AS BIGINT) AS protected, redundancy, marginal FROM (SELECT unnest([2, 4, 6]) AS protected), (SELECT unnest([0.0, 0.1, 0.3]) AS redundancy), (SELECT unnest([0.0, 0.5, 1.0]) AS marginal)")
def o125(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of a selector's settings; a table of fixed size."""
    axis = lambda n, *xs: spark.createDataFrame([(x,) for x in xs], f"{n} {'long' if isinstance(xs[0], int) else 'double'}")
    return axis("protected", 2, 4, 6).crossJoin(axis("redundancy", 0.0, 0.1, 0.3)).crossJoin(axis("marginal", 0.0, 0.5, 1.0))


@query("o121_tuned_selector", sql("SELECT setting, round(u, 6) AS utility, round(g, 6) AS gain FROM (SELECT setting, avg(value) AS u, avg(n8) AS g FROM (SELECT v.setting, v.query_id, v.value, coalesce(d / i.idcg, 0) AS n8 FROM v LEFT JOIN (SELECT setting, query_id, sum(CASE WHEN utility IS NOT NULL THEN (pow(2.0, greatest(utility, 0.0)) - 1) / log2(p + 1) ELSE 0 END) AS d FROM (SELECT setting, query_id, comment_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(coalesce(sbert, 0) + setting * coalesce(lexical, 0), 9) DESC, comment_id) AS p FROM pool, (SELECT unnest([0.0, 0.5, 1.0, 2.0]) AS setting)) LEFT JOIN judged USING (query_id, comment_id) WHERE p <= 8 GROUP BY ALL) x USING (setting, query_id) LEFT JOIN ideal i USING (query_id)) GROUP BY 1) ORDER BY round(u, 9) DESC, round(g, 9) DESC, setting LIMIT 1", "pool", "judged", v=_GRID, ideal=_IDEAL))
def o121(spark: SparkSession, d: str) -> DataFrame:
    """The setting of largest mean utility, then gain, then the smaller one."""
    rows = t.pool(spark, d).withColumn("setting", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)])))
    rows = rows.withColumn("s", F.round(F.coalesce("sbert", F.lit(0.0)) + F.col("setting") * F.coalesce("lexical", F.lit(0.0)), 9))
    top = ranking.top_k(rows, ["setting", "query_id"], [F.desc("s"), "comment_id"], 8).select(F.col("setting").cast("string").alias("route"), *PAIR, "rank")
    gains = metrics.graded_ndcg(top, t.judged(spark, d), 8).select(F.col("route").cast("double").alias("setting"), "query_id", "ndcg")
    per = grid_values(spark, d).join(gains, ["setting", "query_id"]).groupBy("setting").agg(F.avg("value").alias("u"), F.avg("ndcg").alias("g"))
    return per.orderBy(F.desc(F.round("u", 9)), F.desc(F.round("g", 9)), "setting").limit(1).select("setting", r6("u", "utility"), r6("g", "gain"))


@query("o127_swap_utilities", sql(" UNION ALL ".join(f"SELECT {b} AS budget, query_id, round(avg(u.score), 6) AS value FROM ({budget_sql(_DEPTH.format(n=30), b, 'lex')}) z JOIN u USING (query_id, comment_id) GROUP BY ALL" for b in (1, 2, 4)), "routes", "judged", base=_BASE, u=_U, lex="SELECT query_id, comment_id, score FROM routes WHERE route = 'lexical'"))
def o127(spark: SparkSession, d: str) -> DataFrame:
    """Each query's utility by the number of replacements a scorer may make."""
    base, run, u = oracle_inputs(spark, d)
    lexical, out = run.filter("route = 'lexical'").select(*PAIR, "score"), None
    for b in (1, 2, 4):
        part = mean_known(selection.budgeted_set(base, run.filter("route = 'sbert' AND rank <= 30"), lexical, b), u).select(F.lit(b).cast("bigint").alias("budget"), "query_id", r6("value", "value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o128_residual_utilities", sql("SELECT setting, query_id, round(value, 6) AS value, count(*) OVER (PARTITION BY setting) AS queries FROM v", "pool", "judged", v=_GRID))
def o128(spark: SparkSession, d: str) -> DataFrame:
    v = cut(grid_values(spark, d))
    n = v.groupBy("setting").agg(F.count(F.lit(1)).alias("queries"))
    return v.join(F.broadcast(n), "setting").select("setting", "query_id", r6("value", "value"), "queries")  # four settings


@query("o133_rows_with_labels", sql("SELECT source_pool, count(*) AS rows, count(utility) AS labelled, count(*) - count(utility) AS unlabelled FROM pool LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) GROUP BY 1", "pool", "judged"))
def o133(spark: SparkSession, d: str) -> DataFrame:
    rows = t.pool(spark, d).join(t.judged(spark, d).select(*PAIR, "utility"), PAIR, "left")
    return rows.groupBy("source_pool").agg(F.count(F.lit(1)).alias("rows"), F.count("utility").alias("labelled"), (F.count(F.lit(1)) - F.count("utility")).alias("unlabelled"))


@query("o136_pool_identity", sql("SELECT query_id, count(*) FILTER (a) AS fused, count(*) FILTER (b) AS dense, count(*) FILTER (a AND b) AS both, count(*) FILTER (a) = count(*) FILTER (a AND b) AND count(*) FILTER (b) = count(*) FILTER (a AND b) AS same FROM (SELECT query_id, comment_id, bool_or(k = 'fused') AS a, bool_or(k = 'dense') AS b FROM (SELECT 'fused' AS k, query_id, comment_id FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, comment_id) AS p FROM (SELECT query_id, comment_id, sum(1.0 / (60 + rank)) AS s FROM two GROUP BY ALL)) WHERE p <= 20 UNION ALL SELECT 'dense', query_id, comment_id FROM two WHERE route = 'sbert' AND rank <= 20) GROUP BY ALL) GROUP BY 1", "routes", two=_TWO))
def o136(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fused pool is the dense pool as a set, query by query."""
    run = t.routes(spark, d).filter("route IN ('sbert', 'lexical')")
    fused = ranking.top_k(fusion.rrf_scores(run).withColumn("s", F.round("score", 9)), ["query_id"], [F.desc("s"), "comment_id"], 20, "p")
    both = union({"fused": fused, "dense": run.filter("route = 'sbert' AND rank <= 20")}, "k", PAIR).groupBy(*PAIR).agg(F.bool_or(F.col("k") == "fused").alias("a"), F.bool_or(F.col("k") == "dense").alias("b"))
    n = lambda c: F.count_if(c)
    a, b = F.col("a"), F.col("b")
    return both.groupBy("query_id").agg(n(a).alias("fused"), n(b).alias("dense"), n(a & b).alias("both"), ((n(a) == n(a & b)) & (n(b) == n(a & b))).alias("same"))


@query("o135_feature_table_gate", sql("SELECT count(*) AS rows, count(DISTINCT (query_id, comment_id)) AS pairs, count(*) FILTER (p_dense BETWEEN 0 AND 1 AND p_bm25 BETWEEN 0 AND 1 AND p_lex BETWEEN 0 AND 1) AS in_range FROM m", "run", "routes", m=_MATRIX))
def o135(spark: SparkSession, d: str) -> DataFrame:
    """The feature table with the gates it must pass."""
    m = feature_matrix(spark, d)
    ok = F.col("p_dense").between(0, 1) & F.col("p_bm25").between(0, 1) & F.col("p_lex").between(0, 1)
    return m.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*PAIR)).alias("pairs"), F.count_if(ok).alias("in_range"))


@query("o142_group_codes", sql("SELECT query_id, CAST(dense_rank() OVER (ORDER BY query_id) - 1 AS BIGINT) AS code, count(*) AS size FROM pool GROUP BY 1", "pool"))
def o142(spark: SparkSession, d: str) -> DataFrame:
    """Queries as numbers from 0 in order, with their sizes, as rankers want them."""
    sizes = t.pool(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("size")).withColumn("all", F.lit(1))
    return ranking.ranked_split(sizes, ["all"], ["query_id"], "n").select("query_id", (F.col("n") - 1).cast("bigint").alias("code"), "size")


@query("o144_inner_criterion", sql("SELECT setting, round(avg(abs(utility - (1 + 6 * least(1, greatest(0, coalesce(sbert, 0) * setting))))), 6) AS mae, count(*) AS n FROM l, (SELECT unnest([0.5, 1.0, 1.5]) AS setting) GROUP BY 1", "pool", "judged", l=_L))
def o144(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of predictions on the scale, by setting."""
    rows = labelled(spark, d).withColumn("setting", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))))
    p = 1 + 6 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("sbert", F.lit(0.0)) * F.col("setting")))
    return rows.groupBy("setting").agg(r6(F.avg(F.abs(F.col("utility") - p)), "mae"), F.count(F.lit(1)).alias("n"))


@query("o146_pair_universe", sql("SELECT count(*) AS pairs, count(DISTINCT query_id) AS queries, count(*) FILTER (query_text IS NOT NULL AND comment_text IS NOT NULL) AS with_texts, count(*) FILTER (len(" + _TOK.format(c="comment_text") + ") = 0) AS wordless FROM x", "pool", "texts", "notes", x=_PAIRTEXT))
def o146(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that a scorer of texts would see."""
    return pair_texts(spark, d).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("queries"), F.count_if(F.col("query_text").isNotNull() & F.col("comment_text").isNotNull()).alias("with_texts"), F.count_if(F.size(tx.tokens(F.col("comment_text"))) == 0).alias("wordless"))


@query("o151_cohort_runs", sql("SELECT route, query_id, string_agg(comment_id, ' ' ORDER BY rank) AS ids FROM run WHERE rank <= 3 AND query_id IN (SELECT query_id FROM texts WHERE tier IN ('deep', 'mid')) GROUP BY ALL", "run", "texts"))
def o151(spark: SparkSession, d: str) -> DataFrame:
    """The first three ids of each list of a cohort, together."""
    cohort = t.texts(spark, d).filter("tier IN ('deep', 'mid')").select("query_id")
    rows = t.run(spark, d).filter("rank <= 3").join(cohort, "query_id", "left_semi")
    return rows.groupBy(*ranking.KEYS).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "comment_id"))), lambda x: x["comment_id"])).alias("ids"))


@query("o152_means_of_known", sql("SELECT judge_version, round(avg(utility), 6) AS mean, round(quantile_cont(utility, 0.5), 6) AS median, count(*) - count(utility) AS missing FROM qrels GROUP BY 1"))
def o152(spark: SparkSession, d: str) -> DataFrame:
    """Means and medians of what is known."""
    return table(spark, d, "qrels").groupBy("judge_version").agg(r6(F.avg("utility"), "mean"), r6(F.percentile("utility", 0.5), "median"), (F.count(F.lit(1)) - F.count("utility")).alias("missing"))


_PROMPT = "Rate this reply to a question on seven labels.\n\nQuestion: {query}\n\nReply: {snippet}\n"


@query("o155_prompts", sql("SELECT query_id, comment_id, md5('" + _PROMPT.split("{query}")[0].replace("\n", "' || chr(10) || '") + "' || query_text || '" + _PROMPT.split("{query}")[1].split("{snippet}")[0].replace("\n", "' || chr(10) || '") + "' || comment_text || chr(10)) AS prompt FROM x WHERE query_text IS NOT NULL AND comment_text IS NOT NULL", "pool", "texts", "notes", x=_PAIRTEXT))
def o155(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the prompts that a template gives."""
    before, rest = _PROMPT.split("{query}")
    between, after = rest.split("{snippet}")
    rows = pair_texts(spark, d).filter("query_text IS NOT NULL AND comment_text IS NOT NULL")
    return rows.select(*PAIR, F.md5(F.concat(F.lit(before), "query_text", F.lit(between), "comment_text", F.lit(after))).alias("prompt"))



# SQL of studies defined elsewhere

_VEC = "SELECT query_id, comment_id, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS vec FROM (SELECT query_id, comment_id, [coalesce(sbert, 0.0), coalesce(lexical, 0.0), coalesce(d8_max, 0.0), coalesce(d8_mean, 0.0), coalesce(novelty, 0.0)] AS w FROM pool)"
ORACLE["h24_intra_list_distance"] = sql("SELECT query_id, round(coalesce(1 - avg(greatest(-1, least(1, list_dot_product(a.vec, b.vec)))), 0), 6) AS ild FROM t a JOIN t b USING (query_id) WHERE a.comment_id < b.comment_id GROUP BY 1", "routes", v=_VEC, t="SELECT query_id, comment_id, vec FROM v JOIN (SELECT query_id, comment_id FROM routes WHERE route = 'sbert' AND rank <= 8) USING (query_id, comment_id)")
ORACLE["i38_policy_arm"] = sql(
    "SELECT count(*) AS queries, round(avg(CASE WHEN acted THEN 1.0 ELSE 0.0 END), 6) AS action_rate, round(avg(r), 6) AS mean_reward, round(avg(CASE WHEN acted AND r < 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS harm_rate, round(avg(best - r), 6) AS regret FROM (SELECT q.query_id, coalesce(m - 0.25 > 0, false) AS acted, CASE WHEN m - 0.25 > 0 THEN p.reward ELSE 0.0 END AS r, best FROM (SELECT DISTINCT query_id FROM base) q LEFT JOIN (SELECT * FROM (SELECT query_id, reward, lex AS m, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, action_id DESC) AS n FROM a JOIN (SELECT query_id, comment_id AS candidate, score AS lex FROM routes WHERE route = 'lexical') USING (query_id, candidate)) WHERE n = 1) p USING (query_id) JOIN (SELECT query_id, greatest(max(reward), 0.0) AS best FROM (SELECT query_id, reward FROM a UNION ALL SELECT DISTINCT query_id, 0.0 FROM base) GROUP BY 1) USING (query_id))",
    "routes", "judged", base=_BASE, a=_ACTIONS,
)
_ARMS = (
    "SELECT 'sbert' AS route, query_id, comment_id, rank FROM two WHERE route = 'sbert' UNION ALL SELECT 'lexical', query_id, comment_id, rank FROM two WHERE route = 'lexical' UNION ALL SELECT 'fused', query_id, comment_id, rank FROM fu "
    "UNION ALL SELECT 'residual', query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY o) FROM (SELECT query_id, comment_id, min(o) AS o FROM (SELECT query_id, comment_id, CASE WHEN rank <= 6 THEN rank ELSE 2000000 + rank END AS o FROM fu UNION ALL SELECT query_id, comment_id, 1000000 + n FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS n FROM two r WHERE route = 'lexical' AND NOT EXISTS (SELECT 1 FROM fu o WHERE o.rank <= 6 AND o.query_id = r.query_id AND o.comment_id = r.comment_id)) WHERE n <= 2) GROUP BY ALL)"
)
ORACLE["o30_held_out_arms"] = sql(
    "SELECT route, count(*) AS queries, count(v) AS complete, round(avg(v), 6) AS utility, round(avg(g), 6) AS good_share FROM (SELECT route, query_id, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 THEN avg(utility) END AS v, CASE WHEN count(DISTINCT comment_id) = 8 AND count(utility) = 8 THEN avg(CASE WHEN utility >= 4 THEN 1.0 ELSE 0.0 END) END AS g FROM arms LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id) WHERE rank <= 8 GROUP BY ALL) GROUP BY 1",
    "routes", "judged", two=_TWO, fu="SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, comment_id) AS rank FROM (SELECT query_id, comment_id, sum(CASE route WHEN 'lexical' THEN 0.3 ELSE 1.0 END / (60 + rank)) AS s FROM two GROUP BY ALL)", arms=_ARMS,
)


def _rank_moments(x: str) -> str:
    v = lambda c: f"rank() OVER (PARTITION BY query_id ORDER BY {c}) + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2.0"
    base = f"SELECT query_id, {v(x)} AS x, {v('utility')} AS y, {v('length')} AS z FROM l WHERE {x} IS NOT NULL AND length IS NOT NULL"
    return f"SELECT query_id, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz FROM (SELECT query_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM ({base}) WINDOW w AS (PARTITION BY query_id)) GROUP BY 1 HAVING count(*) >= 3 AND sum(x * x) > 1e-12 AND sum(y * y) > 1e-12"


ORACLE["o44_triangulation"] = sql(" UNION ALL ".join(f"SELECT '{x}' AS signal, count(*) AS units, CAST(sum(n) AS BIGINT) AS n, round(sum(xy) / sqrt(sum(xx) * sum(yy)), 6) AS r, round((sum(xy) * sum(zz) - sum(xz) * sum(yz)) / sqrt((sum(xx) * sum(zz) - pow(sum(xz), 2)) * (sum(yy) * sum(zz) - pow(sum(yz), 2))), 6) AS partial_r FROM ({_rank_moments(x)})" for x in ("sbert", "lexical", "novelty")), "pool", "judged", l=_L)
_WANTED = {"useful": "utility >= 5", "uncertain": "utility BETWEEN 3 AND 5", "novel": "novelty >= 0.5"}
_FIRST = "SELECT query_id, comment_id FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY sbert DESC, comment_id) AS n FROM c WHERE {w}{not_}) WHERE n = 1"
_NOT = " AND (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM {t})"
ORACLE["e49_slots"] = sql(
    "SELECT query_id, comment_id, slot FROM taken UNION ALL SELECT query_id, comment_id, 'fill' FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY sbert DESC, comment_id) AS n FROM c WHERE (query_id, comment_id) NOT IN (SELECT (query_id, comment_id) FROM taken)) LEFT JOIN (SELECT query_id, count(*) AS k FROM taken GROUP BY 1) USING (query_id) WHERE n + coalesce(k, 0) <= 5",
    "pool", "judged", c="SELECT p.*, utility FROM pool p LEFT JOIN (SELECT query_id, comment_id, utility FROM judged) USING (query_id, comment_id)",
    s1=_FIRST.format(w=_WANTED["useful"], not_=""), s2=_FIRST.format(w=_WANTED["uncertain"], not_=_NOT.format(t="s1")), s3=_FIRST.format(w=_WANTED["novel"], not_=_NOT.format(t="s1") + _NOT.format(t="s2")),
    taken="SELECT query_id, comment_id, 'useful' AS slot FROM s1 UNION ALL SELECT query_id, comment_id, 'uncertain' FROM s2 UNION ALL SELECT query_id, comment_id, 'novel' FROM s3",
)
_ALONE = "SELECT query_id, comment_id, 1000000 + n AS o, 'exclusive' AS rule FROM (SELECT query_id, comment_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, comment_id) AS n FROM routes r WHERE route = 'length' AND NOT EXISTS (SELECT 1 FROM routes o WHERE o.query_id = r.query_id AND o.comment_id = r.comment_id AND o.route IN ('sbert', 'lexical') AND o.rank <= 20)) WHERE n <= 3"
_APART = "SELECT query_id, comment_id, 2000000 + least(coalesce(a, 9999), coalesce(b, 9999)) AS o, 'disagreement' AS rule FROM (SELECT query_id, comment_id, min(rank) FILTER (route = 'sbert') AS a, min(rank) FILTER (route = 'lexical') AS b FROM routes GROUP BY ALL) WHERE (a <= 10 AND (b IS NULL OR b > 30)) OR (b <= 10 AND (a IS NULL OR a > 30))"
ORACLE["e16_mother_pool"] = sql(
    f"SELECT query_id, comment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, comment_id) AS BIGINT) AS pos, rules FROM (SELECT query_id, comment_id, min(o) AS o, string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules FROM (SELECT query_id, comment_id, min(rank) AS o, 'core' AS rule FROM routes WHERE route IN ('sbert', 'lexical') AND rank <= 3 GROUP BY ALL UNION ALL {_ALONE} UNION ALL {_APART} UNION ALL SELECT query_id, comment_id, 3000000 + row_number() OVER (PARTITION BY query_id ORDER BY s DESC, comment_id), 'rrf' FROM (SELECT query_id, comment_id, sum(1.0 / (60 + rank)) AS s FROM routes GROUP BY ALL)) GROUP BY ALL) QUALIFY pos <= 30",
    "routes",
)
_N01 = "CASE WHEN max(score) OVER w - min(score) OVER w <= 0 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
ORACLE["e12_tune_cc_weights"] = sql(
    "SELECT CAST(grid AS BIGINT) AS grid, a AS weight_sbert, b AS weight_lexical, c AS weight_length, avg(v) AS value FROM (SELECT grid, a, b, c, query_id, sum(CASE WHEN g.hit = 1 THEN 1 / log2(p + 1) ELSE 0 END) / max(ideal) AS v FROM (SELECT *, row_number() OVER (PARTITION BY grid, query_id ORDER BY a * x + b * y + c * z DESC, comment_id) AS p FROM wide, grid) t LEFT JOIN (SELECT query_id, comment_id, 1 AS hit FROM gold) g USING (query_id, comment_id) WHERE p <= 8 GROUP BY ALL) GROUP BY ALL ORDER BY round(avg(v), 9) DESC, grid LIMIT 1",
    "routes", "gold", grid="SELECT row_number() OVER (ORDER BY i, j) - 1 AS grid, i / 10 AS a, j / 10 AS b, (10 - i - j) / 10 AS c FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j) WHERE i + j <= 10",
    wide=f"SELECT query_id, comment_id, coalesce(max(v) FILTER (route = 'sbert'), 0) AS x, coalesce(max(v) FILTER (route = 'lexical'), 0) AS y, coalesce(max(v) FILTER (route = 'length'), 0) AS z, max(list_sum(list_transform(range(1, CAST(least(n, 8) AS BIGINT) + 1), lambda k: 1 / log2(k + 1)))) AS ideal FROM (SELECT *, {_N01} AS v FROM routes WINDOW w AS (PARTITION BY route, query_id)) JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) USING (query_id) GROUP BY ALL",
)
