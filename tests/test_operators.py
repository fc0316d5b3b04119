"""Small fixtures by hand and brute force for the operators that SQL does not express, and for edge cases of the others."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import utility as ut
from rankloom.operators import fusion, graph, guards, learn, metrics, pools, ranking, sampling, selection, setops, stats

RUN = "route string, query_id string, comment_id string, score double, rank int"


def make_run(spark, lists):
    """{route: {query: [ids]}} as a run with falling scores."""
    rows = [(r, q, c, float(len(ids) - i), i + 1) for r, qs in lists.items() for q, ids in qs.items() for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, RUN)


def ids(df, *order):
    return [r["comment_id"] for r in df.orderBy(*(order or ("query_id", "rank"))).collect()]


@pytest.fixture(scope="module")
def small(spark):
    return make_run(spark, {"a": {"q": ["x", "y", "z"]}, "b": {"q": ["z", "w", "x"], "p": ["k"]}})


def test_as_run_drops_empty_ids_keeps_best_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "a", None), ("q", " ", 9.0), ("q", None, 9.0), (None, "c", 1.0), ("q", "n", float("nan")), ("q", "b", 1.0)], "query_id string, item string, s double")
    run = ranking.as_run(rows, F.lit("r"), "query_id", "item", F.col("s"))
    assert [(r.comment_id, r.score, r.rank) for r in run.orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("n", 0.0, 3)]
    assert ranking.as_run(rows.limit(0), F.lit("r"), "query_id", "item", F.col("s")).count() == 0


@pytest.mark.parametrize(("constant", "expected"), [(1.0, 1.0), (0.0, 0.0), (0.5, 0.5)])
def test_minmax_of_constant_scores(spark, constant, expected):
    df = spark.createDataFrame([("q", 2.0), ("q", 2.0)], "query_id string, score double")
    assert {r[0] for r in df.select(ranking.minmax(F.col("score"), ["query_id"], constant)).collect()} == {expected}


def test_rank_percentile_of_one_item_and_ties(spark):
    df = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 2.0), ("p", "a", 5.0)], "query_id string, comment_id string, score double")
    out = {(r.query_id, r.comment_id): r.v for r in df.withColumn("v", ranking.rank_percentile(F.col("score"), "comment_id", ["query_id"])).collect()}
    assert out == {("q", "a"): 0.0, ("q", "b"): 0.5, ("q", "c"): 1.0, ("p", "a"): 1.0}


def test_rrf_ties_keep_the_order_in_which_they_are_met(spark):
    run = make_run(spark, {"a": {"q": ["z"]}, "b": {"q": ["a"]}})
    assert ids(fusion.fuse(run, ["a", "b"], k=2)) == ["z", "a"]
    assert ids(fusion.fused_order(run)) == ["a", "z"]


def test_cc_weights_of_zero_and_missing_routes(spark, small):
    scores = {r.comment_id: r.score for r in fusion.cc_scores(small, {"a": 0.0}).filter("query_id = 'q'").collect()}
    assert set(scores.values()) == {0.0}


def test_tuned_weights_find_the_good_route(spark):
    run = make_run(spark, {"a": {"q": ["g", "x", "y"], "p": ["h", "x", "y"]}, "b": {"q": ["x", "y", "g"], "p": ["y", "x", "h"]}, "c": {"q": ["y", "x", "g"], "p": ["x", "y", "h"]}})
    gold = spark.createDataFrame([("q", "g"), ("p", "h")], "query_id string, comment_id string")
    best = fusion.tune_cc_weights(run, gold, ["a", "b", "c"], k=1).first()
    assert best.value == 1.0 and best.weight_a >= 0.5


def round_robin(lists, excluded, budget):
    taken, at = {}, [0] * len(lists)
    while len(taken) < budget:
        before = len(taken)
        for i, (name, items) in enumerate(lists):
            while at[i] < len(items) and (items[at[i]] in taken or items[at[i]] in excluded):
                at[i] += 1
            if at[i] < len(items) and len(taken) < budget:
                taken[items[at[i]]] = name
                at[i] += 1
        if len(taken) == before:
            break
    return list(taken.items())


def test_round_robin_against_a_loop(spark):
    rng = random.Random(3)
    cases = {f"q{i}": {r: rng.sample("abcdefghij", rng.randint(1, 8)) for r in ("r1", "r2")} for i in range(40)}
    run = make_run(spark, {r: {q: c[r] for q, c in cases.items()} for r in ("r1", "r2")})
    gone = {q: set(rng.sample("abcdefghij", 2)) for q in cases}
    excluded = spark.createDataFrame([(q, c) for q, s in gone.items() for c in s], "query_id string, comment_id string")
    got = {}
    for r in pools.round_robin(run, ["r1", "r2"], excluded, 4).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append((r.comment_id, r.first_route))
    for q, c in cases.items():
        assert got.get(q, []) == round_robin(list(c.items()), gone[q], 4)


def test_interleave_follows_the_share_and_takes_no_item_twice(spark):
    run = make_run(spark, {"a": {"q": list("abcdefgh")}, "b": {"q": list("cxyzabuv")}})
    out = ids(pools.interleave(run, "a", "b", 0.75, 8), "pos")
    assert len(out) == len(set(out)) == 8 and sum(c in "abdefgh" for c in out) >= 5
    short = make_run(spark, {"a": {"q": ["a"]}, "b": {"q": ["b", "c"]}})
    assert ids(pools.interleave(short, "a", "b", 0.9, 8), "pos") == ["a", "b", "c"]


def test_budgeted_set_against_all_sets(spark):
    rng = random.Random(5)
    for budget in (0, 1, 3, 8):
        score = {c: rng.choice([0.0, 1.0, 2.0, 2.5, 3.0, 4.0]) for c in "abcdefghijkl"}
        base, pool = list("abcd"), list("abcdefghijkl")
        frame = lambda xs: spark.createDataFrame([("q", c) for c in xs], "query_id string, comment_id string")
        chosen = ids(selection.budgeted_set(frame(base), frame(pool), spark.createDataFrame([("q", c, s) for c, s in score.items()], "query_id string, comment_id string, score double"), budget, k=4), "comment_id")
        best = max(sum(score[c] for c in s) for s in itertools.combinations(pool, 4) if len(set(s) - set(base)) <= budget)
        assert math.isclose(sum(score[c] for c in chosen), best) and len(set(chosen) - set(base)) <= budget and len(set(chosen)) == 4


def test_mmr_without_diversity_is_the_order_of_quality_and_respects_the_budget(spark):
    rows = [("q", c, q, [1.0, 0.0], c in "ab") for c, q in zip("abcd", (0.1, 0.2, 0.9, 0.8))] + [("q", "c", 0.9, [1.0, 0.0], False), ("q", "e", None, None, None)]
    pool = spark.createDataFrame(rows, "query_id string, comment_id string, quality double, vec array<double>, in_baseline boolean")
    assert ids(selection.mmr(pool, 0.0, 3), "pick") == ["c", "d", "b"]
    assert ids(selection.mmr(pool, 0.0, 3, budget=1), "pick") == ["c", "b", "a"]


def test_mmr_prefers_what_differs(spark):
    pool = spark.createDataFrame([("q", "a", 0.9, [1.0, 0.0], True), ("q", "b", 0.89, [1.0, 0.0], True), ("q", "c", 0.5, [0.0, 1.0], True)], "query_id string, comment_id string, quality double, vec array<double>, in_baseline boolean")
    assert ids(selection.mmr(pool, 0.5, 2), "pick") == ["a", "c"]


def test_replacement_contributions_sum_to_the_gain(spark):
    u = {c: float(i) for i, c in enumerate("abcdefghijkl")}
    frame = lambda xs: spark.createDataFrame([("q", c) for c in xs], "query_id string, comment_id string")
    util = spark.createDataFrame([("q", c, v) for c, v in u.items()], "query_id string, comment_id string, utility double")
    base, new = "abcdefgh", "abcdeijk"
    total = selection.replacements(frame(new), frame(base), util).agg(F.sum("contribution")).first()[0]
    assert math.isclose(total, (sum(u[c] for c in new) - sum(u[c] for c in base)) / 8)


def test_best_action_needs_the_margin(spark):
    rows = [("q", "NOOP", None, None, 0.0), ("q", "a>b", "b", "a", 0.2), ("p", "NOOP", None, None, 0.0), ("p", "a>b", "b", "a", -0.1), ("n", "NOOP", None, None, 0.0)]
    actions = spark.createDataFrame(rows, "query_id string, action_id string, candidate_id string, replaced_id string, reward double")
    out = {r.query_id: r.action_id for r in selection.best_action(actions, "reward", 0.1).collect()}
    assert out == {"q": "a>b", "p": "NOOP", "n": "NOOP"}
    assert {r.action_id for r in selection.best_action(actions, "reward", 0.3).collect()} == {"NOOP"}


def test_binary_metrics_by_hand(spark):
    run = make_run(spark, {"r": {"q": ["a", "b", "c"], "none": ["a"]}})
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b")], "query_id string, comment_id string")
    out = {r.query_id: r for r in metrics.binary_metrics(run, gold, [0, 2, 10]).collect()}
    q = out["q"]
    assert (q.mrr, q.ap, q.recall_2, q.precision_2, q.precision_10, q.hit_2, q.joint_10, q.precision_0) == (0.5, 0.25, 0.5, 0.5, 0.1, 1, 0, 0.0)
    assert math.isclose(q.ndcg_2, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (out["none"].recall_2, out["none"].ap, out["none"].ndcg_2) == (0.0, 0.0, 0.0)


def test_incomplete_sets_have_no_utility(spark):
    run = make_run(spark, {"r": {"q": list("ab"), "p": list("ab")}})
    judged = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 5.0), ("p", "a", 4.0)], "query_id string, comment_id string, utility double")
    out = {r.query_id: r.utility for r in metrics.set_utility(run, judged, 2).collect()}
    assert out == {"q": 4.5, "p": None}


def test_alignment_by_hand(spark):
    c = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("q", "b", [0.0, 1.0])], "query_id string, comment_id string, vec array<double>")
    r = spark.createDataFrame([("q", "r", [1.0, 0.0]), ("q", "s", [0.6, 0.8])], "query_id string, reply_id string, vec array<double>")
    x = metrics.alignment(c, r, 0.9).first()
    assert math.isclose(x.cra, 0.9) and math.isclose(x.rcc, 0.9) and x.best == 1.0 and x.coverage == 0.5


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    df = spark.createDataFrame([(f"q{i}", float(i % 7), "g") for i in range(300)] + [("n", None, "g")], "query_id string, v double, g string")
    a, b = (stats.bootstrap_mean(df.repartition(n), "query_id", "v", ["g"], draws=400).first() for n in (1, 7))
    assert a == b and a.low < a["mean"] < a.high and a.n == 300
    assert stats.bootstrap_mean(df.limit(0), "query_id", "v", ["g"]).count() == 0
    assert stats.sign_flip_p(df, "query_id", "v", draws=500) < 0.01 and stats.sign_flip_p(df.limit(0), "query_id", "v") is None


def test_kappa_of_equal_opposite_and_constant_raters(spark):
    same = spark.createDataFrame([(i % 7 + 1, i % 7 + 1) for i in range(70)] + [(None, 3), (9, 1)], "a int, b int")
    assert stats.agreement(same, "a", "b").first().kappa == 1.0
    assert stats.agreement(spark.createDataFrame([(1, 7), (7, 1)], "a int, b int"), "a", "b").first().kappa == -1.0
    assert stats.agreement(spark.createDataFrame([(3, 3)], "a int, b int"), "a", "b").first().kappa is None


def test_clamp_and_grade(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("9",), ("x",), (None,), ("nan",)], "v string")
    assert [r[0] for r in df.select(ut.clamp_score(F.col("v"))).collect()] == [2, 4, 7, 1, 1, 1]


def test_unsafe_items_are_capped(spark):
    df = spark.createDataFrame([(7, 7, 7, 7, 7, 2), (7, 7, 7, 7, 7, 7), (7, 7, 7, 7, 7, None)], ", ".join(f"{c} int" for c in ut.WEIGHTS if c != "label_safety") + ", label_safety int")
    assert [r[0] for r in df.select(F.round(ut.utility(), 6)).collect()] == [2.0, 7.0, None]


def test_nulls_stay_null_under_greatest_and_least(spark):
    from rankloom.functions.vectors import cosine

    df = spark.createDataFrame([(None, None, [1.0])], "u double, a array<double>, b array<double>")
    out = df.select(ut.grade(F.col("u")), metrics.gain(F.col("u")), selection.candidate_quality(F.col("u")), cosine(F.col("a"), F.col("b"))).first()
    assert list(out) == [None] * 4
    labels = spark.createDataFrame([(None, 7, 7, 7, 7, 1)], ", ".join(f"{c} int" for c in ut.WEIGHTS))
    assert labels.select(ut.utility()).first()[0] is None


def test_parse_judgment_forms(spark):
    rows = [('{"relevance": 3, "safety": 7}',), ('Sure!\n```json\n{"relevance": 4, "safety": 6}\n```',), ('relevance: 5, "safety": 2',), ("no idea",), (None,)]
    out = [r[0] and r[0].relevance for r in spark.createDataFrame(rows, "t string").select(ut.parse_judgment(F.col("t"), ["relevance", "safety"])).collect()]
    assert out == [3.0, 4.0, 5.0, None, None]


def test_text_functions_take_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("The Cat’s  \n\tHAT " * 20_000,)], "t string")
    out = df.select(F.size(tx.tokens(F.col("t"))), tx.canonical(F.col("t")), tx.ascii_normal(F.col("t")), F.size(tx.links(F.col("t")))).collect()
    assert out[0][0] == 0 and out[0][1] is None and out[0][2] is None and out[2][0] == 40_000 and "’" not in out[2][2]


def test_redaction(spark):
    t = spark.createDataFrame([("mail me@x.org or u/some_one in r/adhd, https://a.b/c?d=1 call 555 123 4567",)], "t string").select(tx.redacted(F.col("t")).alias("r"))
    assert t.first().r == "mail [EMAIL] or [USER] in [COMMUNITY], [URL] call [NUMBER]"


def test_bm25_ranks_rare_words_first(spark):
    docs = spark.createDataFrame([("a", "timer planner planner"), ("b", "planner kettle"), ("c", None), ("d", "planner"), ("e", "lamp")], "comment_id string, t string")
    q = spark.createDataFrame([("q", "kettle planner"), ("n", None), ("o", "unknown")], "query_id string, q string")
    out = tx.bm25(docs, q, "comment_id", "t", "q", 5).collect()
    assert out[0].comment_id == "b" and {r.query_id for r in out} == {"q"}


def test_pagerank_against_dense_iteration(spark):
    import numpy as np

    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)]
    e = spark.createDataFrame(edges + [(None, "a", 1.0), ("a", "b", 0.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("q", "a", 3.0), ("q", "c", 1.0)], "query_id string, node string, weight double")
    out = {r.node: r.score for r in graph.pagerank(e, s, 0.5, 6, cut_every=3).collect()}
    names = "abcd"
    p = np.zeros((4, 4))
    for x, y, w in edges:
        p[names.index(x), names.index(y)] = w
    p = np.divide(p, p.sum(1, keepdims=True), out=np.zeros_like(p), where=p.sum(1, keepdims=True) > 0)
    r = np.array([0.75, 0, 0.25, 0])
    v = r.copy()
    for _ in range(6):
        m = 0.5 * v @ p
        v = m + r * (1 - m.sum())
    for n, x in zip(names, v):
        assert math.isclose(out.get(n, 0.0), x, abs_tol=1e-9)


def test_seed_distances_by_hand(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 2.0)], "query_id string, node string, weight double")
    out = {r.node: (r.seeds, r.distance, round(r.weighted, 6)) for r in graph.seed_distances(e, s, 2).collect()}
    assert out == {"a": (2, 0, 1.666667), "b": (2, 1, 1.5), "c": (2, 0, 2.333333), "d": (1, 1, 1.0), "e": (1, 2, 0.666667)}


def test_aliases_and_digests(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None), (1, "x")], "id int, t string")
    assert {r.id: r.canonical for r in setops.aliases(df, "id", F.col("t")).collect()} == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5}
    a, b = setops.set_digest(df, ["id", "t"]).first(), setops.set_digest(df.orderBy(F.desc("id")).repartition(3), ["t", "id"]).first()
    assert a == b and a.n == 5 and setops.set_digest(df.filter("id > 1"), ["id", "t"]).first().digest != a.digest
    assert setops.set_digest(df.limit(0), ["id"]).first().n == 0


def test_slots_use_no_item_twice(spark):
    rows = spark.createDataFrame([("q", c, float(i)) for i, c in enumerate("abcdef")], "query_id string, item string, s double")
    out = sampling.slots(rows, "query_id", "item", {"low": F.col("s") < 3, "any": F.lit(True), "never": F.lit(False)}, [F.desc("s"), "item"], 4).collect()
    assert {(r.slot, r.item) for r in out} == {("low", "c"), ("any", "f"), ("fill", "e"), ("fill", "d")}


def test_folds_hold_every_query_once(spark):
    df = spark.createDataFrame([(f"q{i}",) for i in range(200)] * 2, "query_id string")
    f = sampling.folds(df, "query_id", 5, 2)
    assert f.count() == 400 and f.select("fold").distinct().count() == 5
    roles = f.filter("repeat = 0").crossJoin(spark.range(5).withColumnRenamed("id", "f")).select("repeat", F.col("f").alias("fold"), "query_id", F.when(F.col("f") == F.col("fold"), "v").otherwise("t").alias("role"))
    assert guards.fold_leaks(roles).count() == 0


def test_guards_raise(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    with pytest.raises(guards.ContractError):
        guards.assert_unique(df, ["k"])
    with pytest.raises(guards.ContractError):
        guards.assert_present(df, ["k"])
    with pytest.raises(guards.ContractError):
        guards.assert_disjoint(df, df, ["k"], "x")
    guards.assert_same_set(df, df.distinct(), "x")
    nested = spark.createDataFrame([], "a struct<author:string, b:array<struct<email:string>>>").schema
    assert guards.forbidden_fields(nested, {"author", "email"}) == ["a.author", "a.b.email"]


def test_hot_keys_are_looked_up_without_a_shuffle_of_theirs(spark):
    from rankloom.base import lookup_skewed

    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    out = lookup_skewed(left, right, "k", "n")
    assert out.count() == 30_000 and out.filter("k = 'hot'").count() == 10_000 and out.filter("m IS NULL").count() == 0


def test_pairwise_scorer_learns_the_order(spark):
    rng = random.Random(1)
    rows = [(f"q{i % 6}", f"c{i}", x := rng.random(), rng.random(), 1 + 6 * x) for i in range(90)]
    df = spark.createDataFrame(rows + [("q0", "u", 0.5, None, None)], "query_id string, comment_id string, x double, noise double, utility double")
    out = learn.fit_pairwise(df, df, ["x", "noise"], "utility", "logistic", 0.5).join(df, ["query_id", "comment_id"])
    acc = metrics.pairwise_accuracy(out, "score", "utility", 0.5).agg(F.avg("accuracy")).first()[0]
    assert acc > 0.95 and out.count() == 91


def test_one_standard_error_is_conservative(spark):
    rows = [(b, f"q{i}", v + 0.01 * (i % 3)) for b, v in ((0, 1.0), (1, 2.0), (2, 2.0005)) for i in range(9)]
    # the best setting's lead of 0.0005 is within the error of its differences
    rows = [(b, q, v + {"q1": 0.02, "q2": -0.02}.get(q, 0.0) * (b == 2)) for b, q, v in rows]
    df = spark.createDataFrame(rows, "budget int, query_id string, value double")
    assert learn.one_standard_error(df, "budget", "value", "query_id").first().budget == 1


def test_clusters_count_once(spark):
    c = spark.createDataFrame([("q", "a", [1.0, 0.0])], "query_id string, comment_id string, vec array<double>")
    rows = [("q", f"r{i}", [1.0, 0.0]) for i in range(9)] + [("q", "z", [0.0, 1.0]), ("q", "n", None)]
    x = metrics.cluster_balanced_coverage(c, spark.createDataFrame(rows, "query_id string, reply_id string, vec array<double>"), 0.3).first()
    assert (x.clusters, x.rcc) == (2, 0.5)
    assert metrics.cluster_balanced_coverage(c.limit(0), spark.createDataFrame(rows, "query_id string, reply_id string, vec array<double>")).count() == 0


def test_all_replies_of_a_query_are_clustered(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(70, 5))
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[60:] = vectors[:10]
    vectors[30] = 0
    c = spark.createDataFrame([("q", "a", [1.0, 0.0, 0.0, 0.0, 0.0]), ("q", "b", [0.0, 0.0, 1.0, 0.0, 0.0])], "query_id string, comment_id string, vec array<double>")
    r = spark.createDataFrame([("q", f"r{i:02}", v.tolist()) for i, v in enumerate(vectors)], "query_id string, reply_id string, vec array<double>")

    def brute(v, distance):
        gap, groups = 1 - v @ v.T, [[i] for i in range(len(v))]
        while len(groups) > 1:
            best, j, i = min((round(gap[np.ix_(a, b)].mean(), 12), j, i) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
            if best > distance:
                break
            groups[j] += groups.pop(i)
        m = np.maximum(v[:, 0], v[:, 2])
        return len(groups), np.mean([m[g].mean() for g in groups])

    for distance in (0.2, 0.6):
        for most in (None, 20):
            x = metrics.cluster_balanced_coverage(c, r, distance, most).first()
            clusters, rcc = brute(vectors[:most], distance)
            assert x.clusters == clusters and math.isclose(x.rcc, rcc, abs_tol=1e-9)
    assert metrics.cluster_balanced_coverage(c, r, 0.2).first().clusters > brute(vectors[:50], 0.2)[0]


def _made_lists(spark, queries=40, each=12, seed=4):
    rng = random.Random(seed)
    rows = []
    for q in range(queries):
        for i in range(each):
            a, b, noise = rng.random(), rng.random(), rng.random()
            rows.append((f"q{q:02d}", f"c{i:02d}", a, b, noise, round(1 + 6 * (0.7 * a + 0.3 * (1 - b)), 2)))
    return spark.createDataFrame([*rows, ("q00", "cx", None, 0.5, 0.5, None)], "query_id string, comment_id string, a double, b double, noise double, utility double")


@pytest.mark.parametrize("fit", [learn.fit_lambdamart, learn.fit_listwise, lambda *x: learn.fit_listwise(*x, family="ranknet"), learn.fit_network, lambda *x: learn.fit_network(*x, loss="pairs")])
def test_rankers_order_held_out_lists(spark, fit):
    df = _made_lists(spark)
    train, held = df.filter("query_id < 'q30'"), df.filter("query_id >= 'q30'")
    scored = fit(train, held, ["a", "b", "noise"], "utility").join(held, ["query_id", "comment_id"])
    rho = metrics.within_query_spearman(scored, "score", "utility").agg(F.avg("rho")).first()[0]
    assert rho > 0.8 and scored.count() == held.count()
    assert fit(train.limit(0), held, ["a", "b", "noise"], "utility").count() == held.count()


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(7, 3)), rng.normal(size=7), rng.normal(size=3)
    soft = lambda v: np.exp(v) / np.exp(v).sum()
    net = lambda w: (soft(y) * np.log(soft(x @ w))).sum()
    pairs = [(i, j) for i in range(7) for j in range(7) if y[i] > y[j]]
    rank = lambda w: -np.mean([np.log1p(np.exp(-(x[i] - x[j]) @ w)) for i, j in pairs])
    for f, g in ((net, learn.listnet_gradient), (rank, learn.ranknet_gradient)):
        steps = [(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(3)]
        assert np.allclose(steps, g(x, y, w), atol=1e-5)
    theta = rng.normal(size=5 * 2 + 1)
    score = lambda t: learn.network_scores(x, t, 2)[0]
    huber = lambda t: -np.mean([e * e / 2 if abs(e) <= 1 else abs(e) - 0.5 for e in y - 4 - score(t)])
    order = lambda t: -np.mean([np.log1p(np.exp(-(score(t)[i] - score(t)[j]))) for i, j in pairs])
    for f, loss in ((huber, "huber"), (order, "pairs")):
        steps = [(f(theta + 1e-6 * e) - f(theta - 1e-6 * e)) / 2e-6 for e in np.eye(len(theta))]
        assert np.allclose(steps, learn.network_gradient(x, y, theta, 2, loss), atol=1e-5)
    first, second = learn.lambdas(np.array([3.0, 1.0, 2.0]), np.zeros(3))
    assert abs(first.sum()) < 1e-12 and first[0] > 0 > first[1] and (second > 0).all()
    assert (learn.lambdas(np.ones(4), np.arange(4.0))[0] == 0).all()


def test_ranks_of_split_groups(spark):
    rows = [("hot", i % 50, f"i{i:04d}") for i in range(3000)] + [(k, 1, "x") for k in ("a", "b", None)]
    df = spark.createDataFrame(rows, "k string, v int, id string")
    a = {(r.k, r.id): r.p for r in ranking.ranked_split(df.repartition(6), ["k"], [F.desc("v"), "id"], "p").collect()}
    b = {(r.k, r.id): r.p for r in ranking.ranked(df, ["k"], [F.desc("v"), "id"], "p").collect()}
    assert a == b and ranking.ranked_split(df.limit(0), ["k"], ["v", "id"]).count() == 0


def test_case_and_words_of_all_scripts(spark):
    rows = [("Stra\u00dfe  FÜR\u00a0alle",), ("STRASSE für ALLE ",), (None,), ("",), ("ΟΔΟΣ und οδοσ",), ("ﬁne",)]
    df = spark.createDataFrame(rows, "t string").select(tx.canonical(F.col("t")).alias("c"), tx.tokens(F.col("t")).alias("w"), tx.tokens(F.col("t"), []).alias("all"), tx.tokens(F.col("t"), ["für"]).alias("less"))
    out = df.collect()
    assert out[0].c == out[1].c == "strasse für alle" and out[2].c is None and out[3].c == "" and out[5].c == "fine"
    assert out[0].w == ["straße", "für", "alle"] and out[2].w == out[3].w == [] and out[4].c == "οδοσ und οδοσ"
    assert out[1]["all"] == ["strasse", "für", "alle"] and out[1].less == ["strasse", "alle"]


def test_lexical_features_of_odd_texts(spark):
    q = spark.createDataFrame([("q1", "red kettle red"), ("q2", ""), ("q3", None)], "query_id string, query_text string")
    pairs = spark.createDataFrame([("q1", "a", "the red one"), ("q1", "b", None), ("q1", "c", "kettle red kettle"), ("q2", "a", "red"), ("q9", "a", "red")], "query_id string, comment_id string, t string")
    w = spark.createDataFrame([("red", 1.0), ("kettle", 3.0)], "term string, idf double")
    out = {(r.query_id, r.comment_id): (r.shared, r.overlap, r.rare) for r in tx.lexical_features(pairs, q, "t", "query_text", w).collect()}
    assert out == {("q1", "a"): (1, 0.25, 0), ("q1", "b"): (0, 0.0, 0), ("q1", "c"): (2, 1.0, 1), ("q2", "a"): (0, 0.0, 0), ("q9", "a"): (0, 0.0, 0)}
    assert tx.lexical_features(pairs.limit(0), q, "t", "query_text", w).count() == 0


def test_weights_of_draws_do_not_depend_on_the_number_of_units(spark):
    few, many = (spark.range(n).select(F.concat(F.lit("u"), F.col("id")).alias("u")) for n in (4096, 4097))
    a, b = ({(r.u, r.draw): r.weight for r in stats.weights(x, "u", 20).filter("weight > 0").collect()} for x in (few, many))
    assert {k: v for k, v in b.items() if k[0] != "u4096"} == a
    mean = sum(v for (_, d), v in a.items() if d > 0) / 4096 / 20
    assert abs(mean - 1) < 0.02 and all(a[f"u{i}", 0] == 1 for i in range(50))
    ratio = stats.bootstrap_ratio(spark.createDataFrame([(f"u{i}", float(i % 3), 2.0) for i in range(300)], "u string, a double, b double"), "u", "a", "b").first()
    assert ratio.units == 300 and abs(ratio.ratio - 0.5) < 1e-9 and ratio.low < 0.5 < ratio.high


def test_sparse_bm25_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"w{i % 5} w{i % 7} common word{i}") for i in range(60)] + [("n", None), (None, "w1")], "comment_id string, t string")
    q = spark.createDataFrame([(f"q{i}", f"w{i % 5} word{i}") for i in range(9)] + [("none", ""), (None, "w1")], "query_id string, q string")
    one = sorted(tx.bm25(docs, q, "comment_id", "t", "q", 6).collect())
    monkeypatch.setattr(tx, "ASKED", 2)
    assert sorted(tx.bm25(docs, q, "comment_id", "t", "q", 6).collect()) == one and {r.query_id for r in one} == {f"q{i}" for i in range(9)}
    assert all(r.comment_id == f"d{r.query_id[1:]}" for r in one if r.rank == 1)


def test_bm25_keeps_k_rows_a_query_and_task(spark, monkeypatch):
    random.seed(3)
    words = [f"w{i:02d}" for i in range(40)]
    docs = spark.createDataFrame([(f"c{i:03d}", " ".join(random.choices(words, k=6))) for i in range(300)] + [("none", None)], "comment_id string, t string").coalesce(1)
    q = spark.createDataFrame([(f"q{i}", " ".join(random.sample(words, 4))) for i in range(5)], "query_id string, q string")
    whole = sorted(tx.bm25(docs, q, "comment_id", "t", "q", 300).collect())
    monkeypatch.setattr(tx, "BM25_CELLS", 40)
    monkeypatch.setattr(ranking, "top_k", lambda found, *rest: found)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = tx.bm25(docs, q, "comment_id", "t", "q", 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.query_id, r.comment_id, round(r.score, 9)) for r in found) == sorted((r.query_id, r.comment_id, round(r.score, 9)) for r in whole if r["rank"] <= 4)


def both_ways(spark):
    """A random forest with a hub and one cycle, both ways, and seeds, some of them without edges."""
    random.seed(5)
    pairs = [(f"n{i:02d}", "hub" if i < 25 else f"n{random.randrange(i):02d}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x")]
    e = spark.createDataFrame([(a, b, w) for a, b in pairs for w in (1.0,)] + [(b, a, 1.0) for a, b in pairs], "src string, dst string, weight double")
    s = spark.createDataFrame([(f"q{q}", n, w) for q in range(7) for n, w in ((f"n{q * 3:02d}", 0.5), (f"n{59 - q:02d}", 1.0), ("x" if q % 2 else "alone", 0.7))], "query_id string, node string, weight double")
    return e, s


def test_pagerank_top_is_the_top_of_pagerank(spark, monkeypatch):
    e, s = both_ways(spark)
    whole = ranking.top_k(graph.pagerank(e, s, 0.5, 4), ["query_id"], [F.desc(F.round("score", 12)), "node"], 9).collect()
    for cells in (1 << 22, 200):
        monkeypatch.setattr(graph, "WALK_CELLS", cells)
        found = graph.pagerank_top(e, s, 9, 0.5, 4).collect()
        assert sorted((r.query_id, r["rank"], r.node, round(r.score, 9)) for r in found) == sorted((r.query_id, r["rank"], r.node, round(r.score, 9)) for r in whole)
    assert any(r.node == "alone" for r in found)


def test_best_of_pagerank_are_the_top_of_pagerank(spark, monkeypatch):
    e, s = both_ways(spark)
    rng = random.Random(5)
    made = {(f"a:{min(rng.randrange(90), rng.randrange(90), rng.randrange(90))}", f"t{min(rng.randrange(70), rng.randrange(70))}") for _ in range(500)}
    made |= {("a:0", f"t{i}") for i in range(300)} | {(f"a:{i}", "t0") for i in range(200)}
    edges = spark.createDataFrame([(x, y, 1.0) for a, t in made for x, y in ((a, t), (t, a))], "src string, dst string, weight double")
    asked = spark.createDataFrame([(f"q{i}", f"t{min(rng.randrange(300), rng.randrange(300), rng.choice([0, 300]))}", rng.random()) for i in range(150) for _ in range(1 + i % 3)], "query_id string, node string, weight double")
    for edges, asked, rounds in ((e, s, 4), (edges, asked, 2), (edges, asked, 3)):
        whole = ranking.top_k(graph.pagerank(edges, asked, 0.5, rounds), ["query_id"], [F.desc(F.round("score", 12)), "node"], 9).collect()
        expected = sorted((r.query_id, r["rank"], r.node, round(r.score, 9)) for r in whole)
        for cells in (1 << 22, 50):
            monkeypatch.setattr(graph, "KEPT_CELLS", cells, raising=False)
            found = ranking.top_k(graph.pagerank(edges, asked, 0.5, rounds, 5, 9), ["query_id"], [F.desc(F.round("score", 12)), "node"], 9).collect()
            assert sorted((r.query_id, r["rank"], r.node, round(r.score, 9)) for r in found) == expected
    assert graph.pagerank(edges, asked.limit(0), 0.5, 2, 5, 9).count() == 0


def test_seed_distances_copy_a_component_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """A star that all queries ask: its edges are shuffled as often as the cluster's cores allow, whatever the number of queries."""
    edges = spark.createDataFrame([("t", f"c{i:03d}") for i in range(100)], "src string, dst string")
    seeds = spark.createDataFrame([(f"q{i:03d}", f"c{i % 100:03d}", 1.0) for i in range(200)], "query_id string, node string, weight double")
    monkeypatch.setattr(graph, "WALK_CELLS", 100)  # 400 blocks of 200 edges without a bound
    monkeypatch.setattr(graph, "PIECE_ROWS", 50, raising=False)
    out = graph.seed_distances(edges, seeds)
    assert out.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 4
    found = {(r.query_id, r.node): (r.seeds, r.distance, r.weighted) for r in out.collect()}
    far = lambda q, n: 0 if n == f"c{q % 100:03d}" else 1 if n == "t" else 2
    names = ["t", *[f"c{i:03d}" for i in range(100)]]
    assert found == {(f"q{q:03d}", n): (1, far(q, n), 1 / (1 + far(q, n))) for q in range(200) for n in names}


def test_seed_distances_of_parts_that_meet_in_a_task(spark, monkeypatch):
    e, s = both_ways(spark)
    near: dict = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    expected: dict = {}
    for r in s.collect():
        distance = front = {r.node: 0}
        for hop in range(1, 4):
            front = {b: hop for a in front for b in near.get(a, ()) if b not in distance}
            distance = distance | front
        for node, n in distance.items():
            seeds, least, weighted = expected.get((r.query_id, node), (0, 9, 0.0))
            expected[r.query_id, node] = seeds + 1, min(least, n), weighted + r.weight / (1 + n)
    for cells in (1 << 22, 200):
        monkeypatch.setattr(graph, "WALK_CELLS", cells)
        found = {(r.query_id, r.node): (r.seeds, r.distance, round(r.weighted, 9)) for r in graph.seed_distances(e, s, 3).collect()}
        assert found == {k: (*v[:2], round(v[2], 9)) for k, v in expected.items()}
