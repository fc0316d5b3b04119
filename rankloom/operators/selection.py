"""Choosing fixed-size evidence sets: budgeted replacement, diversity, one-swap actions and oracles.

A query's candidates are a pool of bounded depth (tens of items), so sequential choices run per query in grouped pandas
functions; everything that has a closed form is a window expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked, top_k

PAIR = ["query_id", "comment_id"]


def budgeted_set(baseline: DataFrame, pool: DataFrame, scores: DataFrame, budget: int, k: int = 8, margin: float = 1e-12) -> DataFrame:
    """(query_id, comment_id, source, score): the k-set of largest total score with at most `budget` items from outside
    the baseline.

    The best set swaps the t-th best outsider for the t-th worst baseline item as long as it scores more, so pairing the
    two lists by place decides every swap at once. baseline, pool: (query_id, comment_id); scores add (score). Items
    without a score have the lowest; ties go to the smaller id, and equal scores change nothing.
    """
    value = F.coalesce("score", F.lit(float("-inf")))
    base = baseline.select(*PAIR).distinct().join(scores.select(*PAIR, "score"), PAIR, "left").withColumn("score", value)
    outside = pool.select(*PAIR).distinct().join(base.select(*PAIR), PAIR, "left_anti").join(scores.select(*PAIR, "score"), PAIR)
    worst = ranked(base, ["query_id"], ["score", F.desc("comment_id")], "t")
    best = top_k(outside, ["query_id"], [F.desc("score"), "comment_id"], min(budget, k), "t") if budget > 0 else outside.limit(0).withColumn("t", F.lit(1))
    best = best.select("query_id", "t", F.col("comment_id").alias("new"), F.col("score").alias("new_score"))
    paired = worst.join(best, ["query_id", "t"], "left")
    swap = F.col("new_score") > F.col("score") + margin
    return paired.select("query_id", F.when(swap, F.col("new")).otherwise(F.col("comment_id")).alias("comment_id"), F.when(swap, "pool").otherwise("baseline").alias("source"), F.when(swap, F.col("new_score")).otherwise(F.col("score")).alias("score"))


def replacements(selected: DataFrame, baseline: DataFrame, utility: DataFrame) -> DataFrame:
    """(query_id, slot, entered, removed, contribution): entrants and removed items paired by place, and what each pair
    adds to the mean utility of 8; contributions of a query sum to its gain."""
    entered = ranked(selected.select(*PAIR).join(baseline.select(*PAIR), PAIR, "left_anti").join(utility.select(*PAIR, "utility"), PAIR, "left"), ["query_id"], [F.desc_nulls_last("utility"), "comment_id"], "slot")
    removed = ranked(baseline.select(*PAIR).join(selected.select(*PAIR), PAIR, "left_anti").join(utility.select(*PAIR, "utility"), PAIR, "left"), ["query_id"], [F.desc_nulls_last("utility"), "comment_id"], "slot")
    a = entered.select("query_id", "slot", F.col("comment_id").alias("entered"), F.col("utility").alias("ue"))
    b = removed.select("query_id", "slot", F.col("comment_id").alias("removed"), F.col("utility").alias("ur"))
    return a.join(b, ["query_id", "slot"]).select("query_id", "slot", "entered", "removed", ((F.col("ue") - F.col("ur")) / 8).alias("contribution"))


def one_swap_actions(baseline: DataFrame, candidates: DataFrame, utility: DataFrame) -> DataFrame:
    """(query_id, action_id, candidate_id, replaced_id, reward): every swap of a candidate for a baseline item, and doing
    nothing (NOOP, reward 0). The reward is the change of the mean utility of 8; null where one is unjudged.

    Candidates are a few per query and the baseline has eight items, so actions are in proportion to the candidates.
    """
    u = utility.select(*PAIR, "utility")
    b = baseline.select(*PAIR, "rank").join(u, PAIR, "left").select("query_id", F.col("comment_id").alias("replaced_id"), F.col("utility").alias("ub"))
    c = candidates.select(*PAIR).distinct().join(baseline.select(*PAIR), PAIR, "left_anti").join(u, PAIR, "left").select("query_id", F.col("comment_id").alias("candidate_id"), F.col("utility").alias("uc"))
    swaps = c.join(b, "query_id").select("query_id", F.concat_ws(">", "replaced_id", "candidate_id").alias("action_id"), "candidate_id", "replaced_id", ((F.col("uc") - F.col("ub")) / 8).alias("reward"))
    none = F.lit(None).cast("string")
    noop = baseline.select("query_id").distinct().select("query_id", F.lit("NOOP").alias("action_id"), none.alias("candidate_id"), none.alias("replaced_id"), F.lit(0.0).alias("reward"))
    return swaps.unionByName(noop)


def best_action(actions: DataFrame, score: str, threshold: float = 0.0) -> DataFrame:
    """The action with the largest (score, action_id) of each query, if its score beats NOOP's by more than the
    threshold; else NOOP. Null scores never win."""
    best = actions.filter(F.col(score).isNotNull() & (F.col("action_id") != "NOOP")).groupBy("query_id").agg(F.max(F.struct(F.col(score).alias("s"), "action_id", "candidate_id", "replaced_id", "reward")).alias("b"))
    noop = actions.filter(F.col("action_id") == "NOOP").select("query_id", F.coalesce(score, F.lit(0.0)).alias("n"))
    act = (F.col("b.s") - F.col("n")) > threshold
    pick = lambda f, other: F.when(act, F.col(f"b.{f}")).otherwise(other).alias(f)
    return noop.join(best, "query_id", "left").select("query_id", pick("action_id", F.lit("NOOP")), pick("reward", F.lit(0.0)), F.coalesce(F.col("b.s") - F.col("n"), F.lit(0.0)).alias("margin"))


def apply_swap(ids: Column, replaced: Column, candidate: Column) -> Column:
    """The list with one item replaced in place; unchanged where `replaced` is null."""
    return F.when(replaced.isNull(), ids).otherwise(F.transform(ids, lambda x: F.when(x == replaced, candidate).otherwise(x)))


def threshold_report(margins: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, mean_reward, standard_error, guarded, action_rate, harm_rate) over queries with (margin, reward)."""
    steps = F.broadcast(margins.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    act = F.col("margin") > F.col("threshold")
    each = margins.crossJoin(steps).withColumn("r", F.when(act, F.col("reward")).otherwise(0.0))
    mean, error = F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))
    return each.groupBy("threshold").agg(mean.alias("mean_reward"), error.alias("standard_error"), (mean - 0.5 * error).alias("guarded"), F.avg(act.cast("double")).alias("action_rate"), F.avg((act & (F.col("reward") < 0)).cast("double")).alias("harm_rate"))


def downside_weighted(reward: Column, kappa: float) -> Column:
    return F.when(reward >= 0, reward).otherwise(kappa * reward)


def candidate_quality(score: Column) -> Column:
    """A utility of 1 to 7 as 0 to 1; null for null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 1) / 6)))


def mmr(pool: DataFrame, lam: float, k: int = 8, budget: int | None = None) -> DataFrame:
    """(query_id, comment_id, pick): greedy choice by (1 - lam) * quality - lam * largest similarity to those chosen.

    pool: (query_id, comment_id, quality, vec, in_baseline), a query's candidates. At most `budget` items from outside
    the baseline (None: any number). Ties go to quality, then the baseline, then the smaller id; lam = 0 is the order of
    quality. Null vectors are similar to nothing, null quality counts as 0; repeated ids count once.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("comment_id").sort_values("comment_id").reset_index(drop=True)
        q = g["quality"].fillna(0.0).to_numpy(dtype=float)
        width = max([len(v) for v in g["vec"] if v is not None], default=1)
        v = np.array([np.zeros(width) if x is None else np.asarray(x, dtype=float) for x in g["vec"]])
        inside = g["in_baseline"].fillna(False).to_numpy(dtype=bool)
        ids = g["comment_id"].tolist()
        left, chosen, used = set(range(len(g))), [], 0
        near = np.zeros(len(g))
        while left and len(chosen) < k:
            open_ = [i for i in left if inside[i] or budget is None or used < budget]
            if not open_:
                break
            i = min(open_, key=lambda i: (-round((1 - lam) * q[i] - lam * near[i], 12), -q[i], not inside[i], ids[i]))
            chosen.append(i)
            left.discard(i)
            used += not inside[i]
            near = np.maximum(near, v @ v[i]) if len(chosen) > 1 else v @ v[i]
        return pd.DataFrame({"query_id": g["query_id"].iloc[chosen].to_numpy(), "comment_id": [ids[i] for i in chosen], "pick": range(1, len(chosen) + 1)})

    kinds = dict(pool.dtypes)
    return pool.select("query_id", "comment_id", "quality", "vec", "in_baseline").groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, pick int")


def sequential(pool: DataFrame, protected: int, weight: float, k: int = 8) -> DataFrame:
    """(query_id, comment_id, pick): the first `protected` items by rank, then greedily by score - weight * largest
    token overlap (Jaccard) with those chosen; ties go to the smaller id. pool: (query_id, comment_id, rank, score, tokens)."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("comment_id").sort_values(["rank", "comment_id"]).reset_index(drop=True)
        sets = [frozenset(t) if t is not None else frozenset() for t in g["tokens"]]
        score = g["score"].fillna(-1e9).to_numpy(dtype=float)
        ids = g["comment_id"].tolist()
        chosen = list(range(min(protected, len(g), k)))
        left = set(range(len(g))) - set(chosen)
        overlap = lambda a, b: len(a & b) / max(1, len(a | b))
        while left and len(chosen) < k:
            i = min(left, key=lambda i: (-round(score[i] - weight * max([overlap(sets[i], sets[j]) for j in chosen], default=0.0), 12), ids[i]))
            chosen.append(i)
            left.discard(i)
        return pd.DataFrame({"query_id": g["query_id"].iloc[chosen].to_numpy(), "comment_id": [ids[i] for i in chosen], "pick": range(1, len(chosen) + 1)})

    kinds = dict(pool.dtypes)
    return pool.select("query_id", "comment_id", "rank", "score", "tokens").groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, pick int")


def intra_list_distance(chosen: DataFrame) -> DataFrame:
    """(query_id, ild): 1 - mean cosine over pairs of a chosen set (query_id, comment_id, vec); 0 for fewer than two."""
    from rankloom.functions.vectors import cosine

    a = chosen.select("query_id", F.col("comment_id").alias("a"), F.col("vec").alias("va"))
    b = chosen.select("query_id", F.col("comment_id").alias("b"), F.col("vec").alias("vb"))
    pairs = a.join(b, "query_id").filter("a < b").groupBy("query_id").agg((1 - F.avg(cosine(F.col("va"), F.col("vb")))).alias("d"))
    return chosen.select("query_id").distinct().join(pairs, "query_id", "left").select("query_id", F.coalesce("d", F.lit(0.0)).alias("ild"))


def decomposition(oracle_base: str, oracle_pool: str, oracle_feasible: str, learned: str) -> dict[str, Column]:
    """Parts of a pool's headroom as columns: access (pool over baseline), what the action space loses of it, what is
    feasible, and what learning loses of that; access = action loss + learning loss + gain."""
    b, p, f, s = (F.col(c) for c in (oracle_base, oracle_pool, oracle_feasible, learned))
    return {"access": p - b, "action_loss": p - f, "feasible": f - b, "learning_loss": f - s, "gain": s - b}


