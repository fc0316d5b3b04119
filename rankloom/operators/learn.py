"""Scorers for ranking: pair sets, standardisation, linear, logistic, isotonic and boosted fits, grouped validation.

Fits run in MLlib or by gradients summed in Spark over all rows, without gathering them. LambdaMART is boosted from
MLlib's regression trees; RankNet and ListNet are fitted as linear orders instead of networks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import cut


def query_weights(df: DataFrame, query: str = "query_id") -> DataFrame:
    """weight = 1 / (number of queries * rows of the query), rescaled to a mean of 1."""
    sizes = df.groupBy(query).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.count(F.lit(1)).alias("__q"), F.sum("__n").alias("__t"))
    return df.join(sizes, query).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__t") / (F.col("__q") * F.col("__n"))).drop("__n", "__q", "__t")


def standardized(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """`rows` with features centred and divided by the population deviation of the training rows; constant ones are 0.
    Nulls and NaN count as the training mean."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    stats = train.agg(*[F.avg(known(c)).alias(f"__m_{c}") for c in features], *[F.stddev_pop(known(c)).alias(f"__s_{c}") for c in features])
    out = rows.crossJoin(F.broadcast(stats))
    for c in features:
        m, s = F.coalesce(f"__m_{c}", F.lit(0.0)), F.col(f"__s_{c}")
        out = out.withColumn(c, F.when(s > 1e-12, (F.coalesce(known(c), m) - m) / s).otherwise(F.lit(0.0)))
    return out.drop(*[f"__{k}_{c}" for k in "ms" for c in features])


def pair_differences(df: DataFrame, features: list[str], utility: str, margin: float = 1.0, most: int | None = None, seed: int = 7) -> DataFrame:
    """(query_id, features as differences, label, weight): pairs of a query whose utilities differ by the margin, and their
    mirror images; at most `most` pairs per query in seeded order (a documented bound of the training sample)."""
    side = lambda s: df.filter(F.col(utility).isNotNull()).select("query_id", F.col("comment_id").alias(f"id_{s}"), F.col(utility).alias(f"u_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in features])
    pairs = side("a").join(side("b"), "query_id").filter(F.col("u_a") - F.col("u_b") >= margin)
    if most is not None:
        from .ranking import top_k

        pairs = top_k(pairs.withColumn("__o", F.md5(F.concat_ws("#", "id_a", "id_b", F.lit(str(seed))))), ["query_id"], ["__o"], most, "__p").drop("__o", "__p")
    diff = [(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in features]
    ahead = pairs.select("query_id", *diff, F.lit(1.0).alias("label"))
    back = ahead.select("query_id", *[(-F.col(c)).alias(c) for c in features], F.lit(0.0).alias("label"))
    return query_weights(ahead.unionByName(back))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


#: name -> estimator over (features, label, weight); the prediction column is "prediction".
POINTWISE: dict[str, Callable] = {
    "huber": lambda: LinearRegression(loss="huber", weightCol="weight", maxIter=50),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0, weightCol="weight"),
    "elastic_net": lambda: LinearRegression(regParam=0.05, elasticNetParam=0.5, weightCol="weight"),
    "gbt_pointwise": lambda: GBTRegressor(maxIter=20, maxDepth=4, weightCol="weight", seed=7),
    "random_forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=6, weightCol="weight", seed=7),
}


def fit_pointwise(train: DataFrame, rows: DataFrame, features: list[str], utility: str, family: str) -> DataFrame:
    """The rows' keys with score: a regression of utility, fitted on the judged training rows and cut to 1 to 7."""
    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    data = cut(query_weights(standardized(judged, judged, features).withColumn("label", F.col(utility).cast("double"))))
    model = POINTWISE[family]().fit(assembled(data, features))
    scored = model.transform(assembled(standardized(judged, rows, features), features))
    return scored.select("query_id", "comment_id", F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.col("prediction"))).alias("score"))


def fit_pairwise(train: DataFrame, rows: DataFrame, features: list[str], utility: str, family: str = "logistic", margin: float = 1.0, most: int = 400) -> DataFrame:
    """The rows' keys with score: a linear order fitted on differences of pairs, without intercept."""
    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    pairs = assembled(cut(pair_differences(standardized(judged, judged, features), features, utility, margin, most)), features)
    kind = LogisticRegression(fitIntercept=False, weightCol="weight", regParam=0.01, maxIter=30) if family == "logistic" else LinearSVC(fitIntercept=False, weightCol="weight", regParam=0.01, maxIter=30)
    weights = kind.fit(pairs).coefficients.toArray().tolist()
    score = sum((F.col(c) * w for c, w in zip(features, weights)), F.lit(0.0))
    return standardized(judged, rows, features).select("query_id", "comment_id", score.alias("score"))


def _lists(train: DataFrame, features: list[str], utility: str) -> DataFrame:
    """(query_id, x, y): of each query the features and utilities of its judged training rows, whose number is a pool's depth."""
    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    rows = standardized(judged, judged, features).select("query_id", F.struct(F.array(*features).alias("x"), F.col(utility).cast("double").alias("y")).alias("r"))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("r")).filter(F.size("r") > 1)
    return cut(lists.select("query_id", F.col("r.x").alias("x"), F.col("r.y").alias("y")))


def listnet_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of a query's cross entropy between the softmax of utilities and that of scores."""
    soft = lambda v: (lambda e: e / e.sum())(np.exp(v - v.max()))
    return x.T @ (soft(y) - soft(x @ w))


def ranknet_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the mean logistic loss over the query's pairs of different utility."""
    s, better = x @ w, y[:, None] > y[None, :]
    miss = better / (1 + np.exp(np.clip(s[:, None] - s[None, :], -30, 30)))
    return x.T @ (miss.sum(axis=1) - miss.sum(axis=0)) / max(1, better.sum())


def fit_listwise(train: DataFrame, rows: DataFrame, features: list[str], utility: str, family: str = "listnet", rounds: int = 25, rate: float = 0.5, ridge: float = 0.01) -> DataFrame:
    """The rows' keys with score: a linear order by gradient steps, each a sum over queries of which only one number per
    feature and task reaches the driver. Queries count alike; without judged lists of two rows all scores are 0."""
    lists, of = _lists(train, features, utility), {"listnet": listnet_gradient, "ranknet": ranknet_gradient}[family]
    w, square = np.zeros(len(features)), np.full(len(features), 1e-8)
    for _ in range(rounds):

        def step(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(w)), 0
            for b in batches:
                for x, y in zip(b["x"], b["y"]):
                    total += of(np.array(list(x), dtype=float), np.asarray(y, dtype=float), w)
                    n += 1
            yield pd.DataFrame({"g": [total.tolist()], "n": [n]})

        parts = lists.mapInPandas(step, "g array<double>, n long").collect()
        n = sum(r["n"] for r in parts)
        if not n:
            break
        g = np.sum([r["g"] for r in parts], axis=0) / n - ridge * w
        square += g * g
        w = w + rate * g / np.sqrt(square)
    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    score = sum((F.col(c) * float(v) for c, v in zip(features, w)), F.lit(0.0))
    return standardized(judged, rows, features).select("query_id", "comment_id", score.alias("score"))


def network_scores(x: np.ndarray, theta: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and hidden values of one layer of tanh units; theta holds its weights, biases, and the last layer's."""
    f = x.shape[1]
    w, b, v = theta[: f * hidden].reshape(f, hidden), theta[f * hidden : (f + 1) * hidden], theta[(f + 1) * hidden :]
    h = np.tanh(x @ w + b)
    return h @ v[:hidden] + v[hidden], h


def network_gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, hidden: int, loss: str) -> np.ndarray:
    """Downhill direction of a query's mean loss: "huber" of utilities as they are, or "pairs" as `ranknet_gradient`."""
    s, h = network_scores(x, theta, hidden)
    if loss == "pairs":
        better = y[:, None] > y[None, :]
        miss = better / (1 + np.exp(np.clip(s[:, None] - s[None, :], -30, 30)))
        pull = (miss.sum(axis=1) - miss.sum(axis=0)) / max(1, better.sum())
    else:
        pull = np.clip(y - 4 - s, -1, 1) / len(y)
    f = x.shape[1]
    back = (pull[:, None] * theta[(f + 1) * hidden : -1][None, :]) * (1 - h * h)
    return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ pull, [pull.sum()]])


def fit_network(train: DataFrame, rows: DataFrame, features: list[str], utility: str, loss: str = "huber", hidden: int = 8, rounds: int = 30, rate: float = 0.1, seed: int = 7) -> DataFrame:
    """The rows' keys with score, of a network of one hidden layer: cut to 1 to 7 for "huber", an order for "pairs".

    Fitted as `fit_listwise`: each step sums gradients over the queries in the tasks.
    """
    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    lists, n = _lists(train, features, utility), len(features)
    theta = np.random.default_rng(seed).normal(scale=0.5, size=(n + 2) * hidden + 1)
    theta[-1] = 0.0
    square = np.full(len(theta), 1e-8)
    for _ in range(rounds):

        def step(batches: Iterator[pd.DataFrame], theta=theta) -> Iterator[pd.DataFrame]:
            total, k = np.zeros(len(theta)), 0
            for b in batches:
                for x, y in zip(b["x"], b["y"]):
                    total += network_gradient(np.array(list(x), dtype=float), np.asarray(y, dtype=float), theta, hidden, loss)
                    k += 1
            yield pd.DataFrame({"g": [total.tolist()], "n": [k]})

        parts = lists.mapInPandas(step, "g array<double>, n long").collect()
        if not (k := sum(r["n"] for r in parts)):
            break
        g = np.sum([r["g"] for r in parts], axis=0) / k - 1e-3 * theta
        square += g * g
        theta = theta + rate * g / np.sqrt(square)
    asked = standardized(judged, rows, features).select("query_id", "comment_id", F.array(*features).alias("x"))
    kinds = dict(asked.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = network_scores(np.array(list(b["x"]), dtype=float).reshape(-1, n), theta, hidden)[0]
            yield pd.DataFrame({"query_id": b["query_id"], "comment_id": b["comment_id"], "score": np.clip(s + 4, 1, 7) if loss == "huber" else s})

    return asked.mapInPandas(score, f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, score double")


def lambdas(y: np.ndarray, s: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(first, second derivative) of each item: over the query's pairs what swapping them changes of nDCG, by how wrongly
    their scores order them."""
    gain = 2.0 ** np.maximum(y, 0) - 1
    place = np.empty(len(s))
    place[np.argsort(-s, kind="stable")] = np.arange(1, len(s) + 1)
    ideal = (np.sort(gain)[::-1][:k] / np.log2(np.arange(2, min(k, len(y)) + 2))).sum()
    d = 1 / np.log2(place + 1)
    change = np.abs((gain[:, None] - gain[None, :]) * (d[:, None] - d[None, :])) / max(ideal, 1e-12)
    rho = np.where(y[:, None] > y[None, :], 1 / (1 + np.exp(np.clip(s[:, None] - s[None, :], -30, 30))), 0.0)
    push, curve = rho * change, rho * (1 - rho) * change
    return push.sum(axis=1) - push.sum(axis=0), curve.sum(axis=1) + curve.sum(axis=0)


def fit_lambdamart(train: DataFrame, rows: DataFrame, features: list[str], utility: str, rounds: int = 6, depth: int = 3, rate: float = 0.3) -> DataFrame:
    """The rows' keys with score: regression trees of MLlib fitted one after the other to Newton steps of nDCG.

    Derivatives come from the pairs within a query's judged rows, a pool of bounded depth, in a grouped pandas function;
    trees are fitted over all rows. Null features count as the training mean.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    data = assembled(standardized(judged, judged, features).select("query_id", "comment_id", *features, F.col(utility).cast("double").alias("y")), features).select("query_id", "comment_id", "features", "y")
    asked = assembled(standardized(judged, rows, features), features).select("query_id", "comment_id", "features")
    kinds = dict(data.dtypes)
    schema = f"query_id {kinds['query_id']}, comment_id {kinds['comment_id']}, step double, weight double"

    def newton(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("comment_id")
        first, second = lambdas(g["y"].to_numpy(), g["score"].to_numpy())
        weight = np.maximum(second, 1e-6)
        return pd.DataFrame({"query_id": g["query_id"], "comment_id": g["comment_id"], "step": first / weight, "weight": weight})

    data, asked = cut(data.withColumn("score", F.lit(0.0))), asked.withColumn("score", F.lit(0.0))
    if not data.head(1):
        return asked.select("query_id", "comment_id", "score")
    for _ in range(rounds):
        steps = data.select("query_id", "comment_id", "y", "score").groupBy("query_id").applyInPandas(newton, schema)
        tree = DecisionTreeRegressor(maxDepth=depth, labelCol="step", weightCol="weight", minInstancesPerNode=5, seed=7).fit(cut(data.join(steps, ["query_id", "comment_id"])))
        add = lambda df: tree.transform(df).withColumn("score", F.col("score") + rate * F.col("prediction")).drop("prediction")  # noqa: E731, B023
        data, asked = cut(add(data)), add(asked)
    return asked.select("query_id", "comment_id", "score")


def useful_probability(train: DataFrame, rows: DataFrame, features: list[str], utility: str, least: float = 4.0) -> DataFrame:
    """score = 1 + 6 * probability that the utility is at least `least`."""
    from pyspark.ml.functions import vector_to_array

    judged = train.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    data = cut(query_weights(standardized(judged, judged, features).withColumn("label", (F.col(utility) >= least).cast("double"))))
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(assembled(data, features))
    scored = model.transform(assembled(standardized(judged, rows, features), features))
    return scored.select("query_id", "comment_id", (1 + 6 * vector_to_array("probability")[1]).alias("score"))


def calibrated(train: DataFrame, rows: DataFrame, utility: str) -> DataFrame:
    """Isotonic calibration of `score` to utility, fitted on the judged training rows."""
    judged = train.filter(F.col(utility).isNotNull()).select(F.col("score").alias("features"), F.col(utility).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(judged)
    return model.transform(rows.withColumn("features", F.col("score"))).select("query_id", "comment_id", F.col("prediction").alias("score"))


def out_of_fold(rows: DataFrame, folds: DataFrame, n: int, fit: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(query_id, comment_id, score): each query scored by the fits that did not see it, means over repeats."""
    placed = cut(rows.join(folds, "query_id"))
    parts = None
    for repeat in [r[0] for r in folds.select("repeat").distinct().orderBy("repeat").collect()]:
        for fold in range(n):
            here = placed.filter(F.col("repeat") == repeat)
            part = fit(here.filter(F.col("fold") != fold), here.filter(F.col("fold") == fold))
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "comment_id").agg(F.avg("score").alias("score"))


def one_standard_error(results: DataFrame, setting: str, value: str, unit: str, conservative: str = "low") -> DataFrame:
    """One row (setting, mean): the lowest (or highest) setting whose mean over units is within one standard error of the
    paired differences to the best one."""
    means = results.groupBy(setting).agg(F.avg(value).alias("mean"))
    best = means.orderBy(F.desc("mean"), setting).limit(1).select(F.col(setting).alias("best"), F.col("mean").alias("top"))
    at_best = results.join(F.broadcast(best), results[setting] == best.best).select(unit, F.col(value).alias("vb"))
    gaps = results.join(at_best, unit).groupBy(setting).agg((F.stddev_samp(F.col("vb") - F.col(value)) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg(F.col("vb") - F.col(value)).alias("gap"))
    near = gaps.filter(F.col("gap") <= F.coalesce("se", F.lit(0.0))).join(means, setting)
    return near.orderBy(F.asc(setting) if conservative == "low" else F.desc(setting)).limit(1).select(setting, "mean")


def modal(results: DataFrame, by: list[str], setting: str) -> DataFrame:
    """(by, setting, n): the most frequent setting, the smaller on ties."""
    counts = results.groupBy(*by, setting).agg(F.count(F.lit(1)).alias("n"))
    from .ranking import top_k

    return top_k(counts, by, [F.desc("n"), setting], 1, "__p").drop("__p")


def centred(value: str, query: str = "query_id"):
    return F.col(value) - F.avg(value).over(W.partitionBy(query))
