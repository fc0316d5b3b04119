"""Paired comparisons, correlations, bootstrap intervals and agreement.

Resampling gives every unit its own weight in every draw, from a digest of unit, seed and draw: the same at every size, on
any partitions, and without gathering units anywhere. Only sums by draw are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.base import lookup_skewed

from .ranking import average_rank, ranked_split

#: 65536 times the chance that a Poisson count of mean 1 is at most 0, 1, ... 8.
POISSON = (24109, 48219, 60274, 64292, 65296, 65497, 65531, 65535, 65536)


def _drawn(units: DataFrame, unit: str, draws: int, seed: int, digits: int) -> DataFrame:
    """A row of each unit for each draw from 1 in `__draw`, with the `digits` hex digits of that draw in `__x`; and one of
    draw 0 without any, which stands for the sample itself. A digest of 64 hex digits serves 64 / digits draws."""
    many = 64 // digits
    digest = F.sha2(F.concat_ws("#", F.col(unit).cast("string"), F.lit(str(seed)), F.col("__block").cast("string")), 256)
    rows = units.withColumn("__block", F.explode(F.sequence(F.lit(-1), F.lit(-(-draws // many) - 1)))).withColumn("__h", digest)
    rows = rows.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).withColumn("__draw", F.col("__block") * many + F.col("__j") + 1)
    return rows.filter(F.col("__draw").between(0, draws)).withColumn("__x", F.when(F.col("__draw") > 0, F.substring("__h", F.col("__j") * digits + 1, F.lit(digits)))).drop("__block", "__h", "__j")


def weights(units: DataFrame, unit: str, draws: int, seed: int = 7) -> DataFrame:
    """The units in every draw from 1 with how often each counts in it (Poisson of mean 1), and in draw 0, the sample, once:
    a plan of resampling that all statistics of the same units, draws and seed share."""
    number = F.conv("__x", 16, 10).cast("int")
    times = F.lit(len(POISSON))
    for k, top in reversed(list(enumerate(POISSON))):
        times = F.when(number < top, F.lit(k)).otherwise(times)
    return _drawn(units, unit, draws, seed, 4).withColumn("weight", F.when(F.col("__draw") == 0, 1).otherwise(times)).withColumnRenamed("__draw", "draw").drop("__x")


def bootstrap_ratio(df: DataFrame, unit: str, numerator: str, denominator: str, draws: int = 1000, seed: int = 7, share: float = 0.95) -> DataFrame:
    """One row (units, ratio, low, high): the ratio of sums over units with its percentile interval. Draws whose denominator
    is about 0 are left out. The table has one row per unit."""
    sums = weights(df.select(unit, numerator, denominator), unit, draws, seed).filter("weight > 0").groupBy("draw").agg(
        F.sum("weight").cast("bigint").alias("n"), F.sum(F.col("weight") * F.col(numerator)).alias("a"), F.sum(F.col("weight") * F.col(denominator)).alias("b")
    )
    r = sums.filter(F.abs("b") > 1e-12).withColumn("r", F.round(F.col("a") / F.col("b"), 12))
    sampled, own = F.when(F.col("draw") > 0, F.col("r")), lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    return r.agg(own("n").alias("units"), own("r").alias("ratio"), F.percentile(sampled, (1 - share) / 2).alias("low"), F.percentile(sampled, (1 + share) / 2).alias("high"))


def bootstrap_mean(df: DataFrame, unit: str, value: str, by: list[str], draws: int = 2000, seed: int = 7, interval: str = "linear", share: float = 0.95) -> DataFrame:
    """(by, n, mean, low, high): percentile interval of the mean over resampled units, nulls left out.

    A unit counts a Poisson number of times of mean 1 in each draw; draws in which no unit counts are left out.
    interval: "linear" interpolates quantiles, "index" takes the sorted means at int(a * draws). The same seed, units and
    values give the same interval, whatever the partitions; means are rounded to 12 digits, as sums depend on their order.
    """
    units = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(unit).alias("__u")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(value).cast("double")).alias("__s"))
    drawn = weights(units, "__u", draws, seed).withColumnsRenamed({"draw": "__draw", "weight": "__w"}).filter("__w > 0")
    sums = drawn.groupBy(*by, "__draw").agg(F.sum(F.col("__w") * F.col("__n")).alias("__n"), F.round(F.sum(F.col("__w") * F.col("__s")) / F.sum(F.col("__w") * F.col("__n")), 12).alias("__m"))
    a, sampled, own = (1 - share) / 2, F.when(F.col("__draw") > 0, F.col("__m")), lambda c: F.max(F.when(F.col("__draw") == 0, F.col(c)))
    if interval == "index":
        means = F.array_sort(F.collect_list(sampled))
        low, high = F.get(means, F.lit(int(a * draws))), F.get(means, F.least(F.lit(int((1 - a) * draws)), F.size(means) - 1))
    else:
        low, high = F.percentile(sampled, a), F.percentile(sampled, 1 - a)
    return sums.groupBy(*by).agg(own("__n").alias("n"), own("__m").alias("mean"), low.alias("low"), high.alias("high")).filter("n IS NOT NULL")


def sign_flip(df: DataFrame, unit: str, value: str, by: list[str] | None = None, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """(by, n, mean, p): two-sided randomisation p of a mean difference of 0, signs of units flipped at random; no rows
    without values. The observed sum counts as one of the draws."""
    by = by or []
    units = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(unit).alias("__u")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(value).cast("double")).alias("__s"))
    sign = F.when(F.col("__draw") == 0, 1).when(F.col("__x") >= "8", 1).otherwise(-1)
    sums = _drawn(units, "__u", draws, seed, 1).groupBy(*by, "__draw").agg(F.sum("__n").alias("__n"), F.sum(sign * F.col("__s")).alias("__t"))
    total = F.max(F.when(F.col("__draw") == 0, F.col("__t")))
    sums = sums.groupBy(*by).agg(F.max("__n").alias("n"), total.alias("__seen"), F.collect_list(F.when(F.col("__draw") > 0, F.col("__t"))).alias("__all")).filter("n IS NOT NULL")
    beyond = F.size(F.filter("__all", lambda t: F.abs(t) >= F.abs(F.col("__seen")) - 1e-9))
    return sums.select(*by, "n", (F.col("__seen") / F.col("n")).alias("mean"), ((beyond + 1) / F.lit(draws + 1.0)).alias("p"))


def sign_flip_p(df: DataFrame, unit: str, value: str, draws: int = 10_000, seed: int = 7) -> float | None:
    """The p of `sign_flip`; null without rows."""
    row = sign_flip(df, unit, value, None, draws, seed).first()
    return row["p"] if row else None


def paired(df: DataFrame, system: str, left: str, right: str, value: str, unit: str = "query_id", by: list[str] | None = None) -> DataFrame:
    """(by, unit, left, right, delta): both systems' means of each unit side by side; units without both are left out."""
    by = by or []
    sides = df.filter(F.col(system).isin(left, right) & F.col(value).isNotNull()).groupBy(*by, unit).agg(
        F.avg(F.when(F.col(system) == left, F.col(value))).alias("left"), F.avg(F.when(F.col(system) == right, F.col(value))).alias("right")
    )
    return sides.filter("left IS NOT NULL AND right IS NOT NULL").withColumn("delta", F.col("left") - F.col("right"))


def win_tie_loss(deltas: DataFrame, by: list[str], delta: str = "delta", tolerance: float = 1e-12) -> DataFrame:
    """(by, n, wins, ties, losses, mean_delta, median_delta, effect): effect is the mean over the sample deviation."""
    d = F.col(delta)
    return deltas.groupBy(*by).agg(
        F.count(d).alias("n"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"),
        F.avg(d).alias("mean_delta"), F.percentile(d, 0.5).alias("median_delta"), F.when(F.stddev_samp(d) > 0, F.avg(d) / F.stddev_samp(d)).alias("effect"),
    )


def verdict(low: Column, high: Column) -> Column:
    """better if the interval lies above 0, worse if below, else open; null bounds give null."""
    return F.when(low > 0, "better").when(high < 0, "worse").when(low.isNotNull() & high.isNotNull(), "open")


def sufficient(df: DataFrame, x: str, y: str, z: str, unit: str = "query_id", ranks: bool = False) -> DataFrame:
    """(unit, n, xx, yy, zz, xy, xz, yz): sums of products of values centred within the unit (or of average ranks).

    Units with fewer than 3 rows or fewer than 2 different values of x or y are left out.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    w = W.partitionBy(unit)
    value = (lambda c: average_rank(F.col(c), [unit])) if ranks else (lambda c: F.col(c).cast("double"))
    rows = rows.select(unit, value(x).alias("vx"), value(y).alias("vy"), value(z).alias("vz"))
    rows = rows.select(unit, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("vx", "vy", "vz")])
    sums = [F.sum(F.col(f"v{a}") * F.col(f"v{b}")).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *sums).filter("n >= 3 AND xx > 1e-12 AND yy > 1e-12")


def pooled_correlations(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, units, n, r, partial_r): pooled within-unit correlation, and that with z held fixed."""
    t = sums.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    c = F.col
    r = F.when((c("xx") > 0) & (c("yy") > 0), c("xy") / F.sqrt(c("xx") * c("yy")))
    above, bx, by_ = c("xy") * c("zz") - c("xz") * c("yz"), c("xx") * c("zz") - c("xz") ** 2, c("yy") * c("zz") - c("yz") ** 2
    return t.select(*(by or []), "units", "n", r.alias("r"), F.when((bx > 0) & (by_ > 0), above / F.sqrt(bx * by_)).alias("partial_r"))


def deciles(df: DataFrame, x: str, y: str, unit: str = "query_id", parts: int = 10) -> DataFrame:
    """(part, units, mean): y by parts of x's place within the unit, first as a mean of each unit, then over units."""
    w = W.partitionBy(unit).orderBy(x, "comment_id")
    n = F.count(F.lit(1)).over(W.partitionBy(unit))
    part = F.floor((F.row_number().over(w) - 0.5) / n * parts).cast("int")
    per = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("part", part).groupBy(unit, "part").agg(F.avg(y).alias("m"))
    return per.groupBy("part").agg(F.count(F.lit(1)).alias("units"), F.avg("m").alias("mean"))


def agreement(df: DataFrame, a: str, b: str, low: int = 1, high: int = 7) -> DataFrame:
    """One row (n, exact, within_one, kappa): agreement of two integer ratings and quadratically weighted kappa.

    Counts of the pairs of grades are a table of fixed size; ratings outside the range or null are left out; kappa is
    null where both raters are constant.
    """
    rows = df.filter(F.col(a).between(low, high) & F.col(b).between(low, high)).groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    d = ((F.col("a") - F.col("b")) ** 2).cast("double")
    t = rows.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"), F.sum(F.when(d <= 1, F.col("c")).otherwise(0)).alias("near"), F.sum(d * F.col("c")).alias("seen"))
    ra, rb = rows.groupBy("a").agg(F.sum("c").alias("ca")), rows.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = ra.crossJoin(rb).agg(F.sum(d * F.col("ca") * F.col("cb")).alias("chance"))  # at most (high - low + 1)^2 rows
    n = F.col("n")
    return t.crossJoin(chance).select("n", (F.col("same") / n).alias("exact"), (F.col("near") / n).alias("within_one"), F.when(F.col("chance") > 0, 1 - F.col("seen") * n / F.col("chance")).alias("kappa"))


def risk_coverage(df: DataFrame, unit: str, margin: str, reward: str, by: list[str]) -> DataFrame:
    """(by, coverage, mean_reward): reward per unit of acting on the most certain share 0, 0.1, ... 1 of units.

    Groups may be of any size; their sizes are a small table, one row for each group.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(F.struct(*by).alias("__g"), "__n")
    placed = lookup_skewed(ranked_split(df, by, [F.desc(margin), unit], "__p").withColumn("__g", F.struct(*by)), sizes, "__g", "__n")
    steps = F.array(*[F.lit(i / 10) for i in range(11)])
    each = placed.withColumn("coverage", F.explode(steps)).withColumn("__in", F.col("__p") <= F.round(F.col("coverage") * F.col("__n")))
    return each.groupBy(*by, "coverage").agg((F.sum(F.when(F.col("__in"), F.col(reward)).otherwise(0.0)) / F.count(F.lit(1))).alias("mean_reward"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts of the values of each column, as strings; one pass, no grouping of whole rows."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return cells.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
