"""Grouped statistics: percentiles, distances, regressions, robust scale, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)


def percentile_bands(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """n rows, n_defined non-null values and exact linearly interpolated percentiles of each group."""
    p = F.percentile(value, F.array(*map(F.lit, BANDS)))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("n_defined"), p.alias("p"))
    names = [f"p{str(round(100 * q, 1)).rstrip('0').rstrip('.').replace('.', '_')}" for q in BANDS]
    return out.select(*by, "n", "n_defined", *(F.round(F.col("p")[i], digits).alias(n) for i, n in enumerate(names)))


def ks_distance(df: DataFrame, by: list[str], sample: Column, value: str) -> DataFrame:
    """Largest difference of the two right-continuous distribution functions of ``value`` (sample true and false) in each group.

    Rows are first counted by distinct value; null where a side is empty.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(sample).alias("a"), F.count_if(~sample).alias("b"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    fa = F.try_divide(F.sum("a").over(order), F.sum("a").over(whole))
    fb = F.try_divide(F.sum("b").over(order), F.sum("b").over(whole))
    return counts.select(*by, F.abs(fa - fb).alias("d")).groupBy(*by).agg(F.round(F.max("d"), 9).alias("ks"))


def robust_sigma(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median."""
    mid = df.groupBy(*by).agg(F.median(value).alias("__mid"))
    away = df.join(mid, by).withColumn("__away", F.abs(F.col(value) - F.col("__mid")))
    return away.groupBy(*by).agg(F.round(F.median("__away") * F.lit(1.4826), 6).alias("sigma"))


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by, start, length) of the longest run of true flags, the first on ties; (0, 0) for a group without one. Rows count from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, *order, flag.alias("__f")).withColumn("__i", F.row_number().over(w) - 1)
    rows = rows.withColumn("__run", F.col("__i") - F.sum(F.col("__f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("__f").groupBy(*by, "__run").agg(F.min("__i").alias("start"), F.count("*").alias("length"))
    best = runs.groupBy(*by).agg(F.min(F.struct((-F.col("length")).alias("m"), F.col("start"))).alias("b"))
    zero = F.lit(0).cast("long")
    return df.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce(F.col("b.start").cast("long"), zero).alias("start"), F.coalesce(-F.col("b.m"), zero).alias("length"))


def moments(df: DataFrame, group: str, y: str, x1: str, x2: str) -> DataFrame:
    """Sums of products of the values less their group's means: one row a group, additive over groups."""
    means = df.groupBy(group).agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate((y, x1, x2))))
    d = df.join(means, group).select(group, *((F.col(c) - F.col(f"__m{i}")).alias(n) for i, (c, n) in enumerate(((y, "y"), (x1, "a"), (x2, "b")))))
    return d.groupBy(group).agg(F.sum(d.a * d.a).alias("aa"), F.sum(d.a * d.b).alias("ab"), F.sum(d.b * d.b).alias("bb"), F.sum(d.a * d.y).alias("ay"), F.sum(d.b * d.y).alias("by"), F.count("*").alias("n"))


def solve(sums: DataFrame) -> DataFrame:
    """The two coefficients from summed moments, by the normal equations; null where they are singular."""
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return sums.withColumn("b1", F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)).withColumn("b2", F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det))


_SUMS = ("aa", "ab", "bb", "ay", "by", "n")


def fixed_effect_ols(df: DataFrame, group: str, y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y on x1 and x2 within groups."""
    total = moments(df, group, y, x1, x2).agg(*(F.sum(c).alias(c) for c in _SUMS))
    return solve(total).select("n", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


def bootstrap_draws(df: DataFrame, group: str, y: str, x1: str, x2: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """(draw, n, b1, b2): the regression on as many groups as there are, drawn with replacement, ``draws`` times.

    As moments add up over groups, a draw needs each group's sums and how often it was drawn, never its rows. Every place of a draw
    takes the group at floor(u * groups), u being a hash of the draw and the place; places are counted by (draw, group) before they
    meet the sums, so no draw needs all groups in one place.
    """
    from tilewright.functions import prefix
    from tilewright.functions.scalars import uniform

    sums = moments(df, group, y, x1, x2)
    numbered = prefix.draw_rank(sums.withColumn("__d", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)), "__d", "__at")
    total = df.where(F.col(group).isNotNull()).agg(F.count_distinct(group).alias("__g"))
    places = total.select("__g", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).repartition("draw").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__g")))
    picks = places.select("draw", F.floor(uniform(seed, F.col("draw"), F.col("__k")) * F.col("__g")).cast("long").alias("__at"))
    times = picks.groupBy("draw", "__at").agg(F.count("*").alias("__w"))
    added = times.join(numbered.withColumn("__at", F.col("__at").cast("long")), "__at").groupBy("draw").agg(*(F.sum(F.col(c) * F.col("__w")).alias(c) for c in _SUMS))
    return solve(added).select("draw", "n", "b1", "b2")


def bootstrap_ols(df: DataFrame, group: str, y: str, x1: str, x2: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 % points of the first coefficient when whole groups are drawn with replacement."""
    return bootstrap_draws(df, group, y, x1, x2, draws, seed).agg(F.percentile("b1", 0.025).alias("low"), F.percentile("b1", 0.975).alias("high"), F.count("b1").alias("draws"))


def binned_mean(df: DataFrame, x: str, y: str, ties: list[str], bins: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of x and y in ``bins`` runs of equal count of x in each ``by`` group, larger runs first. Without groups the rows are ranked
    over range partitions, so no task gets them all."""
    from tilewright.functions import prefix

    if by:
        rows = df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*by).orderBy(x, *ties)))
    else:
        ranked = prefix.global_rank(df.select(*dict.fromkeys((x, y, *ties))), [x, *ties], "__rank")
        total = ranked.agg(F.count("*").alias("__rows"))
        small, larger = F.floor(F.col("__rows") / bins), F.col("__rows") % bins
        edge = larger * (small + 1)  # ranks below it are in runs of one row more
        late = larger + F.floor((F.col("__rank") - edge) / F.greatest(small, F.lit(1)))
        rows = ranked.crossJoin(F.broadcast(total)).withColumn("bin", (F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (small + 1))).otherwise(late) + 1).cast("int"))  # one row
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("x_mean"), F.round(F.avg(y), 6).alias("y_mean"))


def gcd_step(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Greatest common divisor of the differences of the distinct values, 0 below two of them.

    It equals the divisor of the values less the smallest, so distinct values are folded pairwise without sorting; the fold runs
    in the JVM (Euclid's steps in a higher-order function, at most 92 for a long).
    """
    low = df.groupBy(*by).agg(F.min(value).alias("__low"))
    d = df.join(low, by).select(*by, (F.col(value) - F.col("__low")).cast("long").alias("__d")).distinct()

    def gcd(a, b):
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b"))))
        return pair["a"]

    salt = F.pmod(F.xxhash64("__d"), F.lit(64))  # two steps: no group's distinct values meet in one task at once
    fold = lambda c: F.aggregate(F.collect_set(c), F.lit(0).cast("long"), gcd)
    part = d.groupBy(*by, salt.alias("__s")).agg(fold("__d").alias("__g"))
    return part.groupBy(*by).agg(fold("__g").alias("step"))


def best_epoch(df: DataFrame, metric: str, epoch: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The row of the largest metric (missing: 0), the first on ties."""
    m = F.coalesce(F.col(metric), F.lit(0.0))
    return df.groupBy(*by).agg(F.min(F.struct((-m).alias("m"), F.col(epoch).alias("e"))).alias("b")).select(*by, F.col("b.e").alias("epoch"), (-F.col("b.m")).alias("best"))


def min_sample(df: DataFrame, by: str, usable: Column, least: int) -> DataFrame:
    """Rows of groups that have at least ``least`` usable rows."""
    good = df.groupBy(by).agg(F.count_if(usable).alias("__n")).where(F.col("__n") >= least).select(by)
    return df.join(good, by, "left_semi")
