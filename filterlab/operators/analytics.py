"""Summaries, ratios, verdicts and comparisons of repeated measurements, as DataFrame queries.

Arms are strategies or modes, groups are sizes or machines; rows are repetitions. Missing values
are null and are skipped, never counted as zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.functions import bits
from filterlab.operators import order_stats
from filterlab.sources.shared import stored


def sample_stdev(x: Column | str) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def half_range(x: Column | str) -> Column:
    return (F.max(x) - F.min(x)) / 2


def upper_median(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """The middle value of each group, the upper one of two: never a mean of two. Null for a group of nulls."""
    return order_stats.joined(df.select(*by).distinct(), order_stats.middles(df, by, x).select(*by, "upper_median"), by)


def summary(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean, stdev, median, min, max, half range of x for each group."""
    rest = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sample_stdev(x).alias("stdev"), F.min(x).alias("least"), F.max(x).alias("most"), half_range(x).alias("half_range"))
    return order_stats.joined(rest, order_stats.middles(df, by, x).select(*by, "median"), by)


def na_mean(x: Column | str) -> Column:
    """The mean of what is there, NaN of nothing."""
    return F.coalesce(F.avg(x), F.lit(float("nan")))


def pivoted(df: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str], x: str) -> DataFrame:
    """A column for each arm, holding the mean of x."""
    return df.groupBy(*by).pivot(arm, list(arms)).agg(F.avg(x))


def ratio_of_medians(df: DataFrame, by: Sequence[str], arm: str, top: str, bottom: str, x: str) -> DataFrame:
    middles = order_stats.middles(df.where(F.col(arm).isin(top, bottom)), [*by, arm], x)
    a, b = (F.max(F.when(F.col(arm) == v, F.col("median"))) for v in (top, bottom))
    medians = middles.groupBy(*by).agg(a.alias("top"), b.alias("bottom"))
    return order_stats.joined(df.select(*by).distinct(), medians, by).withColumn("ratio", F.col("top") / F.col("bottom"))


def bootstrap_ratio(df: DataFrame, by: Sequence[str], arm: str, top: str, bottom: str, x: str, order: str, resamples: int = 200, seed: int = 0xE7, level: float = 0.95) -> DataFrame:
    """by, ratio, low, high: percentile bootstrap of the ratio of the arms' means.

    Draw i of resample s takes the row whose number is a hash of (s, i, arm) modulo the arm's
    rows, so the resamples are rows of a join: no group is gathered, and SQL gives the same."""
    rows = df.where(F.col(arm).isin(top, bottom) & F.col(x).isNotNull())
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy(*by, arm).orderBy(order)) - 1).withColumn("rows", F.count("*").over(W.partitionBy(*by, arm)))
    numbered = numbered.select(*by, F.col(arm).alias("arm"), F.col(x).cast("double").alias("x"), F.col("i").cast("bigint").alias("i"), "rows")
    draws = numbered.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).select(*by, "arm", "rows", "s", "i")
    # the arm enters by its first byte, so that the arms are resampled apart
    keyed = draws.withColumn("k", F.col("s").cast("bigint") * 1_000_003 + F.col("i") * 131 + F.when(F.col("arm") == top, 1).otherwise(2) + F.lit(seed))
    pick = bits.with_mix64(keyed, "k", "h", filled=True).withColumn("pick", bits.scaled(F.col("h"), F.col("rows"))).drop("h", "k", "i")
    found = pick.join(numbered.withColumnRenamed("i", "pick").drop("rows"), [*by, "arm", "pick"])
    means = found.groupBy(*by, "s").agg((F.avg(F.when(F.col("arm") == top, F.col("x"))) / F.avg(F.when(F.col("arm") == bottom, F.col("x")))).alias("ratio"))
    ranked = means.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("ratio", "s")) - 1)
    low, high = int(resamples * (1 - level) / 2), resamples - 1 - int(resamples * (1 - level) / 2)
    bounds = ranked.groupBy(*by).agg(F.max(F.when(F.col("rank") == low, F.col("ratio"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("ratio"))).alias("high"))
    exact = rows.groupBy(*by).agg((F.avg(F.when(F.col(arm) == top, F.col(x))) / F.avg(F.when(F.col(arm) == bottom, F.col(x)))).alias("ratio"))
    return exact.join(bounds, list(by))


def _middle_places(n: int, key: int) -> tuple[int, int]:
    """The places (from 0) in n sorted values of the lower and upper middle of n draws with replacement.

    Draw j of n has place floor(n * u): so the middle draws are the middle order statistics of n
    uniform numbers, which are Beta distributed, and the other draws needn't be made."""
    rng, m = np.random.Generator(np.random.Philox(key & (1 << 64) - 1)), n // 2
    if n % 2:
        u = v = rng.beta(m + 1, m + 1)
    else:  # above the m-th, the next one is the least of m uniform numbers
        u = rng.beta(m, m + 1)
        v = u + (1 - u) * rng.beta(1, m)
    return min(int(n * u), n - 1), min(int(n * v), n - 1)


def bootstrap_ratio_of_medians(df: DataFrame, by: Sequence[str], arm: str, top: str, bottom: str, x: str, resamples: int = 10_000, seed: int = 0xE7, level: float = 0.95) -> DataFrame:
    """by, ratio, low, high: percentile bootstrap of the ratio of the arms' medians, each arm resampled
    apart; bounds at sorted places 250 and 9,749 of 10,000. Groups without both arms are left out, and a
    median of 0 at the bottom gives NaN.

    The draws are keyed by (seed, group, arm, resample): the same for any partitioning. Only the middle
    draws are made, by their own distribution: the work is rows + groups x resamples, not their product."""
    by = list(by)
    rows = df.where(F.col(arm).isin(top, bottom) & F.col(x).isNotNull()).select(*by, F.col(arm).alias("arm"), F.col(x).cast("double").alias("x"))
    draws = rows.groupBy(*by, "arm").agg(F.count("*").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    keyed = draws.repartition(*by, "arm", "s").withColumn("key", F.xxhash64(F.lit(seed), *by, "arm", "s"))

    def middles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = [_middle_places(n, k) for n, k in zip(pdf.n.tolist(), pdf.key.tolist(), strict=True)]
            yield pdf.drop(columns=["n", "key"]).assign(places=[sorted(p) for p in places])

    types = dict(rows.dtypes)
    drawn = keyed.mapInPandas(middles, ", ".join([*(f"`{c}` {types[c]}" for c in by), "arm string", "s int", "places array<bigint>"]))
    each = stored(drawn.select(*by, "arm", "s", F.explode("places").alias("place")), "bootstrap-places")
    # middle draws lie around the middle: a small part of a large group's places
    wanted = each.groupBy(*by, "arm").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    numbered = order_stats.sorted_slice(rows, [*by, "arm"], "x", wanted).withColumnRenamed("value", "x")
    medians = each.join(numbered, [*by, "arm", "place"]).groupBy(*by, "s").agg(*(F.avg(F.when(F.col("arm") == v, F.col("x"))).alias(name) for v, name in ((top, "a"), (bottom, "b"))))
    over = F.when(F.col("b") == 0, F.lit(float("nan"))).otherwise(F.col("a") / F.when(F.col("b") != 0, F.col("b")))
    ranked = medians.where("a IS NOT NULL AND b IS NOT NULL").withColumn("ratio", over).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("ratio", "s")) - 1)
    low, high = int(resamples * (1 - level) / 2 + 1e-9), int(resamples * (1 + level) / 2 + 1e-9) - 1
    bounds = ranked.groupBy(*by).agg(F.max(F.when(F.col("rank") == low, F.col("ratio"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("ratio"))).alias("high"))
    exact = ratio_of_medians(rows, by, "arm", top, bottom, "x").select(*by, F.col("top").alias("a"), F.col("bottom").alias("b")).select(*by, over.alias("ratio"))
    return exact.join(bounds, by)


def recovery(reference: Column, arm: Column, best: Column) -> Column:
    """The share of the best arm's saving that an arm reaches; null where there is nothing to save."""
    return F.when(reference > best, (reference - arm) / (reference - best))


def best_of(df: DataFrame, by: Sequence[str], arm: str, x: str) -> DataFrame:
    """The arm with the least x of each group, the first by name of equals."""
    return df.groupBy(*by).agg(F.min(F.struct(x, arm)).alias("b")).select(*by, F.col(f"b.{arm}").alias("best"), F.col(f"b.{x}").alias("value"))


def against_baseline(df: DataFrame, arm: str, baseline: str, x: str) -> DataFrame:
    """x less the baseline arm's x, for each arm."""
    base = df.where(F.col(arm) == baseline).agg(F.max(x).alias("__base"))  # one row
    return df.join(F.broadcast(base)).withColumn("delta", F.col(x) - F.col("__base")).drop("__base")


def speed_up(df: DataFrame, by: Sequence[str], threads: str, x: str) -> DataFrame:
    """How many times faster than the group's row with the fewest threads."""
    first = F.first(x).over(W.partitionBy(*by).orderBy(threads).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("speed_up", first / F.col(x))


def spread(x: Column | str) -> Column:
    return F.max(x) / F.min(x) - 1


def weighted_ratio(part: Column, whole: Column) -> Column:
    """sum over sum, which is not the mean of ratios."""
    return F.sum(part) / F.sum(whole)


def mean_ratio(part: Column, whole: Column) -> Column:
    """The mean of the rows' ratios; rows whose whole is 0 or missing have none."""
    return F.avg(part / F.nullif(whole, F.lit(0)))


def one_value(x: Column | str) -> Column:
    """Whether a group agrees on one value; groups of nulls don't."""
    return F.count_distinct(x) == 1


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.collect_set(a)) == F.sort_array(F.collect_set(b))


def identity_join(a: DataFrame, b: DataFrame, on: Sequence[str], x: str) -> DataFrame:
    """on, equal: null-safe comparison of x over all keys of both; a key of one side is unequal."""
    left, right = a.select(*on, F.col(x).alias("__a"), F.lit(1).alias("__in_a")), b.select(*on, F.col(x).alias("__b"), F.lit(1).alias("__in_b"))
    both = left.join(right, list(on), "full_outer")
    return both.select(*on, (F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))).alias("equal"))


#: Values of b that a value of a meets in one part of the work.
PAIRED = 1_000


def missing_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of a value of a and a value of b that no row has. Values of b are dealt to parts of some PAIRED, each value
    of a goes to every part: the result is of that size, but neither side is broadcast or gathered."""
    values = stored(df.select(b).distinct(), "pairs")
    parts = max(1, -(-values.count() // PAIRED))
    dealt = values.withColumn("__part", F.pmod(F.xxhash64(b), F.lit(parts)))
    every = df.select(a).distinct().withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return every.join(dealt, "__part").select(a, b).join(df.select(a, b).distinct(), [a, b], "left_anti")


def differs_clearly(mean_a: Column, mean_b: Column, stdev_a: Column, stdev_b: Column) -> Column:
    """Whether two means lie further apart than their stdevs together."""
    return F.abs(mean_a - mean_b) > F.sqrt(stdev_a * stdev_a + stdev_b * stdev_b)


def matches(a: Column, b: Column, tolerance: float) -> Column:
    """Whether b is within a relative tolerance of a."""
    return F.abs(a - b) <= F.lit(tolerance) * F.abs(a)


def in_fixed_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """df with place, the place of a value in a fixed order; values outside it go last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with place, from 1: an order drawn by a hash of the key and a seed. Rows are numbered
    inside 4,096 ranges of the hash, whose counts give each range its first place."""
    drawn = bits.with_mix64(df, F.col(key).bitwiseXOR(F.lit(seed)), "__draw", filled=True).withColumn("__range", F.shiftrightunsigned("__draw", 52))
    counts = drawn.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = counts.select("__r", F.coalesce(F.sum("__n").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.row_number().over(W.partitionBy("__range").orderBy(F.col("__draw").bitwiseXOR(F.lit(-(1 << 63))), key))
    return drawn.join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn("place", F.col("__before") + number).select(*df.columns, "place")


def equal_within(a: Column, b: Column, most: float = 1e-6) -> Column:
    """Whether two numbers differ by less than an absolute bound; null if one is missing."""
    return F.abs(a - b) < F.lit(most)


def only_matched(pairs: DataFrame, a: Column, b: Column, tolerance: float = 0.1) -> DataFrame:
    """The rows whose two numbers match within a relative tolerance; rows that lack one don't."""
    return pairs.where(F.coalesce(F.abs(a - b) <= F.lit(tolerance) * F.abs(a), F.lit(False)))


def voided(ratio: Column, measured: Column, expected: Column, tolerance: float = 0.25) -> Column:
    """The ratio, or null where a cross-check of what it was measured with is off by more than the tolerance."""
    return F.when(F.abs(measured - expected) <= F.lit(tolerance) * F.abs(expected), ratio)


def named_codes(rows: DataFrame, code: str, names: DataFrame, out: str = "name") -> DataFrame:
    """rows with the name of their code, from a table (code, name); a code without a name stays, with null.
    Spark broadcasts the table of names as long as it is small."""
    looked_up = names.select(F.col("code").alias("__code"), F.col("name").alias(out))
    return rows.join(looked_up, F.col(code) == F.col("__code"), "left").drop("__code")
