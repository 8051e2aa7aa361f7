"""Exact order statistics of groups of any size, by refining counts of ranges.

The places wanted of each group (its middle ones, say) lie between two values, which a mergeable sketch of quantiles
proposes and exact counts confirm. Each round counts the rows below and between, and sketches those between anew, so
a group shrinks by some GRID / 2 a round until few rows are left around the places. These are counted by
value and numbered over sorted ranges. Every round is an aggregate combined before its shuffle; no group, and no value
that fills a group, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.sources.shared import earlier, in_ranges, stored

#: Rows around its places with which a group is refined no more; steps of a sketch; its accuracy.
SMALL, GRID, ACCURACY = 100_000, 64, 10_000


def _grid(x: Column) -> Column:
    return F.percentile_approx(x, F.array(*(F.lit(j / GRID) for j in range(GRID + 1))), ACCURACY)


def _in_bracket(x: str = "x") -> Column:
    return (F.col("lo").isNull() | (F.col(x) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(x) <= F.col("hi")))


def _refined(base: DataFrame, state: DataFrame, small: int) -> DataFrame:
    """state (g, first, last, below, inside, lo, hi): for each group the rows below lo and between lo and hi, where places
    first to last lie in between."""
    kind = base.schema["x"].dataType
    able, met = (F.col("inside") > small) & (F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") < F.col("hi"))) & ~F.col("stuck"), base
    state = state.withColumn("stuck", F.lit(False))
    while state.where(able).limit(1).count():
        live = state.where(able)
        sketched = stored(met.join(live.select("g", "lo", "hi"), "g").where(_in_bracket()).groupBy("g").agg(_grid(F.col("x")).alias("grid")), "order-grid")
        slack = 2 * GRID / ACCURACY
        j_lo = F.floor((F.col("first") - F.col("below")) * GRID / F.col("inside") - slack).cast("int")
        j_hi = F.ceil((F.col("last") + 1 - F.col("below")) * GRID / F.col("inside") + slack).cast("int")
        at = F.when((j_lo >= 0) & (j_lo <= GRID), F.element_at("grid", F.greatest(j_lo, F.lit(0)) + 1)), F.when((j_hi >= 0) & (j_hi <= GRID), F.element_at("grid", F.least(F.greatest(j_hi, F.lit(0)), F.lit(GRID)) + 1))
        proposed = live.join(sketched, "g").withColumns({"new_lo": F.coalesce(at[0], "lo").cast(kind), "new_hi": F.coalesce(at[1], "hi").cast(kind)}).drop("grid")
        inner = (F.col("new_lo").isNull() | (F.col("x") >= F.col("new_lo"))) & (F.col("new_hi").isNull() | (F.col("x") <= F.col("new_hi")))
        counted = met.join(proposed.select("g", "lo", "hi", "new_lo", "new_hi"), "g").where(_in_bracket()).groupBy("g").agg(F.count_if(F.col("x") < F.col("new_lo")).alias("under"), F.count_if(inner).alias("kept"))
        tried = proposed.join(counted, "g")
        right = (F.col("below") + F.col("under") <= F.col("first")) & (F.col("last") < F.col("below") + F.col("under") + F.col("kept")) & (F.col("kept") < F.col("inside"))
        pick = {"lo": F.when(right, F.col("new_lo")).otherwise(F.col("lo")), "hi": F.when(right, F.col("new_hi")).otherwise(F.col("hi")), "below": F.when(right, F.col("below") + F.col("under")).otherwise(F.col("below")), "inside": F.when(right, F.col("kept")).otherwise(F.col("inside")), "stuck": ~right}
        state = stored(tried.withColumns(pick).select(*state.columns).unionByName(state.where(~able)), "order-state")
    return state


def sorted_slice(rows: DataFrame, by: Sequence[str], x: str, wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """by, place, value: the values at places first to last (from 0) of each group's sorted values, nulls left out.
    wanted: by, first, last. A place beyond the group is left out."""
    base = rows.where(F.col(x).isNotNull()).select(F.struct(*by).alias("g"), F.col(x).alias("x"))
    kind = base.schema["x"].dataType
    sizes = base.groupBy("g").agg(F.count("*").alias("inside"))
    asked = wanted.select(F.struct(*by).alias("g"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
    none = F.lit(None).cast(kind)
    state = stored(sizes.join(asked, "g").select("g", "first", F.least("last", F.col("inside") - 1).alias("last"), F.lit(0).cast("bigint").alias("below"), "inside", none.alias("lo"), none.alias("hi")), "order-state")
    state = _refined(base, state, small)
    left = base.join(state.select("g", "lo", "hi"), "g").where(_in_bracket()).groupBy("g", "x").agg(F.count("*").alias("c"))
    numbered = in_ranges(stored(left, "order-left"), [F.col("g"), F.col("x")], "order-ranges")
    sums = numbered.groupBy("g", "__range").agg(F.sum("c").alias("__rows")).withColumn("__ahead", earlier("__rows", "__range", ["g"])).drop("__rows")
    inside = F.sum("c").over(W.partitionBy("g", "__range").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    upto = numbered.withColumn("__upto", inside).join(sums, ["g", "__range"]).join(state.select("g", "first", "last", "below"), "g")
    end = F.col("below") + F.col("__ahead") + F.col("__upto")
    a, b = F.greatest(end - F.col("c"), F.col("first")), F.least(end - 1, F.col("last"))
    found = upto.select("g", F.col("x").alias("value"), a.alias("a"), b.alias("b")).where("a <= b")
    return found.select("g.*", F.explode(F.sequence("a", "b")).alias("place"), "value")


def middles(rows: DataFrame, by: Sequence[str], x: str, small: int = SMALL) -> DataFrame:
    """by, median (the mean of the two middle values) and upper_median of each group that has a value."""
    counts = rows.groupBy(*by).agg(F.count(x).alias("n")).where("n > 0")
    wanted = counts.select(*by, F.floor((F.col("n") - 1) / 2).alias("first"), F.floor(F.col("n") / 2).alias("last"))
    found = sorted_slice(rows, by, x, wanted, small)
    return found.groupBy(*by).agg(F.avg("value").alias("median"), F.max("value").alias("upper_median"))


def joined(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """a with the other columns of b, null groups included."""
    there = b.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in b.columns if c not in by))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(there, on, "left").drop(*(f"__{c}" for c in by))
