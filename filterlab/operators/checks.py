"""Order-independence checks: enumeration of small systems, consistency, and identity of solutions.

A system is a multiset of equations (start, coeff, rhs) over m unknowns. Systems are made by
exploding sequences, so no join is needed and each row works by itself.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filterlab.operators import ribbon_kernel as kernel


def universe(spark: SparkSession, m: int, w: int, r: int = 1) -> DataFrame:
    """eq, start, coeff, rhs: every equation whose first bit is set and that lies inside m slots."""
    coeffs, values = 1 << (w - 1), 1 << r
    ids = spark.range((m - w + 1) * coeffs * values).withColumnRenamed("id", "eq")
    return ids.select("eq", F.floor(F.col("eq") / (coeffs * values)).alias("start"), (2 * F.pmod(F.floor(F.col("eq") / values), F.lit(coeffs)) + 1).alias("coeff"), F.pmod("eq", F.lit(values)).alias("rhs"))


def multisets(spark: SparkSession, n: int, k: int) -> DataFrame:
    """system, e1 <= ... <= ek: combinations with repetition of n equations."""
    rows = spark.range(n).withColumnRenamed("id", "e1")
    for j in range(2, k + 1):
        rows = rows.withColumn(f"e{j}", F.explode(F.sequence(F.col(f"e{j - 1}"), F.lit(n - 1).cast("bigint"))))
    number = sum((F.col(f"e{j}") * F.lit(n ** (k - j)) for j in range(1, k + 1)), F.lit(0).cast("bigint"))
    return rows.withColumn("system", number)


def orders(spark: SparkSession, k: int) -> DataFrame:
    """p1 .. pk: every order of k places, as literal rows."""
    return spark.createDataFrame(list(permutations(range(1, k + 1))), ", ".join(f"p{j} int" for j in range(1, k + 1)))


def consistency(systems: DataFrame, m: int, w: int, r: int, k: int) -> DataFrame:
    """system, solutions: how many of the 2**(m * r) assignments satisfy all k equations (r = 1)."""
    if r != 1:
        raise ValueError("assignments are enumerated for one result bit")
    coeffs = 1 << (w - 1)
    ok = F.lit(True)
    for j in range(1, k + 1):
        e = F.col(f"e{j}")
        start, coeff, rhs = F.floor(e / (2 * coeffs)).cast("int"), (2 * F.pmod(F.floor(e / 2), F.lit(coeffs)) + 1).cast("int"), F.pmod(e, F.lit(2)).cast("int")
        # the shift's distance is a column: whole powers of two say the same
        moved = coeff * F.pow(F.lit(2.0), start).cast("int")
        ok = ok & (F.bit_count(F.col("assignment").bitwiseAND(moved)) % 2 == rhs)
    tried = systems.withColumn("assignment", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    return tried.groupBy("system").agg(F.count_if(ok).alias("solutions"))


def order_violations(systems: DataFrame, m: int, w: int, r: int, k: int) -> DataFrame:
    """system, orders, solutions_seen, occupied_seen, failures_seen over every order of the equations.
    A system keeps the theorem if it is seen with one solution (when it has any), one occupied set and one verdict."""
    coeffs, values = 1 << (w - 1), 1 << r

    def equation(e: int) -> tuple[int, int, int]:
        return e // (coeffs * values), 2 * (e // values % coeffs) + 1, e % values

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                eqs = [equation(getattr(row, f"e{j}")) for j in range(1, k + 1)]
                solutions, occupied, failed, n = set(), set(), set(), 0
                for order in permutations(eqs):
                    band = kernel.Band(m).add(order)
                    n += 1
                    occupied.add(tuple(sorted(band.rows)))
                    failed.add(band.contradictions > 0)
                    if not band.contradictions:
                        solutions.add(kernel.back_substitute(band.rows, m, r, w).tobytes())
                out.append((row.system, n, len(solutions), len(occupied), len(failed)))
            yield pd.DataFrame(out, columns=["system", "orders", "solutions_seen", "occupied_seen", "failures_seen"])

    return systems.mapInPandas(check, "system bigint, orders bigint, solutions_seen bigint, occupied_seen bigint, failures_seen bigint")


RULES = tuple(kernel.FREE_RULES)
COUNTERS = ("systems", "consistent", "orders", "orders_consistent", "occupied_differs", "solution_differs", "false_contradiction", "missed_contradiction", "unsolved", "free_slot_differs", "with_drops", "drop_sets_differ", *(f"inconsistent_differs_{rule}" for rule in RULES))


def _solvable(eqs: list[tuple[int, int, int]], m: int, r: int) -> bool:
    """Whether some assignment satisfies all equations, by trying each; result bits are systems of their own."""
    return all(any(all(((c << s & z).bit_count() ^ b >> bit) & 1 == 0 for s, c, b in eqs) for z in range(1 << m)) for bit in range(r))


def _solves(eqs: list[tuple[int, int, int]], z: list[int], r: int) -> bool:
    for start, coeff, rhs in eqs:
        for j in range(coeff.bit_length()):
            if coeff >> j & 1:
                rhs ^= z[start + j]
        if rhs & ((1 << r) - 1):
            return False
    return True


def order_counters(systems: DataFrame, m: int, w: int, r: int, k: int) -> DataFrame:
    """For each system the counters of COUNTERS over every order of its equations and every rule for free slots, and
    drops, the distinct sets of equations that an order drops (see drop_signatures).

    Whether a system is consistent is found by trying assignments, each solution is put back into the equations:
    nothing is taken from the elimination that is checked. The first order is what others are held against."""
    coeffs, values = 1 << (w - 1), 1 << r
    columns = ["system", *COUNTERS, "drops"]

    def one(row) -> tuple:
        ids = [getattr(row, f"e{j}") for j in range(1, k + 1)]
        eqs = [(e // (coeffs * values), 2 * (e // values % coeffs) + 1, e % values) for e in ids]
        n = dict.fromkeys(COUNTERS, 0)
        solvable, first, drops, differs = _solvable(eqs, m, r), None, set(), set()
        n["systems"], n["consistent"] = 1, int(solvable)
        for order in permutations(range(k)):
            band, dropped = kernel.Band(m), []
            for at in order:
                before = band.redundant
                band.add([eqs[at]])
                if band.redundant > before:
                    dropped.append(ids[at])
            drops.add(tuple(sorted(dropped)))
            z = {rule: kernel.back_substitute(band.rows, m, r, w, free).tolist() for rule, free in kernel.FREE_RULES.items()}
            first = first or (set(band.rows), z, tuple(sorted(dropped)))
            n["orders"] += 1
            n["occupied_differs"] += set(band.rows) != first[0]
            if solvable:
                n["orders_consistent"] += 1
                n["false_contradiction"] += band.contradictions > 0
                for rule, free in kernel.FREE_RULES.items():
                    n["solution_differs"] += z[rule] != first[1][rule]
                    n["unsolved"] += not _solves(eqs, z[rule], r)
                    n["free_slot_differs"] += any(z[rule][j] != free(j, r) for j in range(m) if j not in band.rows)
            else:
                n["missed_contradiction"] += not band.contradictions
                differs |= {rule for rule in RULES if z[rule] != first[1][rule]}
        if solvable:
            n["with_drops"], n["drop_sets_differ"] = int(bool(first[2])), int(len(drops) > 1)
        for rule in differs:
            n[f"inconsistent_differs_{rule}"] = 1
        return (row.system, *(int(n[c]) for c in COUNTERS), [list(d) for d in sorted(drops)])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(row) for row in pdf.itertuples()], columns=columns)

    return systems.mapInPandas(check, ", ".join(["system bigint", *(f"{c} bigint" for c in COUNTERS), "drops array<array<bigint>>"]))


def drop_signatures(drops: Column) -> Column:
    """A signature of each set of dropped equations: a hash of its sorted ids, whatever order they were dropped in."""
    return F.array_sort(F.array_distinct(F.transform(drops, lambda ids: F.xxhash64(F.sort_array(ids)))))


#: Shapes (slots, width, result bits) of random instances: small ones for all orders, large ones for sampled orders.
#: The shapes (slots, width, result bits), fractions of slots and the seed of the experiment that these checks repeat.
SMALL, LARGE = ((10, 4, 3),), ((40, 8, 7), (96, 16, 7), (200, 32, 8))
SEED = 12345
KINDS = ("homogeneous", "consistent", "arbitrary")


def random_instances(spark: SparkSession, n: int, kind: str, shapes=SMALL, fewest: float = 0.5, most: float = 0.8, seed: int = SEED) -> DataFrame:
    """instance, m, w, r, i, start, coeff, rhs: the equations of n random systems with fewest * m up to most * m (exclusive)
    equations. Results are zero (homogeneous), those of a hidden solution (consistent), or random (arbitrary). All
    values are hashes of the seed and their place, the same for any partitioning."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")

    def draw(tag: str, below: Column, *at: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.lit(tag), F.col("instance"), *at), below.cast("bigint"))

    shape = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(s, "mwr", strict=True))) for s in shapes))
    rows = spark.range(n).withColumnRenamed("id", "instance")
    rows = rows.withColumn("shape", F.element_at(shape, (draw("shape", F.lit(len(shapes))) + 1).cast("int"))).select("instance", "shape.*")
    least = F.floor(F.col("m") * fewest)
    count = least + draw("count", F.floor(F.col("m") * most) - least)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    power = lambda x: F.pow(F.lit(2.0), x).cast("bigint")
    rows = rows.withColumn("start", draw("start", F.col("m") - F.col("w") + 1, F.col("i"))).withColumn("coeff", draw("coeff", power(F.col("w")), F.col("i")).bitwiseOR(F.lit(1)))
    if kind == "homogeneous":
        return rows.withColumn("rhs", F.lit(0).cast("bigint"))
    if kind == "arbitrary":
        return rows.withColumn("rhs", draw("rhs", power(F.col("r")), F.col("i")))
    slot = F.explode(F.sequence(F.lit(0), F.col("w") - 1))
    bits = rows.withColumn("j", slot).where(F.expr("shiftright(coeff, j) & 1 = 1"))
    hidden = draw("hidden", power(F.col("r")), F.col("start") + F.col("j"))
    return bits.withColumn("hidden", hidden).groupBy(*rows.columns).agg(F.bit_xor("hidden").alias("rhs"))


def instance_orders(instances: DataFrame, orders: int | None = None, seed: int = 1) -> DataFrame:
    """instance, equations, dependent, contradictions, orders, solutions_seen, occupied_seen: each instance in all orders of
    its equations, or in as many seeded ones. dependent: whether the first order drops equations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m, w, r, instance = (int(pdf[c].iloc[0]) for c in ("m", "w", "r", "instance"))
        eqs = list(zip(pdf.start.tolist(), pdf.coeff.tolist(), pdf.rhs.tolist(), strict=True))
        rng = random.Random(seed * 1_000_003 + instance)
        tried = permutations(eqs) if orders is None else (rng.sample(eqs, len(eqs)) for _ in range(orders))
        solutions, occupied, n, first = set(), set(), 0, kernel.Band(m).add(eqs)
        for order in tried:
            band = kernel.Band(m).add(order)
            solutions.add(kernel.back_substitute(band.rows, m, r, w).tobytes())
            occupied.add(tuple(sorted(band.rows)))
            n += 1
        found = (instance, len(eqs), first.redundant > 0, first.contradictions, n, len(solutions), len(occupied))
        return pd.DataFrame([found], columns=["instance", "equations", "dependent", "contradictions", "orders", "solutions_seen", "occupied_seen"])

    return instances.groupBy("instance").applyInPandas(run, "instance bigint, equations bigint, dependent boolean, contradictions bigint, orders bigint, solutions_seen bigint, occupied_seen bigint")


#: Classes of instances: kind, whether equations depend on each other.
CLASSES = {"A": ("homogeneous", True), "B": ("arbitrary", False), "C": ("arbitrary", True), "D": ("consistent", True)}


def order_classes(spark: SparkSession, n: int, orders: int | None = None, classes=CLASSES, seed: int = SEED) -> DataFrame:
    """class, tested, identical, occupied_identical: of n random instances of each class's kind those that are dependent as the class
    asks, and how many of them have one solution, and one set of occupied slots, in every order tried."""
    # few independent systems are found near m equations, so the large ones of class B have fewer
    every = None
    for name, (kind, dependent) in classes.items():
        shapes, fewest, most = (SMALL, 0.5, 0.8) if orders is None else (LARGE, 0.7 if dependent else 0.3, 1.2 if dependent else 0.7)
        seen = instance_orders(random_instances(spark, n, kind, shapes, fewest, most, seed), orders).where(F.col("dependent") == dependent)
        row = seen.agg(F.lit(name).alias("class"), F.count("*").alias("tested"), F.count_if(F.col("solutions_seen") == 1).alias("identical"), F.count_if(F.col("occupied_seen") == 1).alias("occupied_identical"))
        every = row if every is None else every.unionByName(row)
    return every


def summed(counters: DataFrame, total: str = "systems") -> DataFrame:
    """Counters summed over runs, and the run with most systems (the least name of equals)."""
    names = [c for c, t in counters.dtypes if t == "bigint"]
    largest = F.min_by("run", F.struct(-F.col(total), F.col("run")))
    return counters.agg(*(F.sum(c).alias(c) for c in names), largest.alias("largest_run"))
