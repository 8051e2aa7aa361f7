import random

from pyspark.sql import functions as F

from filterlab.operators import analytics as an
from filterlab.operators import order_stats
from filterlab.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_upper_median_against_brute_force(spark):
    rng = random.Random(2)
    groups = {n: [float(rng.randrange(9)) for _ in range(n)] for n in (1, 2, 3, 4, 9, 10, 101, 500)}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [(3, None), (0, None)]
    out = spark.createDataFrame(rows, "g int, x double")
    out = an.upper_median(out, ["g"], "x")
    assert {r.g: r.upper_median for r in out.collect()} == {g: sorted(xs)[len(xs) // 2] for g, xs in groups.items()} | {0: None}


def test_upper_median_takes_all_rows(spark):
    values = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select((F.col("l_orderkey") % 4).alias("g"), F.col("l_extendedprice").alias("x")).collect():
        values.setdefault(r.g, []).append(r.x)
    got = {r["size"]: r.upper_median for r in catalogue.queries()["upper_median"](spark, SF).collect()}
    assert got == {g: sorted(xs)[len(xs) // 2] for g, xs in values.items()}


def test_refined_places_against_sorting(spark):
    rng = random.Random(9)
    groups = {"hot": [rng.lognormvariate(0, 4) for _ in range(20_000)], "ties": [1.0] * 3000 + [2.0] * 3001, "few": [5.0], None: [float(rng.randrange(50)) for _ in range(4000)], "odd": [float("inf"), float("-inf"), 0.0] * 700}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("few", None), ("nulls", None)], "g string, x double").repartition(6)
    asked = [("hot", 17, 40), ("hot2", 0, 1), ("ties", 2999, 3001), ("few", 0, 7), (None, 1999, 2000), ("odd", 0, 0)]
    wanted = spark.createDataFrame(asked, "g string, first long, last long")
    got = sorted((str(r.g), r.place, r.value) for r in order_stats.sorted_slice(rows, ["g"], "x", wanted, small=200).collect())
    assert got == sorted((str(g), p, sorted(groups[g])[p]) for g, a, b in asked if g in groups for p in range(a, b + 1) if p < len(groups[g]))
    for small in (50, 10**6):
        middles = {r.g: (r.median, r.upper_median) for r in order_stats.middles(rows, ["g"], "x", small).collect()}
        assert middles == {g: ((sorted(xs)[(len(xs) - 1) // 2] + sorted(xs)[len(xs) // 2]) / 2, sorted(xs)[len(xs) // 2]) for g, xs in groups.items()}
