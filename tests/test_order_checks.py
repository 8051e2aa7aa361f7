"""Order checks on random and enumerated systems, signatures of dropped equations, hashes of nulls."""

import pytest
from pyspark.sql import functions as F

from filterlab.functions import bits
from filterlab.operators import bloom, checks, ribbon


@pytest.mark.parametrize("kind", checks.KINDS)
def test_random_instances(spark, kind):
    rows = checks.random_instances(spark, 30, kind).collect()
    assert sorted(rows) == sorted(checks.random_instances(spark, 30, kind).repartition(3).collect())
    for x in rows:
        assert 0 <= x.start <= x.m - x.w and x.coeff & 1 and x.coeff < 1 << x.w and 0 <= x.rhs < 1 << x.r
    by = {}
    for x in rows:
        by.setdefault(x.instance, []).append((x.start, x.coeff, x.rhs))
    assert len(by) == 30 and all(5 <= len(eqs) < 8 for eqs in by.values())
    if kind == "homogeneous":
        assert not any(x.rhs for x in rows)
    if kind == "consistent":
        assert all(checks._solvable(eqs, 10, 3) for eqs in by.values())
    if kind == "arbitrary":
        assert any(x.rhs for x in rows)
    with pytest.raises(ValueError):
        checks.random_instances(spark, 1, "other")


def test_order_of_arbitrary_systems_shows(spark):
    seen = {r["class"]: r for r in checks.order_classes(spark, 120, classes={k: checks.CLASSES[k] for k in "CD"}).collect()}
    assert seen["D"].tested == seen["D"].identical > 20
    assert seen["C"].tested > seen["C"].identical and seen["C"].occupied_identical == seen["C"].tested


def test_counters_and_signatures(spark):
    # equations of m = 4, w = 2, r = 1: id = 4 * start + 2 * (coeff // 2) + rhs
    systems = spark.createDataFrame([(1, 0, 0, 2), (2, 0, 1, 4), (3, 0, 4, 8), (4, 2, 4, 0)], "system long, e1 long, e2 long, e3 long")
    seen = {r.system: r for r in checks.order_counters(systems, 4, 2, 1, 3).withColumn("signatures", checks.drop_signatures(F.col("drops"))).collect()}
    assert [seen[k].consistent for k in (1, 2, 3, 4)] == [1, 0, 1, 1]
    assert all(seen[k].orders == 6 and not seen[k].occupied_differs + seen[k].solution_differs + seen[k].unsolved + seen[k].false_contradiction + seen[k].missed_contradiction + seen[k].free_slot_differs for k in seen)
    assert seen[1].drops == [[0]] and seen[3].drops == [[]] and len(seen[1].signatures) == 1
    # 0 says slot 0 is 0, 2 that slots 0 and 1 are equal, 4 that slot 1 is 0: any one of them may be dropped
    assert seen[4].drops == [[0], [2], [4]] and seen[4].drop_sets_differ == 1 and len(seen[4].signatures) == 3


def test_hashes_of_nulls(spark):
    df = spark.createDataFrame([(None,), (0,), (5,)], "key long")
    assert [r.h is None for r in bits.with_mix64(df, "key", "h").collect()] == [True, False, False]
    assert [r.h for r in bits.with_hash(df, "key", "h", 3, filled=True).collect()][0] == bits.with_hash(df.where("key = 0"), "key", "h", 3).first().h
    assert ribbon.starts(df, 128).count() == 2
    hits = bloom.might_contain(df, bloom.build(df, 4), 4).collect()
    assert {r.key: r.hit for r in hits} == {None: False, 0: True, 5: True}


def test_window_counts_over_groups(spark, monkeypatch):
    monkeypatch.setattr(ribbon, "GROUP_SHIFT", 2)
    started = spark.range(3000).select((F.col("id") * F.col("id") % 997).alias("start"))
    counts = ribbon.window_counts(started, 4).orderBy("win").collect()
    total = 0
    for r in counts:
        assert r.before == total
        total += r.n
    assert total == 3000
    found = {r["range"]: r.first_win for r in ribbon.equal_ranges(ribbon.window_counts(started, 4), 7).collect()}
    assert found == {k: min(r.win for r in counts if r.before >= total * k / 7) for k in range(7) if any(r.before >= total * k / 7 for r in counts)}
