import random

import pytest
from pyspark.sql import functions as F

from filterlab.functions import bits
from filterlab.operators import bloom, plain_bloom
from filterlab.sources import filter_store, keys


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no such version"):
        filter_store.read(spark, root)
    first, second = (bloom.build(keys.key_stream(spark, n), 10) for n in (50, 200))
    assert [filter_store.write(f, root, "bloom", blocks=10) for f in (first, second, second.where("false"))] == [1, 2, 3]
    for k, want in ((1, first), (2, second)):
        got, manifest = filter_store.read(spark, root, k)
        assert sorted(got.collect()) == sorted(want.collect()) and (manifest.version, manifest.kind, manifest.facts) == (k, "bloom", '{"blocks": 10}')
    assert filter_store.read(spark, root)[0].count() == 0
    first.limit(1).write.mode("append").parquet(f"{root}/v000002/filter")  # tampered with
    with pytest.raises(ValueError, match="isn't what was written"):
        filter_store.read(spark, root, 2)
    second.write.parquet(f"{root}/v000004/filter")  # a write that broke off before its manifest
    assert filter_store.read(spark, root)[1].version == 3 and filter_store.write(first, root, "bloom") == 5


def test_samples(spark, monkeypatch):
    values = random.Random(1).sample(range(-(10**6), 10**6), 3000)
    df = spark.createDataFrame([(v,) for v in [*values, *values[:99], None]], "key long")
    drawn = sorted(values, key=lambda v: int(bits.np_mix64(__import__("numpy").array([v ^ 5]))[0]))
    for few in (10, keys.FEW):
        monkeypatch.setattr(keys, "FEW", few)
        for n in (1, 10, 777, 3000):
            assert [r.key for r in keys.sample_keys(df, n, 5, rows=3100).collect()] == sorted(drawn[:n])
    assert keys.sample_keys(df, 4000, 5).count() == 2800
    with pytest.raises(ValueError, match="3100 keys, not 3000"):
        keys.sample_keys(df, 10, 5, rows=3000)
    with pytest.raises(ValueError, match="too few"):
        keys.sample_keys(df, 50_000, 5)


def test_adjacent_repeats_over_gaps(spark):
    rng = random.Random(3)
    rows = [(k * 3 + k % 2, rng.choice(["a", "b", "c", None]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "at long, v string, w long").repartition(7)
    want = [r for b, r in zip([(0, None, 0), *rows], rows, strict=False) if r[1] is not None and r[1] != b[1]]
    assert sorted(map(tuple, keys.without_adjacent_repeats(df, "v", "at").collect())) == want
    assert sorted(map(tuple, keys.without_adjacent_repeats(df, "v", ["at", "w"], n=70).collect())) == want[:70]
    with pytest.raises(ValueError, match="rows, not 5000"):
        keys.without_adjacent_repeats(df, "v", "at", n=5000)
    with pytest.raises(ValueError, match="not distinct"):
        keys.without_adjacent_repeats(df, "v", "at", n=70, distinct=True)
    assert keys.without_adjacent_repeats(df, "w", "at", n=70, distinct=True).count() == 70
    assert keys.without_adjacent_repeats(df.limit(0), "v", "at").count() == 0


def test_plain_bloom(spark):
    some, absent = keys.key_stream(spark, 5000), keys.absent_stream(spark, 50_000)
    m = 10 * 5000
    k = plain_bloom.best_k(5000, m)
    filter_ = plain_bloom.build(some, m, k)
    assert k == 7 and plain_bloom.probed(some.unionByName(some), filter_, m, k).where("hit").count() == 5000
    assert 0.004 < plain_bloom.probed(absent, filter_, m, k).where("hit").count() / 50_000 < 0.0125
    assert plain_bloom.probed(absent, filter_.where(F.lit(False)), m, k).where("hit").count() == 0
