"""Filters against their definitions, on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filterlab.functions import bits
from filterlab.operators import bloom, checks, file_index, joins, ribbon
from filterlab.operators import ribbon_kernel as kernel
from filterlab.sources import keys

M = (1 << 64) - 1
ODD = [0, 1, -1, 2**63 - 1, -(2**63), 5, 2**32, -(2**32), 123456789123456789]


def mix(x):
    x &= M
    x = (x ^ x >> 30) * bits.MIX_A & M
    x = (x ^ x >> 27) * bits.MIX_B & M
    return x ^ x >> 31


def seeded(x, seed=0):
    h = (x + seed) & M
    h = (h ^ h >> 33) * bits.HASH_A & M
    h = (h ^ h >> 33) * bits.HASH_B & M
    return h ^ h >> 33


def test_hashes(spark):
    rng = random.Random(1)
    xs = ODD + [rng.getrandbits(64) - 2**63 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "key long")
    rows = bits.with_hash(bits.with_mix64(df, "key", "m"), "key", "h", 7).withColumn("s", bits.scaled(F.col("m"), 2**31 - 1)).collect()
    for r in rows:
        if r.key is None:
            assert r.m is None and r.h is None
        else:
            assert r.m & M == mix(r.key) and r.h & M == seeded(r.key, 7) and r.s == mix(r.key) * (2**31 - 1) >> 64
    assert [int(x) for x in bits.np_mix64(np.array(xs, np.int64).view(np.uint64))] == [mix(x) for x in xs]


def test_key_stream_has_no_order(spark):
    got = keys.key_stream(spark, 1000, rep=2).repartition(7).orderBy("ordinal").collect()
    assert [r.key & M for r in got] == [mix(keys.MEMBER_SEED + 2 + (i + 1) * bits.GOLDEN) for i in range(1000)]


def brute_bloom(values, blocks):
    table = {}
    for v in values:
        h = mix(v)
        words = table.setdefault((h >> 32) * blocks >> 32, [0] * 8)
        for k, salt in enumerate(bits.SALTS):
            words[k] |= 1 << (((h & 0xFFFFFFFF) * salt & 0xFFFFFFFF) >> 27)
    return {b: tuple(w) for b, w in table.items()}


@pytest.mark.parametrize("n", [0, 1, 63, 1000])
def test_bloom_strategies_are_one(spark, n):
    values = [mix(i) - 2**63 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:5], None]], "key long").repartition(3)
    blocks = bloom.n_blocks(n)
    want = brute_bloom(values, blocks)
    for strategy in ("grouped", "range", "partials", "owners"):
        got = bloom.build(df, blocks, strategy=strategy).collect()
        assert {r.block: tuple(r[1:]) for r in got} == want
    asked = bloom.might_contain(df, bloom.build(df, blocks), blocks).collect()
    assert all(r.hit == (r.key is not None) for r in asked)


def test_bloom_rate_and_bound(spark):
    members = keys.key_stream(spark, 20_000)
    blocks = bloom.n_blocks(20_000)
    got = bloom.false_positives(keys.absent_stream(spark, 100_000), bloom.build(members, blocks), blocks).first()
    assert 0.001 < got.fpr < 0.05 and 10 >= 1.44 * np.log2(1 / got.fpr)
    assert bloom.packed(bloom.build(members, blocks)).where(F.octet_length("bytes") != 32).count() == 0


def test_joins_equal_plain_joins(spark):
    a = spark.createDataFrame([(i % 50 if i % 9 else None, i) for i in range(300)], "k long, v long")
    b = spark.createDataFrame([(i,) for i in [*range(0, 80, 3), 3, None]], "j long")
    plain = a.join(b, F.col("k") == F.col("j"), "left_semi")
    assert sorted(joins.semi_join(a, b, "k", "j").collect()) == sorted(plain.collect())
    assert sorted(map(str, joins.anti_join(a, b, "k", "j").collect())) == sorted(map(str, a.join(b, F.col("k") == F.col("j"), "left_anti").collect()))
    assert sorted(joins.inner_join(a, b, "k", "j").collect()) == sorted(a.join(b, F.col("k") == F.col("j")).collect())


def test_file_index(spark, tmp_path):
    at, index = str(tmp_path / "table"), str(tmp_path / "index")
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.col("id").alias("v"), (F.col("id") % 40).alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(at)
    file_index.write_index(spark, at, "k", index)
    asked = spark.createDataFrame([(81,), (81 + 40,), (4003,), (None,), (10**9,)], "j long")
    few = file_index.pruned(spark, at, index, asked, "j")
    assert few.columns == rows.columns and 2 <= len(few.inputFiles()) <= 6 and len(spark.read.parquet(at).inputFiles()) == 40
    plain = spark.read.parquet(at).join(asked, F.col("k") == F.col("j"))
    assert sorted(file_index.inner_join(spark, at, index, "k", asked, "j").collect()) == sorted(plain.collect())
    assert sorted(file_index.semi_join(spark, at, index, "k", asked, "j").collect()) == sorted(plain.drop("j").collect())
    assert {r.j for r in file_index.absent(spark, at, index, "k", asked, "j").collect()} == {None, 10**9}
    assert file_index.pruned(spark, at, index, asked.where("j > 100000"), "j").count() == 0
    spark.createDataFrame([(10**9, 1, 3)], "k long, v long, part int").write.mode("append").partitionBy("part").parquet(at)  # after the index
    assert {r.j for r in file_index.absent(spark, at, index, "k", asked, "j").collect()} == {None}


# --- ribbon ---------------------------------------------------------------------------------------
def solve(equations, slots, r):
    """Whether the equations have a solution, by Gaussian elimination over columns."""
    rows = {}
    for start, coeff, rhs in equations:
        x = coeff << start
        while x:
            low = x & -x
            if low not in rows:
                rows[low] = (x, rhs)
                break
            x ^= rows[low][0]
            rhs ^= rows[low][1]
        else:
            if rhs:
                return False
    return True


# fixed values: shapes and fractions of the experiment that the order checks repeat
@pytest.mark.parametrize(("slots", "w", "r"), [(10, 4, 3), (40, 8, 7), (96, 16, 7)])
def test_kernel_solves_in_any_order(slots, w, r):
    rng = random.Random(slots)
    for trial in range(40):
        n = rng.randrange(int(0.7 * slots), int(1.2 * slots))
        hidden = [rng.randrange(1 << r) for _ in range(slots)]
        eqs = []
        for _ in range(n):
            s, c = rng.randrange(slots - w + 1), rng.randrange(1 << (w - 1)) * 2 + 1
            rhs = 0
            for j in range(w):
                rhs ^= hidden[s + j] if c >> j & 1 else 0
            eqs.append((s, c, {0: 0, 1: rhs, 2: rng.randrange(1 << r)}[trial % 3]))
        seen = set()
        for _ in range(6):
            rng.shuffle(eqs)
            band = kernel.Band(slots).add(eqs)
            z = kernel.back_substitute(band.rows, slots, r, w)
            failed = band.contradictions > 0
            assert failed != solve(eqs, slots, r)
            if not failed:
                for s, c, b in eqs:
                    got = 0
                    for j in range(w):
                        got ^= int(z[s + j]) if c >> j & 1 else 0
                    assert got == b
            parts = [kernel.Band(slots).add(eqs[k::3]) for k in range(3)]
            merged = kernel.Band(slots)
            for p in parts:
                merged.add(p.equations())
            assert sorted(merged.rows) == sorted(band.rows)
            if not failed:
                assert (kernel.back_substitute(merged.rows, slots, r, w) == z).all()
            capped = kernel.Band(slots // 2).add(eqs)
            assert all(s < slots // 2 for s in capped.rows)
            whole = kernel.Band(slots).add(capped.equations()).add(capped.spilled)
            assert sorted(whole.rows) == sorted(band.rows)
            seen.add((tuple(sorted(band.rows)), failed, None if failed else z.tobytes()))
        assert len(seen) == 1


@pytest.mark.parametrize("n", [0, 1, 64, 3000])
@pytest.mark.parametrize("overhead", [None, 0.9])
def test_ribbon_strategies_are_one(spark, n, overhead):
    df = keys.key_stream(spark, n).select("key").unionByName(keys.key_stream(spark, min(n, 7)).select("key")).repartition(5)
    spec = ribbon.Spec(overhead=overhead)
    seen = {tuple(ribbon.digest(ribbon.build(df, spec, s, ranges=3, shard_keys=1000)).first()) for s in ribbon.STRATEGIES}
    assert len(seen) == 1
    filter_ = ribbon.build(df, spec, shard_keys=1000)
    assert ribbon.might_contain(df, filter_, spec).where("NOT hit").count() == 0


def test_ribbon_rate_and_probe_paths(spark, monkeypatch):
    members, absent = keys.key_stream(spark, 6000), keys.absent_stream(spark, 60_000).unionByName(spark.createDataFrame([(-1, None)], "ordinal long, key long"))
    filter_ = ribbon.build(members, shard_keys=2000)
    sent = ribbon.might_contain(absent, filter_).orderBy("ordinal").collect()
    rate = sum(r.hit for r in sent) / 60_000
    assert 0.75 * 2**-7 < rate < 1.25 * 2**-7 and not sent[0].hit
    monkeypatch.setattr(ribbon, "BROADCAST_BYTES", 0)
    assert ribbon.might_contain(absent, filter_).orderBy("ordinal").collect() == sent


def test_standard_ribbon(spark):
    some = keys.key_stream(spark, 2000)
    filter_, spec = ribbon.build_standard(some, ribbon.Spec(overhead=1.2))
    assert filter_.where("contradictions > 0").count() == 0 and ribbon.might_contain(some, filter_, spec).where("NOT hit").count() == 0


def test_seeds_of_shards(spark):
    some = keys.key_stream(spark, 9000)
    filter_, spec = ribbon.build_standard(some, ribbon.Spec(overhead=1.02), shard_keys=300)
    rows = filter_.collect()
    assert len({r.shard for r in rows}) == len(rows) == 30 and len({r.seed for r in rows}) > 1 and sum(r.contradictions for r in rows) == 0
    values = ribbon.looked_up(some, filter_, spec)
    assert values.where(F.col("value") != ribbon.fingerprint(F.col("key"), spec.r)).count() == 0 and values.where("value IS NULL").count() == 0
    assert ribbon.might_contain(some, filter_, spec).where("NOT hit").count() == 0
    with pytest.raises(ValueError, match="more keys than slots"):
        ribbon.build_standard(some, ribbon.Spec(overhead=0.9), shard_keys=300)


@pytest.mark.parametrize("w", [64, 128])
@pytest.mark.parametrize("overhead", [None, 0.9, 1.3])
def test_ranges_of_slots_solve_as_one(spark, w, overhead):
    some = keys.key_stream(spark, 1500)
    for standard in (False, True):
        spec = ribbon.Spec(w, overhead=overhead, standard=standard)
        one = ribbon.build(some, spec).first()
        ranged, slots = ribbon.build_over_ranges(some, spec, range_slots=130)
        rows = ranged.orderBy("range").collect()
        assert slots == one.slots and len(rows) == -(-slots // 130) and sum(r.n for r in rows) == one.n
        assert (sum(r.occupied for r in rows), sum(r.redundant for r in rows)) == (one.occupied, one.redundant)
        assert b"".join(bytes(r.z) for r in rows) == bytes(one.z) or one.contradictions
        if w == 64 and not one.contradictions:
            by_join = {r.key: r.value for r in ribbon.looked_up_by_join(some, ranged, slots, spec).collect()}
            assert by_join == {r.key: r.value for r in ribbon.looked_up(some, ribbon.build(some, spec), spec).collect()}


def test_ranges_of_few_keys(spark):
    for n in (0, 1, 3):
        some = keys.key_stream(spark, n)
        ranged, slots = ribbon.build_over_ranges(some, range_slots=1)
        z = b"".join(bytes(r.z) for r in ranged.orderBy("range").collect())
        assert len(z) == 2 * slots and (not n or z == bytes(ribbon.build(some).first().z))


def test_affine_maps_compose():
    rng = random.Random(5)
    slots, w, r = 90, 8, 7
    rows = kernel.Band(slots).add((rng.randrange(slots - w + 1), rng.randrange(1 << (w - 1)) * 2 + 1, rng.randrange(1 << r)) for _ in range(70)).rows
    want = kernel.back_substitute(rows, slots, r, w)
    for cuts in ([0, 30, 60, 90], [0, 7, 9, 88, 90], [0, 90]):
        maps = [kernel.affine(rows, a, b - a, r, w) for a, b in itertools.pairwise(cuts)]
        state, parts = [0] * (w - 1), []
        for k in range(len(maps) - 1, -1, -1):
            parts.insert(0, kernel.back_substitute(rows, cuts[k + 1] - cuts[k], r, w, first=cuts[k], state=state))
            whole = maps[k]
            for m in maps[k + 1 :]:
                whole = kernel.composed(whole, m)
            state = whole[1]
        assert (np.concatenate(parts) == want).all()


def test_orders_of_small_systems(spark):
    seen = checks.order_violations(checks.multisets(spark, 12, 3), 4, 2, 1, 3).collect()
    assert len(seen) == 364 and all(r.solutions_seen <= 1 and r.occupied_seen == 1 and r.failures_seen == 1 for r in seen)
    assert len(checks.universe(spark, 4, 2).collect()) == 12
    assert {tuple(r) for r in checks.orders(spark, 3).collect()} == set(itertools.permutations((1, 2, 3)))
