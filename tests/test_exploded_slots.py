"""Slots exploded from a ranged ribbon are sized too low by Spark: no join may broadcast them."""

from filterlab.operators import ribbon
from filterlab.operators import ribbon_kernel as kernel
from filterlab.plans import catalogue
from filterlab.sources import keys


def test_slots_are_not_broadcast(spark):
    some = keys.key_stream(spark, 2_000)
    ranged, slots, spec = ribbon.build_standard_over_ranges(some, ribbon.Spec(overhead=1.2), range_slots=130)
    found = ribbon.looked_up_by_join(some, ranged, slots, spec)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas()
    assert len(got) == 2_000 and (got.value.to_numpy() == kernel.fingerprints(got.key.to_numpy(), spec.r)).all()


def test_slot_ranges_build_no_whole(spark, monkeypatch):
    def build(*_, **__):
        raise AssertionError("a whole ribbon in one task")

    monkeypatch.setattr(ribbon, "build", build)
    rows = catalogue.queries()["ribbon_slot_ranges"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 and all(r.same for r in rows)


def test_broken_ranges(spark):
    some = keys.key_stream(spark, 400)
    ranged, slots = ribbon.build_over_ranges(some, range_slots=130)
    assert ribbon.broken_ranges(some, ranged, slots, 130).count() == 0
    rows = [r.asDict() | {"z": bytes(r.z[:-2]) + bytes([r.z[-2] ^ 1, r.z[-1]]) if r.range == 1 else bytes(r.z)} for r in ranged.collect()]
    # the last slot of range 1 is in equations that begin in it, some of which end in range 2
    assert {r.range for r in ribbon.broken_ranges(some, spark.createDataFrame(rows, ranged.schema), slots, 130).collect()} == {1, 2}
