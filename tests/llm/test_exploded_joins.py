"""Tables that grow by an explode are sized too low by Spark: no join may broadcast them."""

import random

from filterlab.llm import line_dedup, simhash
from filterlab.llm.common import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_are_not_broadcast(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(63) for _ in range(50)]
    prints += [p ^ 5 for p in prints[:20]]
    named = stored(spark.createDataFrame([(p, p) for p in prints], "fp long, root long"), "test-prints")
    for links in (simhash.first_links(named), simhash.open_links(named)):
        assert "Broadcast" not in plan(links)
        assert {frozenset(r) for r in links.distinct().collect()} == {frozenset((p, p ^ 5)) for p in prints[:20]}


def test_shingle_sets_are_not_broadcast(spark):
    texts = stored(spark.createDataFrame([(k, f"line {k // 2} " + "of words " * 9) for k in range(20)], "key long, line string"), "test-texts")
    pairs = stored(spark.createDataFrame([(k + 1, k) for k in range(0, 20, 2)], "a long, b long"), "test-pairs")
    near = line_dedup.verified(pairs, texts)
    assert "SortMergeJoin [b#" in plan(near) and near.count() == 10
