"""Shards and slots of law ``bytes``, recomputed by one sort and one running sum."""

import xxhash

from filterlab.llm import sharding
from tests.llm.test_mixing_sharding_quality import ROWS, SCHEMA


def hashed(value):
    if value is None:
        return 42
    return xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True), 42)


def brute_places(rows, n_shards):
    def order(row):
        i, text = row
        key = hashed(text) >> 32 << 32 | hashed(i) >> 32
        return key - (1 << 64 if key >> 63 else 0), i is not None, i or 0

    size = lambda text: len((text or "").encode()) + 8
    rows = sorted(rows, key=order)
    keys, total = [order(r)[0] for r in rows], sum(size(t) for _, t in rows)
    first, groups, at = {}, {}, 0
    for key, (_, text) in zip(keys, rows, strict=True):
        n = size(text)
        s = min(n_shards - 1, int((at + n / 2) * n_shards / total))
        first.setdefault(s, key)
        groups[key >> 32] = groups.get(key >> 32, 0) + n
        at += n
    bounds, following = [], None
    for s in reversed(range(1, n_shards)):
        following = first.get(s, following)
        if following is not None:
            whole = groups[following >> 32] <= sharding.GROUP_SHARE * total / n_shards
            bounds.append(following >> 32 << 32 if whole else following)
    out, used = [], {}
    for key, (i, text) in zip(keys, rows, strict=True):
        s = sum(key >= b for b in bounds)
        out.append((str(i), size(text), s, used.get(s, 0)))
        used[s] = used.get(s, 0) + 1
    return sorted(out)


def test_places_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    odd = [(r[0], r[1]) for r in ROWS] + [(5000 + i, f"text {i} " * (i % 40)) for i in range(2000)] + [(9000 + i, "one hot text") for i in range(1200)]
    for rows, n_shards in ((plain, 24), (odd, 6), (odd, 24), (plain[:3], 24)):
        df = spark.createDataFrame([(i, t, *[None] * 6) for i, t in rows], SCHEMA).repartition(4)
        got = sharding.shard_by_bytes(df, n_shards).collect()
        assert sorted((str(r.doc_id), r["size"], r.shard, r.slot) for r in got) == brute_places(rows, n_shards)
