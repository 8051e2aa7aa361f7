import zlib

import numpy as np
import pandas as pd

from filterlab.llm import mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, taken string"
ROWS = [(i, "w " * (i % 7 + 1), "en", "a" if i % 3 else "b", 1, "x", "y", "z") for i in range(60)] + [
    (100, None, None, None, None, None, None, None),
    (101, "", "en", "b", 0, "x", "y", "z"),
    (102, "hot text here " * 3, "en", "a", 0, "x", "y", "z"),
    (102, "hot text here " * 3, "en", "a", 0, "x", "y", "z"),
    (None, "no id", "de", None, 0, "x", "y", "z"),
    (103, "long word " * 4000, "en", "c", 0, "x", "y", "z"),
]


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mixing.mix_plan(docs).toPandas()
    assert len(got) == len(ROWS)
    got["source"] = got.source.where(got.source.notna(), None)
    sizes = {None if pd.isna(s) else s: int(g["size"].sum()) for s, g in got.groupby("source", dropna=False)}
    want = brute_targets(sizes, (5, 2, 1), 3)
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6
        assert abs(g.taken.sum() - want[s]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and abs(out.select(mixing.n_words(out.text).alias("n")).toPandas().n.sum() - got.taken.sum()) <= 9
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_rows_that_differ_in_the_place_of_a_null_are_both_mixed(spark):
    rows = [(None, "one two three", "s", None, "a"), (None, "one two three", "s", "a", None)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, extra string"))
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame(rows, out.schema).collect()))


def test_shards(spark):
    rows = ROWS + [(1000 + i, f"text {i} " * (i % 40), "en", "a", 0, "", "", "") for i in range(3000)] + [(9000 + i, "same", "en", "a", 0, "", "", "") for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_by_bytes(docs, 6).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 6 and (sums - sums.mean()).abs().max() <= got["size"].max() + 0.03 * sums.mean()
    by = {r[0]: r[1] for r in rows if r[0] is not None}
    for i, n, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True):
        if not pd.isna(i):
            t = (by[i] or "").encode()
            assert n == len(t) + 8 and c == zlib.crc32(t)
    again = sharding.shard_by_bytes(docs.repartition(5), 6).toPandas()
    key = ["doc_id", "shard", "slot"]
    a, b = (x[key].sort_values(key).reset_index(drop=True) for x in (got, again))
    assert a.equals(b)
    assert sharding.shard_by_bytes(docs.limit(0), 6).count() == 0


def brute_repeat(words, w=8):
    seen = {}
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(w)})


def test_quality(spark):
    rng = np.random.default_rng(5)
    prose = " ".join(rng.choice(["the", "of", "and", "house", "river", "green", "walks"], 300))
    texts = {1: prose, 2: "a b c d e f g h " * 9, 3: None, 4: "", 5: "one\none\n \n \ntwo|three <x>", 6: "€%&$ 0123 ~^ " * 60, 7: "é x " * 2, 8: prose + "\n" + prose}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()] + [(1, prose, "en")] * 60, "doc_id long, text string, lang string")
    got = quality.quality(docs).dropDuplicates(["doc_id"]).toPandas().set_index("doc_id")
    for k, t in texts.items():
        words = (t or "").split()
        r = got.loc[k]
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute_repeat(words)), k
    assert got.kept[1] and not got.kept[2] and not got.kept[3] and not got.kept[6] and got.base_failed[4]
    assert got.class_distance[6] > got.class_limit[6] and np.isnan(got.class_distance[7])
    assert quality.quality(docs.limit(0)).count() == 0


def test_repeated_windows_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 7, 8, 9, 16, 40, 90):
        for k in (1, 2, 5):
            ids = rng.integers(0, k, n)
            assert quality.repeated_window_words(ids) == brute_repeat(ids.tolist())
