import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filterlab.llm import bpe, importance, merkle, queries
from filterlab.llm.common import ranked, stored

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, leaf string, idx int, weight int, ids int"
ROWS = [(i, "Über word " * (i % 9) + f"text{i}", ["en", "de", "日本", "a"][i % 4] if i % 9 else None, "s" if i % 3 else None, i, "x", "y", 1, 2, 3) for i in range(70)] + [
    (None, "no id", "en", "s", 1, "x", "y", 1, 2, 3),
    (None, None, None, None, None, None, None, None, None, None),
    (300, "one of its language", "zz", "s", 19, "x", "y", 1, 2, 3),
    (301, "", "en", "s", 0, "x", "y", 1, 2, 3),
    (302, None, "en", "s", None, "x", "y", 1, 2, 3),
    (303, "Long " * 30_000, "en", "s", 2**63 - 1, "x", "y", 1, 2, 3),
    (304, "tie", "en", "s", 1, "x", "y", 1, 2, 3),
    (304, "other tie", "en", "s", 1, "x", "y", 1, 2, 3),
] + [(305, "repeated row", "en", "s", 1, "x", "y", 1, 2, 3)] * 5


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, arity, tampered):
    """Sorted rows of op11 by lists of nodes; a node is a digest and the leaves below it."""
    def said(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(i, text, lang, source, n):
        return h("".join(map(said, (i, source, lang, n, text))))

    items = [{"id": i, "lang": lang, "leaf": leaf(i, t, lang, s, n), "steps": [], "claim": leaf(i, t, lang, s, None if n is None else n + 1) if tampered(i) else None} for i, t, lang, s, n, *_ in rows]

    def grow(nodes):
        while len(nodes) > 1:
            runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
            for run in runs:
                for k, (_, below) in enumerate(run):
                    for x in below:
                        x["steps"].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            nodes = [(h("".join(d for d, _ in run)), [x for _, below in run for x in below]) for run in runs]
        return nodes[0]

    tops = []
    for lang in sorted({x["lang"] for x in items}, key=lambda x: (x is not None, (x or "").encode())):
        group = sorted((x for x in items if x["lang"] == lang), key=lambda x: (x["id"] is not None, x["id"], x["leaf"]))
        tops.append(grow([(x["leaf"], [x]) for x in group]))
        for x in group:
            x["subroot"] = tops[-1][0]
    root = grow(tops)[0]
    out = []
    for x in items:
        d = x["claim"] or x["leaf"]
        for before, after in x["steps"]:
            d = h("".join(before) + d + "".join(after))
        out.append((x["id"], x["leaf"], x["subroot"], root, h("".join("".join(a) + "".join(b) for a, b in x["steps"])), d, d == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_against_brute_force(spark, arity):
    def tampered(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 0

    for rows in (ROWS, ROWS[:1], [r for r in ROWS if r[2] == "en"]):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        doc_id, fields = F.col("doc_id"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
        claim = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, merkle.leaf(*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]))
        out = merkle.manifest(docs, merkle.leaf(*fields), F.col("lang"), doc_id, arity, {"doc_id": doc_id, "claim": claim})
        out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded := merkle.folded(F.coalesce("claim", "leaf"), F.col("path")), folded == F.col("root"))
        assert sorted(map(tuple, out.collect()), key=repr) == brute_manifest(rows, arity, tampered)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs, merkle.leaf(F.col("text")), F.col("lang"), F.col("doc_id")).collect() == []


def test_ranked_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 7).alias("v"), F.rand(1).alias("lot"))
    got = ranked(stored(rows, "test-rows"), [F.col("v").desc(), F.col("lot")], "g").toPandas()
    for _, g in got.groupby("g"):
        g = g.sort_values(["v", "lot"], ascending=[False, True])
        assert list(g.idx) == list(range(len(g))) and (g.n == len(g)).all()


def test_merkle_and_importance_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for f in (queries.op11_merkle, queries.op12_importance):
        out, want = f(spark, SF), con.sql(queries.oracle_sql()[f.__name__])
        assert sorted(map(repr, map(tuple, out.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


WORDS = b"0123456789abcdefghijklmnopqrstuvwxyz"


def brute_features(text, m=importance.BUCKETS):
    data = (text or "").encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = bytes(b if b in WORDS or b >= 128 else 32 for b in data).split(b" ")
    words = [w for w in words if w]
    return [zlib.crc32(b" ".join(words[k : k + n])) % m for n in (1, 2, 3) for k in range(len(words) - n + 1)], len(words)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ09 -\n\t_é漢\x00\x7f", max_size=60)), max_size=8), st.sampled_from([1, 7, 1 << 20]), st.sampled_from([1, 5, 200_000]))
@settings(max_examples=150, deadline=None)
def test_features_in_pieces(texts, piece, chunk):
    kept = importance.PIECE, importance.CHUNK_WORDS, importance.CACHE_WORDS
    importance.PIECE, importance.CHUNK_WORDS, importance.CACHE_WORDS = piece, chunk, 9
    try:
        got, n = [[] for _ in texts], [0] * len(texts)
        for words, of, bucket in importance.found([None if t is None else t.encode() for t in texts], importance.Hasher()):
            for i, b in zip(of.tolist(), bucket.tolist(), strict=True):
                got[i].append(b)
            for i in words.tolist():
                n[i] += 1
    finally:
        importance.PIECE, importance.CHUNK_WORDS, importance.CACHE_WORDS = kept
    assert [(sorted(g), k) for g, k in zip(got, n, strict=True)] == [(sorted(f), k) for f, k in map(brute_features, texts)]


def test_resampling_against_brute_force(spark):
    rows = [*ROWS, (400, "one two three " * 50, "en", "s", 1, "x", "y", 1, 2, 3), *[(401, "tied words " * 12, "en", "s", 1, "x", "y", 1, 2, 3)] * 3]
    target = ["one two", None, "", "Über word text1"]
    docs, goal = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    found = [brute_features(r[1]) for r in rows]
    s, t = Counter(b for f, _ in found for b in f), Counter(b for x in target for b in brute_features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    want = []
    for (i, *_), (f, n) in zip(rows, found, strict=True):
        u = int(h(f"42:{'null' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296.0)))))
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    for share in ((5, 100), (1, 2), (0, 1), (1, 1)):
        drawn = [(x, k + 1) for k, x in enumerate(able[: share[0] * len(able) // share[1]])]
        rest = [(x, None) for x in able[len(drawn) :] + [x for x in want if x[1] < 20]]
        got = importance.resampled(docs, goal, share).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(repr((*x, k)) for x, k in drawn + rest)
    nothing = docs.limit(0)
    assert importance.resampled(nothing, goal).count() == 0
    assert {r.rank for r in importance.resampled(docs, goal.limit(0), (1, 1)).collect()} == {None, *range(1, len(able) + 1)}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_padding()
    found.no_truncation()
    return found


def differing(library, texts):
    out = []
    for text, ids in zip(texts, bpe.model(PATH).encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        if want != ids.tolist() or library.decode(want, skip_special_tokens=False) != bpe.model(PATH).decode(ids):
            out.append(text)
    return out


def test_every_character(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 4000):
        assert differing(library, [f"a{c}b1{c}{c} {c}" for c in chars[k : k + 4000]]) == []


@given(st.text(alphabet="abcdeinorst hTE'<|>endofxΣ̃éｱ1\n\x85", max_size=40))
@settings(max_examples=400, deadline=None)
def test_random_texts(library, text):
    assert differing(library, [text]) == []


def test_odd_texts(library):
    odd = ["", "  \n", "<|startoftext|>Hello<|endoftext|><|END|>", "ΑΣ ΑΣΑ İstanbul", "it's we'LL 'S '' don't''t", "e" * 5000, "ab" * 60_000, "漢字" * 3000, "supercalifragilistic" * 800, "x" * 65, "\x00\x01 \x1c"]
    assert differing(library, odd) == []


def test_verification_is_exact():
    m, rng = bpe.Model(PATH), np.random.default_rng(3)
    words = list({"".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 14))) for _ in range(4000)})
    texts = [w + bpe.END for w in words]
    guesses, exact = [m.proposed(t) for t in texts], [m.merged(t) for t in texts]
    fits = [len(g) == 1 or bool(m.compatible(np.array(g[:-1]), np.array(g[1:])).all()) for g in guesses]
    assert fits == [g == e for g, e in zip(guesses, exact, strict=True)] and 0 < sum(fits) < len(fits)


def test_encoded_rows(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for r in bpe.encoded(docs.unionByName(docs.limit(5)), PATH).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).where("doc_id < 300").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encoded(docs.limit(0), PATH).collect() == [] and bpe.encoded(docs, PATH).count() == len(ROWS)


def test_file_with_other_steps_is_refused(tmp_path):
    with pytest.raises((ValueError, KeyError, AttributeError)):
        bpe.Model(public_tokenizers.path("byte_bpe_50k.json"))
