import random

import pytest
import xxhash

from filterlab.llm import line_dedup

SF = "/root/testdata/sf0.001"


def brute_dropped(rows, similarity=0.8):
    """{(doc_id, text): dropped positions} by comparing all pairs of distinct lines."""
    def row(t):  # Spark's hash of the text, which orders the rows of an id
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (h - (1 << 64 if h >> 63 else 0)) % 10**9

    lines = [(i, row(t), p, x, t) for i, t in rows if i is not None and t is not None for p, x in enumerate(t.split("\n")) if any(c.isalpha() or c.isnumeric() for c in x)]
    distinct = sorted({x for _, _, _, x, _ in lines})
    sets = [{x[k : k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in distinct]
    parent = list(range(len(distinct)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = {}
    for k, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in index[g]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                parent[max(root(k), root(j))] = min(root(k), root(j))
    at = {x: root(k) for k, x in enumerate(distinct)}
    first, out = {}, {}
    for i, h, p, x, t in sorted(set(lines)):
        if first.setdefault(at[x], (i, h, p)) != (i, h, p):
            out.setdefault((i, t), []).append(p)
    return out


def test_hot_bands_give_the_same_members(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    lines = line_dedup.lines_of(docs, "doc_id", "text").select("key", "line")
    want = sorted(map(tuple, line_dedup.band_members(lines).collect()))
    monkeypatch.setattr(line_dedup, "SAMPLED", 2)
    monkeypatch.setattr(line_dedup, "HOT_SAMPLES", 3)  # some bands are hot now, others aren't
    assert want and sorted(map(tuple, line_dedup.band_members(lines).collect())) == want


def test_nodes_are_joined_without_their_lines(spark):
    texts = spark.createDataFrame([(1, "a line"), (2, "another"), (3, "more")], "key long, line string")
    found = line_dedup.rooted(texts, spark.createDataFrame([(2, 1)], "node long, root long"))
    assert sorted((r.node, r.root) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert {(r.key, r.c) for r in texts.selectExpr("key", "hash(line) c").collect()} == {(r.node, r.node_check) for r in found.collect()}
    join = found._jdf.queryExecution().optimizedPlan().children().head()
    assert join.nodeName() == "Join" and "line#" not in join.output().mkString(" ")


def test_a_pair_makes_its_set_once(spark):
    texts = spark.createDataFrame([(1, "a line"), (2, "another")], "key long, line string")
    plan = line_dedup.verified(spark.createDataFrame([(1, 2)], "a long, b long"), texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 2 and plan.count("array_intersect(") == 1  # one for each side, written out in no filter


def test_similar_lines_pass_every_sketch(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(60):  # lines with repeats, and copies of them with a few characters changed
        x = [rng.choice("abcdé漢 ") for _ in range(rng.randrange(8, 400))] * rng.randrange(1, 4)
        y = list(x)
        for _ in range(rng.randrange(1, 9)):
            y[rng.randrange(len(y))] = "#"
        rows += [(2 * k, "".join(x)), (2 * k + 1, "".join(y))]
    sets = {k: {x[j : j + line_dedup.SHINGLE] for j in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for k, x in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= line_dedup.SIMILARITY * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(rows, "key long, line string")
    every = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    sketched = line_dedup.sketches(texts).cache()
    short = line_dedup.folded(sketched)
    assert {r.key: r.n for r in short.collect()} == {k: len(s) for k, s in sets.items()}
    both = every.join(line_dedup.suffixed(short, "_a", key="a"), "a").join(line_dedup.suffixed(short, "_b", key="b"), "b")
    first = {(r.a, r.b) for r in both.where(line_dedup.may_match("_a", "_b", line_dedup.FOLDED_WORDS)).select("a", "b").collect()}
    second = {(r.a, r.b) for r in line_dedup.closer(every, sketched).collect()}
    assert alike and alike <= second <= first and len(first) < every.count() / 2
    assert {(r.a, r.b) for r in line_dedup.verified(every, texts).collect()} == alike


def odd_rows():
    rng = random.Random(12)
    words = ["river", "stone", "Straße", "漢字", "walks", "under", "bridge", "slowly", "1984", "evening"]
    base = [" ".join(rng.choices(words, k=rng.randrange(6, 40))) for _ in range(60)]
    rows = [(k, "\n".join([base[k], "short", "", "short", base[(k * 7) % 60]])) for k in range(60)]
    x = list(" ".join(rng.choices(words, k=60)))
    for k in range(150):  # a drifting chain of near copies, and a group around one line
        x[rng.randrange(len(x))] = rng.choice("abcdefgh")
        y = list(base[0] + base[1])
        y[rng.randrange(len(y))] = "#"
        rows.append((1000 + k, "".join(x) + "\n" + "".join(y)))
    return rows + [(2000, None), (2001, ""), (None, base[3]), (2002, base[4]), (2002, base[4]), (2003, "long " * 20_000 + "\n" + "long " * 20_000), (-5, base[5])] + SHARED


#: Rows of one id with lines of their own and a line that all have.
SHARED = [(3001, "A line that rows of this id share"), (3002, "Another opening of the text\nA line that rows of this id share"), (3002, "B has a quite different opening\nZebra crossing notes that nobody else ever wrote down"), (3002, "A line that rows of this id share\nThird text of the id")]


def test_lines_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for some in (rows, odd_rows()):
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in some], "doc_id long, text string, key string, pos int").repartition(5)
        want = brute_dropped(some)
        assert sorted((r.doc_id, r.dropped) for r in line_dedup.dropped_lines(df).collect()) == sorted((i, gone) for (i, _), gone in want.items())
        report = line_dedup.line_report(df).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_kept) for r in report) == sorted((str(i), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(want.get((i, t), []))) for i, t in some)
        cleaned = line_dedup.without_copies(df)
        assert cleaned.columns == df.columns
        assert sorted((str(r.doc_id), r.text or "") for r in cleaned.collect()) == sorted((str(i), "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in want.get((i, t), []))) for i, t in some)
    assert line_dedup.line_report(df.limit(0)).count() == 0 and line_dedup.without_copies(df.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    for i, j, kind in ((1.2, 1.4, "double"), ("a", "b", "string")):
        df = spark.createDataFrame([(i, "a line that is copied\nits own first line"), (j, "a line that is copied\nmore of the other"), (j, "yet another text of this id")], f"doc_id {kind}, text string")
        assert sorted((r.doc_id, r.text) for r in line_dedup.without_copies(df).collect()) == [(i, "a line that is copied\nits own first line"), (j, "more of the other"), (j, "yet another text of this id")]


def test_pipeline_keeps_texts_that_share_an_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in SHARED] + [(None, None, None, None, None), (7, None, None, None, 1), (8, "", "en", "s", 0)], schema)
    left = pipeline.lines(spark, docs, SF)
    assert left.columns == docs.columns and any("Zebra crossing notes" in (r.text or "") for r in left.collect())
    single = pipeline.near_duplicates(spark, left, SF)
    assert sum("Zebra crossing notes" in (r.text or "") for r in single.collect()) == 1
    for name, stage in pipeline.STAGES:  # nothing, and nulls only
        for some in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None)] * 3, schema)):
            stage(spark, some, SF).collect()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    from filterlab.llm.common import stored
    from tests.llm.test_mixing_sharding_quality import brute_targets
    from tests.llm.test_vectors_chat_simhash import brute_components, brute_print

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), "test-stage"))
        if name != "tokens":
            assert seen[-1].columns == docs.columns
    raw, named, lined, single, mixed, coded = ([r.asDict() for r in s.collect()] for s in seen)
    assert len(named) >= 0.98 * len(raw) and all(r["text"] for r in named)
    gone = brute_dropped([(r["doc_id"], r["text"]) for r in named])
    want = {r["doc_id"]: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in gone.get((r["doc_id"], r["text"]), [])) for r in named}
    assert {r["doc_id"]: r["text"] for r in lined} == {i: t for i, t in want.items() if t.strip()}
    lined.sort(key=lambda r: r["doc_id"])
    roots = brute_components([brute_print(r["text"]) for r in lined])
    assert sorted(r["doc_id"] for r in single) == sorted(lined[k]["doc_id"] for k in set(roots))
    size = {r["doc_id"]: len(r["text"].split()) for r in single}
    sources, taken = {}, {}
    for r in single:
        sources[r["source"]] = sources.get(r["source"], 0) + size[r["doc_id"]]
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    for s, t in brute_targets(sources, (5, 2, 1), 3).items():
        assert abs(taken.get(s, 0) - t) <= max(size.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed) and all(r["ids"] == sp.encode(by[r["doc_id"]]) and r["decoded"] == by[r["doc_id"]].replace("▁", " ") for r in coded)
