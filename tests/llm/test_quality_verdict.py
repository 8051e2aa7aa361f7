"""The verdict of the quality rules, recomputed from the texts with dictionaries."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd

from filterlab.llm import quality

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"


def words_of(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def class_of(c):
    if ord(c) < 0x3001 and c.isspace():
        return "white"
    return next((k for k, cs in enumerate(quality.CLASSES) if unicodedata.category(c) in cs), "other")


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items() if n}


def distance(p, q):
    def bits(d):
        return -sum(x * math.log2(x) for x in d.values() if x)

    middle = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0.0, bits(middle) - (bits(p) + bits(q)) / 2))


def brute_references(rows):
    classes, words = {}, {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            classes.setdefault(lang, Counter()).update(map(class_of, text))
            words.setdefault(lang, Counter()).update(words_of(text.lower()))
    found = {}
    for lang, counts in words.items():
        if (total := sum(counts.values())) >= quality.MIN_REFERENCE:
            top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON_WORDS]
            found[lang] = (shares(classes[lang]), dict(top), sum(n for _, n in top) / total)
    return found


def brute_word_distance(text, common, covered):
    """None if the text is too short for the reference."""
    words = words_of(text)
    if len(words) * covered < quality.MIN_COMMON:
        return None
    got = {w: n for w, n in Counter(w.lower() for w in words).items() if w in common}
    lacking = max(0.0, 1 - sum(got.values()) / (len(words) * covered))
    mine = {w: n / sum(got.values()) * (1 - lacking) for w, n in got.items()} | {None: lacking}
    return distance(mine, shares(common))


def brute_limit(distances, least, most):
    low, high = np.percentile([round(d, 3) for d in distances], [25, 75])
    return min(most, max(least, high + quality.SPREAD * (high - low)))


def brute_verdict(rows):
    """Of each row: nearest class distance, nearest word distance, kept unless the base rules fail."""
    refs, out = brute_references(rows), []
    for _, text, lang in rows:
        text, by_class, by_words = text or "", None, None
        far = {k: distance(shares(Counter(map(class_of, text))), r[0]) for k, r in refs.items()} if text else {}
        if far and len(text) >= quality.MIN_CHARS:
            by_class = min((d, k) for k, d in far.items())
        if far and len(words_of(text)) >= quality.MIN_WORDS:
            each = {k: brute_word_distance(text, r[1], r[2]) for k, r in refs.items()}
            if not any(d is None and far[k] <= quality.CLASS_LIMITS[1] for k, d in each.items()):
                by_words = min(((d, k) for k, d in each.items() if d is not None), default=None)
        out.append((by_class, by_words, lang is not None and lang not in refs))
    for which, bounds in ((0, quality.CLASS_LIMITS), (1, quality.WORD_LIMITS)):
        by = {}
        for row in out:
            if row[which]:
                by.setdefault(row[which][1], []).append(row[which][0])
        limit = {k: brute_limit(ds, *bounds) for k, ds in by.items()}
        out = [(*row, bool(row[which]) and row[which][0] > limit[row[which][1]]) for row in out]
    return [(row[0], row[1], row[2] or not (row[3] or row[4])) for row in out]


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id long, text string, lang string, word_lang string, class_limit double, named boolean").repartition(3)
    got = {r.doc_id: r for r in quality.quality(df, **options).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (by_class, by_words, kept) in zip(rows, brute_verdict(rows), strict=True):
        r = got[i]
        for want, d in ((by_class, r.class_distance), (by_words, r.word_distance)):
            assert (want is None) == (d is None) and (want is None or abs(want[0] - d) < 1e-6), i
        assert r.kept == (kept and not r.base_failed), i
    return got


def test_verdict_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(9)
    noise = [" ".join("".join(rng.choice(list("aeinrst"), 6)) for _ in range(120)) for _ in range(3)]
    rows += [(10_000, noise[0], "en"), (10_001, noise[1], "xx"), (10_002, noise[2], None), (10_003, None, "en"), (10_004, "", None), (10_005, "≈∑∂ " * 80, "fr"), (10_006, rows[0][1] * 30, "de")]
    got = compare(spark, rows)
    assert not got[10_000].kept and got[10_001].kept and not got[10_002].kept
    again = compare(spark, rows, per_block=1)  # references in several blocks
    assert {i: r.kept for i, r in got.items()} == {i: r.kept for i, r in again.items()}


def test_a_reference_of_rare_words_guards_its_own_texts_only(spark):
    """A language without frequent words excuses short texts in its script, and leaves all others to their references."""
    rng = np.random.default_rng(4)
    latin = ["".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(2000)]
    p = 1 / np.arange(1, 2001)
    signs = [chr(0x4E00 + k) for k in range(6000)]
    rows = [(k, " ".join(rng.choice(latin, 150, p=p / p.sum())), "la") for k in range(40)]
    rows += [(100 + k, " ".join("".join(rng.choice(signs, 3)) for _ in range(80)), "zz") for k in range(40)]
    salad = " ".join("".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(100))
    got = compare(spark, [*rows, (999, salad, None)])
    assert all(got[i].kept for i, _, _ in rows) and all(got[i].word_distance is None for i in range(100, 140))
    assert not got[999].kept and got[999].word_lang == "la"


def test_no_reference_at_all(spark):
    df = spark.createDataFrame([(1, "word " * 7 + "and some other words that nobody repeats " * 1 + "one two three four five six seven eight", None)], "doc_id long, text string, lang string")
    row = quality.quality(df).first()
    assert row.kept and row.class_distance is None and row.word_limit is None
    assert pd.DataFrame(quality.language_references(df.limit(0)).collect()).empty
