"""Quality rules: base counts and a distribution-divergence verdict.

Base counts come from the words of the whole text. The verdict compares a document's
character-class histogram (classes are Unicode categories) and its common-word histogram with a
reference for each language by Jensen-Shannon distance, and takes the nearest reference. References
are counts over all documents of a language, so one document hardly moves them.

Words that are not common are no cell of the common-word histogram: they are most of any text and
would hide the others. Instead, what a document lacks of its reference's share of common words is
a cell that the reference has nothing in, so a text without common words is at distance 1.

Limits come from the spread of all documents around their nearest reference: its upper quartile and
``SPREAD`` times its interquartile range more, but no less and no more than the bounds below, so that
neither a very even corpus rejects ordinary prose nor a very mixed one keeps everything.

Guards: the character-class distance is used from ``MIN_CHARS`` characters on, the common-word
distance from ``MIN_WORDS`` words on, and each reference by itself only judges texts of which it lets
expect ``MIN_COMMON`` common words. A text that is too short for a reference is not judged by its
words at all if its characters are like that reference's, since it may be of that language; else the
other references judge it. Documents whose language has a name but no reference pass the
divergence test: a reference is made from ``MIN_REFERENCE`` words on.

References are a stored table; documents meet them in blocks of about ``BLOCK_REFERENCES``, each sent
to all tasks, and keep the nearest of all blocks. With that many languages or fewer there is one block.

Null and empty texts have no words and fail the base rules. Null languages serve as no reference.
Repeated rows give repeated results; an empty table gives an empty result. Other columns of the input
are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import BATCH_ROWS, forget, mapped, stored

MIN_WORDS, MIN_CHARS, MIN_REFERENCE = 50, 200, 1000
#: Least and greatest limits of the class distance and of the word distance.
CLASS_LIMITS, WORD_LIMITS, SPREAD = (0.25, 0.30), (0.75, 0.90), 3.0
#: Common words that a text of some language has by expectation; fewer can be none by chance.
MIN_COMMON = 12
COMMON_WORDS = 64
#: Words whose counts a task holds; references that a task holds, and whose limits are broadcast.
HELD_WORDS, BLOCK_REFERENCES = 200_000, 5_000
WINDOW = 8
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Character classes by Unicode category; white space is a class of its own, all other categories are the last.
CLASSES = (("Ll",), ("Lu", "Lt"), ("Lm", "Lo"), ("Mn", "Mc", "Me"), ("Nd", "Nl", "No"), ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po"), ("Sm", "Sc", "Sk", "So"))
N_CLASSES = len(CLASSES) + 2


@functools.cache
def _class_of() -> np.ndarray:
    """The class of every code point."""
    by = {c: k for k, cs in enumerate(CLASSES) for c in cs}
    out = np.fromiter((by.get(unicodedata.category(chr(p)), N_CLASSES - 1) for p in range(0x110000)), np.int8, 0x110000)
    out[[p for p in range(0x3001) if chr(p).isspace()]] = N_CLASSES - 2
    return out


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=N_CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of q from p."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


class References:
    """References as arrays, and the place of each common word in them."""

    def __init__(self, refs: pd.DataFrame) -> None:
        self.langs = refs.lang.tolist()
        self.classes = np.array(refs.classes.tolist(), float).reshape(-1, N_CLASSES)
        self.shares = np.zeros((len(refs), COMMON_WORDS + 1))  # of a text's common words; the last cell is what it lacks
        self.common = np.zeros(len(refs))
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (words, shares) in enumerate(zip(refs.words, refs.word_shares, strict=True)):
            self.common[k] = 1 - shares[-1]
            self.shares[k, : len(words)] = np.asarray(shares[:-1]) / self.common[k]
            for j, w in enumerate(words):
                self.places.setdefault(w, []).append((k, j))

    def by_class(self, counts: np.ndarray) -> np.ndarray:
        """Distance of a text of these class counts from each reference."""
        return js_distance(counts / counts.sum(), self.classes)

    def by_words(self, low: dict[str, int], n: int) -> np.ndarray:
        """Distance of a text of n words, low: how often each, from each reference; nan where it lets expect
        fewer than MIN_COMMON common words."""
        got = np.zeros_like(self.shares)
        for w, many in low.items():
            for k, j in self.places.get(w, ()):
                got[k, j] = many
        found = got.sum(1)
        lacking = np.maximum(0.0, 1 - found / (n * self.common))
        p = got / np.maximum(found, 1)[:, None] * (1 - lacking)[:, None]
        p[:, -1] = lacking
        return np.where(n * self.common < MIN_COMMON, np.nan, js_distance(p, self.shares))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A stored table: lang, classes (their shares), words (the most common), word_shares (theirs, then all others').

    Counted over all documents in one pass: counts are summed in each task, let go at HELD_WORDS
    words, and only then shuffled, so a hot language or word costs a few rows for each task."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # lang -> [class counts, all words, count of each word]

        def let_go() -> Iterator[pa.RecordBatch]:
            for lang, (classes, n, words) in held.items():
                kinds = [f"c{k}" for k in range(N_CLASSES)] + ["n"] + ["w"] * len(words)
                names = [None] * (N_CLASSES + 1) + [w.decode("utf-8", "replace") for w in words]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "kind": pa.array(kinds, pa.string()), "word": pa.array(names, pa.string()), "n": pa.array([*classes.tolist(), n, *words.values()], pa.int64())})
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    mine = held.setdefault(lang, [np.zeros(N_CLASSES, np.int64), 0, {}])
                    mine[0] += class_counts(t)
                    every, words = t.lower().encode("utf-8", "surrogatepass").split(), mine[2]
                    for w in every:
                        words[w] = words.get(w, 0) + 1
                    mine[1] += len(every)
                if sum(len(x[2]) for x in held.values()) > HELD_WORDS:
                    yield from let_go()
        yield from let_go()

    have = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    summed = stored(have.mapInArrow(counts, "lang string, kind string, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "quality-counts")
    totals = summed.where("kind <> 'w'").groupBy("lang").agg(F.sum(F.when(F.col("kind") == "n", F.col("n"))).alias("total"), *(F.sum(F.when(F.col("kind") == f"c{k}", F.col("n"))).alias(f"c{k}") for k in range(N_CLASSES)))
    # a limit by rank is applied before the shuffle too: a hot language sends COMMON_WORDS rows from each task
    ranked = summed.where("kind = 'w'").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON_WORDS)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("top"))  # COMMON_WORDS at most
    chars = sum((F.col(f"c{k}") for k in range(N_CLASSES)), F.lit(0))
    share = F.transform("top", lambda x: -x.less / F.col("total"))
    others = (F.col("total") + F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x.less)) / F.col("total")
    refs = totals.where(F.col("total") >= MIN_REFERENCE).join(top, "lang").select("lang", F.array(*(F.col(f"c{k}") / chars for k in range(N_CLASSES))).alias("classes"), F.col("top.word").alias("words"), F.concat(share, F.array(others)).alias("word_shares"))
    found = stored(refs, "quality-references")
    forget(summed)
    return found


def repeated_window_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    names, span = ids.astype(np.int64), 1
    while span < width:  # names of windows of 1, 2, 4, 8 words: equal names, equal words
        step = min(span, width - span)
        m = len(names) - step
        names = np.unique(names[:m] * (int(names.max()) + 1) + names[step : step + m], return_inverse=True)[1]
        span += step
    found = np.bincount(names)[names] > 1
    if not found.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(found), 1)
    np.add.at(edge, np.flatnonzero(found) + width, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def judge(text: str | None, refs: References) -> tuple:
    """The counts, base_failed, the nearest reference by classes and by words with its distance, None where a
    guard holds, and whether a reference excuses its words, of one text."""
    if text is None:
        text = ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, names = len(words), {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeat = repeated_window_words(ids)
    failed = n < 20 or 100 * repeat > 30 * n
    by_class, by_words, excused = (None, None), (None, None), False
    if refs.langs and (len(text) >= MIN_CHARS or n >= MIN_WORDS):
        far = refs.by_class(class_counts(text))
        if len(text) >= MIN_CHARS:
            by_class = (refs.langs[int(far.argmin())], float(far.min()))
        if n >= MIN_WORDS:
            low: dict[str, int] = {}
            for w, k in zip(names, np.bincount(ids, minlength=len(names)).tolist(), strict=True):
                w = w.decode("utf-8", "surrogatepass").lower()
                low[w] = low.get(w, 0) + k
            each = refs.by_words(low, n)
            excused = bool((far[np.isnan(each)] <= CLASS_LIMITS[1]).any())
            if not np.isnan(each).all():
                by_words = (refs.langs[int(np.nanargmin(each))], float(np.nanmin(each)))
    return n, chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat, failed, *by_class, *by_words, excused


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_lang string, class_distance double, word_lang string, word_distance double"


def limits(judged: DataFrame, lang_col: str, distance_col: str, least: float, most: float) -> DataFrame:
    """lang_col, limit: how far from each reference its documents may lie. Distances are counted by
    thousandths, so a language is at most a thousand rows and the quartiles don't depend on any order."""
    cells = judged.where(F.col(distance_col).isNotNull()).groupBy(lang_col, F.round(distance_col, 3).alias("d")).agg(F.count("*").alias("n"))
    low, high = (F.percentile("d", F.lit(q), F.col("n")) for q in (0.25, 0.75))
    spread = cells.groupBy(lang_col).agg(low.alias("low"), high.alias("high"))
    return spread.select(lang_col, F.least(F.lit(most), F.greatest(F.lit(least), F.col("high") + F.lit(SPREAD) * (F.col("high") - F.col("low")))).alias(distance_col.replace("distance", "limit")))


def judged_by(slim: DataFrame, block: DataFrame) -> DataFrame:
    """The columns of slim but its text, FIELDS, excused, and named: whether the row's language is in the block."""
    pdf = block.toPandas()  # about BLOCK_REFERENCES rows

    def make():
        refs = References(pdf)

        def judging(texts: list[str | None]) -> list[pa.Array]:
            rows = [judge(t, refs) for t in texts]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_()]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return judging

    keep = [c for c in slim.columns if c != "text"]
    judged = mapped(slim, "text", make, FIELDS + ", excused boolean", keep)
    named = block.select(F.col("lang").alias("__lang"), F.lit(True).alias("named"))
    return judged.join(F.broadcast(named), F.col("lang") == F.col("__lang"), "left").drop("__lang").withColumn("named", F.col("named").isNotNull())


def nearest(slim: DataFrame, refs: DataFrame, per_block: int) -> DataFrame:
    """A stored table: the columns of slim but its text, FIELDS, excused and named, by all references."""
    blocks = max(1, -(-refs.count() // per_block))
    if blocks == 1:
        return stored(judged_by(slim, refs), "quality-judged")
    numbered = stored(slim.withColumn("__row", F.monotonically_increasing_id()), "quality-rows")
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    parts = [stored(judged_by(numbered, refs.where(block == b)), "quality-block") for b in range(blocks)]
    one = functools.reduce(DataFrame.unionAll, parts)
    same = [c for c in one.columns if c not in ("__row", "class_lang", "class_distance", "word_lang", "word_distance", "excused", "named")]
    least = {k: F.min(F.when(F.col(f"{k}_distance").isNotNull(), F.struct(f"{k}_distance", f"{k}_lang"))) for k in ("class", "word")}
    whole = one.groupBy("__row").agg(*(F.first(c).alias(c) for c in same), *(v.alias(k) for k, v in least.items()), F.bool_or("excused").alias("excused"), F.bool_or("named").alias("named"))
    found = stored(whole.select(*same, "class.class_lang", "class.class_distance", "word.word_lang", "word.word_distance", "excused", "named"), "quality-judged")
    forget(numbered, *parts)
    return found


def quality(docs: DataFrame, refs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_block: int = BLOCK_REFERENCES) -> DataFrame:
    """doc_id, FIELDS, class_limit, word_limit and kept of every row. refs: of language_references();
    counted over docs if None. per_block: references that a task holds at a time, on average."""
    refs = language_references(docs, text_col, lang_col) if refs is None else refs
    all_judged = nearest(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), refs, per_block)
    judged = all_judged.withColumns({f"word_{x}": F.when(~F.col("excused"), F.col(f"word_{x}")) for x in ("lang", "distance")})

    def beyond(what: str) -> Column:
        return F.coalesce(F.col(f"{what}_distance") > F.col(f"{what}_limit"), F.lit(False))

    # a row for each reference at most; sent to all tasks, so a hot language isn't one task
    few = F.broadcast if refs.count() <= BLOCK_REFERENCES else lambda df: df
    both = judged.join(few(limits(judged, "class_lang", "class_distance", *CLASS_LIMITS)), "class_lang", "left").join(few(limits(judged, "word_lang", "word_distance", *WORD_LIMITS)), "word_lang", "left")
    no_reference = F.col("lang").isNotNull() & ~F.col("named")
    kept = ~F.col("base_failed") & (no_reference | ~(beyond("class") | beyond("word")))
    return both.select("doc_id", *(x.split()[0] for x in FIELDS.split(", ")), "class_limit", "word_limit", kept.alias("kept"))
