"""Importance resampling towards a target distribution, in two Arrow passes over hashed n-grams.

A text's features are all runs of one to three consecutive words, hashed into ``BUCKETS`` buckets. The first
pass counts: each partition has one vector of np.bincount over its features, and treeReduce merges the vectors,
so the driver gets one vector of fixed length however many rows there are. The gain of a bucket is the
logarithm of its smoothed share in the target over that in the rows. The second pass gathers the broadcast
gains (``BUCKETS`` numbers) and sums them by document with np.bincount's weights. Gumbel noise from a hash of the id
makes the highest scores a draw without replacement in proportion to exp(weight / 1000).

A feature's bucket is the CRC-32 of its bytes. CRCs are linear: that of a run is made from those of its words
by table lookups (see ``Shifts``), so each distinct word is hashed once and runs are never written out.

Texts are lower-cased in A-Z only; a word is a run of digits, those letters and characters beyond ASCII. Null texts
have no words. Texts are handled in pieces of ``PIECE`` bytes that know the two words before them; words
are never cut. Rows with fewer words than ``min_words`` are scored but never drawn. Ties of the score go to the
smaller id, null ids last; a null id draws the noise of the text ``null``. Repeated rows are rows of their own, and
rows alike in score and id take their ranks in any order. Empty tables count nothing and draw nothing. Other
columns of the inputs are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filterlab.llm.common import ranked, stored

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bytes of a text that are cut into words at a time; words that are hashed at a time; distinct words and lengths that a worker keeps.
PIECE, CHUNK_WORDS, CACHE_WORDS, CACHE_LENGTHS = 1 << 20, 200_000, 400_000, 2_000
#: Gains and scores are whole thousandths.
UNIT = 1000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes at a time."""
    if text is None:
        return
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(_WORD_BYTES)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # a word longer than a piece
                more = text[end : end + PIECE].translate(_WORD_BYTES)
                found = more.find(b" ")
                part += more if found < 0 else more[: found + 1]
                end += len(more) if found < 0 else found + 1
                cut = -1 if found < 0 else len(part) - 1
            if cut >= 0:
                end -= len(part) - cut - 1
                part = part[: cut + 1]
        yield part.split()
        at = end


class Shifts:
    """What appending n bytes does to a CRC, by tables: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self) -> None:
        self.slots: dict[int, int] = {}
        self.tables = np.empty((64, 4, 256), np.uint32)

    def slot(self, n: int) -> int:
        found = self.slots.get(n)
        if found is None:
            k = found = len(self.slots)
            if k == len(self.tables):
                self.tables = np.concatenate([self.tables, np.empty_like(self.tables)])
            zeros = bytes(n)
            none = zlib.crc32(zeros)
            for byte in range(4):
                row = self.tables[k, byte]
                row[0] = 0
                for bit in range(8):
                    row[1 << bit : 2 << bit] = row[: 1 << bit] ^ np.uint32(zlib.crc32(zeros, 1 << (8 * byte + bit)) ^ none)
            self.slots[n] = k
        return found

    def joined(self, a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The CRCs of texts a + b, from those of a and b and the slots of b's lengths."""
        at = slot.astype(np.int64) << 10
        flat = self.tables.reshape(-1)
        out = b.copy()
        for byte in range(4):
            out ^= flat[at + (byte << 8) + ((a >> np.uint32(8 * byte)) & np.uint32(255))]
        return out


class Hasher:
    """Buckets of the features of words. Words' hashes are kept in a bounded cache of each worker."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets = np.uint32(buckets)
        self._fresh()

    def _fresh(self) -> None:
        self.shifts = Shifts()
        self.index: dict[bytes, int] = {}
        self.plain, self.spaced, self.slot, self.slot_spaced = array("I"), array("I"), array("I"), array("I")

    def ids(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.index)
        if new and (len(self.index) + len(new) > CACHE_WORDS or len(self.shifts.slots) > CACHE_LENGTHS):
            self._fresh()
            new = set(words)
        for w in new:
            self.index[w] = len(self.plain)
            c = zlib.crc32(w)
            self.plain.append(c)
            self.spaced.append(zlib.crc32(b" ", c))
            self.slot.append(self.shifts.slot(len(w)))
            self.slot_spaced.append(self.shifts.slot(len(w) + 1))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def features(self, words: list[bytes], place: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, bucket) of every feature that ends at a word which isn't skipped. place: the
        words before it in its text, those that are at hand."""
        at = self.ids(words)
        plain, spaced, slot, slot_spaced = (np.frombuffer(x, np.uint32)[at] for x in (self.plain, self.spaced, self.slot, self.slot_spaced))
        one = np.flatnonzero(~skip)
        where, crc = [one], [plain[one]]
        two = np.flatnonzero(~skip & (place >= 1))
        where.append(two)
        crc.append(self.shifts.joined(spaced[two - 1], plain[two], slot[two]))
        three = np.flatnonzero(~skip & (place >= 2))
        before = self.shifts.joined(spaced[three - 2], spaced[three - 1], slot_spaced[three - 1])
        where.append(three)
        crc.append(self.shifts.joined(before, plain[three], slot[three]))
        return np.concatenate(where), (np.concatenate(crc) % self.buckets).astype(np.int64)


def found(texts: Iterable[bytes | None], hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, number of words) and (text, bucket) of the features of many texts, some CHUNK_WORDS words at a time, as
    (texts of words, texts of features, buckets)."""
    words: list[bytes] = []
    doc: list[np.ndarray] = []
    place: list[np.ndarray] = []
    skip: list[np.ndarray] = []
    held = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, at, out = np.concatenate(doc), np.concatenate(place), np.concatenate(skip)
        where, bucket = hasher.features(words, at, out)
        result = of[~out], of[where], bucket
        for x in (words, doc, place, skip):
            x.clear()
        return result

    for i, text in enumerate(texts):
        before: list[bytes] = []
        for new in pieces(text):
            if not new:
                continue
            n = len(before) + len(new)
            words += before + new
            doc.append(np.full(n, i, np.int64))
            place.append(np.arange(n))
            skip.append(np.arange(n) < len(before))
            before = (before + new)[-(LONGEST_RUN - 1) :]
            held += n
            if held >= CHUNK_WORDS:
                yield done()
                held = 0
    if words:
        yield done()


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in found((x.as_py() for x in batch.column(0)), hasher):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["vector"])

    vectors = rows.select(rows[text_col].cast("binary").alias("text")).mapInArrow(count, "vector binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r.vector, np.int64)).treeReduce(np.add, depth=3)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share of the target over that of the source, rounded down."""
    m, t_all, s_all = len(source), float(target.sum()), float(source.sum())
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of rows (all if None), n_words, n_features and weight, the sum of the features' gains."""
    kept = rows.columns if keep is None else keep
    fields = ["n_words", "n_features", "weight"]
    sent = rows.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        hasher = Hasher(len(value))
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((3, n))
            for of_word, of_feature, bucket in found((x.as_py() for x in batch.column(len(kept))), hasher):
                sums[0] += np.bincount(of_word, minlength=n)
                sums[1] += np.bincount(of_feature, minlength=n)
                sums[2] += np.bincount(of_feature, value[bucket], n)  # whole numbers below 2**53: exact
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array(x.astype(np.int64)) for x in sums)], [*kept, *fields])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} bigint" for c in fields)])
    return rows.select(*kept, rows[text_col].cast("binary").alias("__text")).mapInArrow(weigh, schema)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log(u))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null where the row isn't drawn."""
    gain = gains(bucket_counts(target, target_col), bucket_counts(docs, text_col))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = weighed(slim, gain, "text", ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumns({"lot": F.rand(12), "g": F.lit("")}), "importance-scores")
    able = F.col("n_words") >= min_words
    order = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("lot")], "g")
    drawn = F.when(F.col("idx") < F.floor(F.col("n") * F.lit(share[0]) / F.lit(share[1])), F.col("idx") + 1).cast("long")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return order.select(*columns, drawn.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
