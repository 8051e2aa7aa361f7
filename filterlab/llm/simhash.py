"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 majority bits of the hashes of all three-word shingles. Two fingerprints that
differ in at most 3 bits differ in at most 1 bit in one of their halves. The anchors of a half are
the code words of the Hamming (31, 26) code on 31 of its bits, with the last bit kept as it is.
That code covers every point within radius 1, so a fingerprint lives at one home anchor, and is
replicated to every anchor within covering radius plus threshold (1 + 1): whatever may be linked
to it lives at one of those. Links are compared per anchor, by a join that keeps no group whole.

Links are found in two rounds. The first compares each replica only with the least fingerprint
that lives at the anchor, which joins large groups into components by a few edges for each
member. The second compares what still lies in different components. No link between different
fingerprints is lost, and a group of m near copies doesn't give m * m pairs.

Null, empty and blank texts have the fingerprint zero and are linked like any other. Repeated rows
give repeated results. Null ids count in no minimum: a component of null ids only has a null id.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filterlab.llm.common import forget, mapped, stored
from filterlab.llm.graph import components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
_CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    set_bits, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, _CHUNK):
        part = np.fromiter((h(next(shingles), SEED) for _ in range(min(_CHUNK, n - start))), np.uint64, min(_CHUNK, n - start))
        set_bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """The other columns of docs with the fingerprint of the text, as a signed number."""
    def prints(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return mapped(docs, text_col, lambda: prints, f"{out} long", [c for c in docs.columns if c != text_col])


def _near_words() -> list[list[int]]:
    """For each syndrome s of the Hamming code, what to flip to reach each code word within 2."""
    near = [[0]]
    for s in range(1, 32):
        near.append([1 << (s - 1)] + [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a != s and a < a ^ s])
    return near


def _syndrome(x: Column) -> Column:
    """XOR of the positions 1 to 31 of the set bits."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    return sum((F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(m))) % 2, k) for k, m in enumerate(masks)), F.lit(0))


def _half(fp: Column, half: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if half else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def homes(prints: DataFrame) -> DataFrame:
    """anchor, and the columns of prints: one row for each fingerprint and half."""
    near = F.lit([[w[0]] for w in _near_words()])
    anchors = [F.element_at(F.element_at(near, _syndrome(_half(F.col("fp"), k)) + 1), 1).bitwiseXOR(_half(F.col("fp"), k)) + F.lit(k << 32) for k in (0, 1)]
    return prints.select(F.explode(F.array(*anchors)).alias("anchor"), *prints.columns)


def replicas(prints: DataFrame) -> DataFrame:
    """anchor, and the columns of prints: for every anchor within radius plus threshold."""
    def around(half: int) -> Column:
        x = _half(F.col("fp"), half)
        words = F.element_at(F.lit(_near_words()), _syndrome(x) + 1)
        with_last_bit = F.concat(words, F.array(F.element_at(words, 1).bitwiseXOR(F.lit(1 << 31))))
        return F.transform(with_last_bit, lambda flip: flip.bitwiseXOR(x) + F.lit(half << 32))

    return prints.select(F.explode(F.concat(around(0), around(1))).alias("anchor"), *prints.columns)


def linked(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= THRESHOLD


def first_links(prints: DataFrame) -> DataFrame:
    """a, b: fingerprints and the least one that lives at one of their anchors, if they are linked.

    Replicas are some 34 rows a fingerprint, which Spark sizes like one, so both joins with them are by merge, lest they be broadcast."""
    first = homes(prints.select("fp")).groupBy("anchor").agg(F.min("fp").alias("least"))
    stars = replicas(prints.select("fp")).hint("merge").join(first, "anchor").where((F.col("least") != F.col("fp")) & linked(F.col("least"), F.col("fp")))
    return stars.select(F.col("fp").alias("a"), F.col("least").alias("b"))


def open_links(named: DataFrame) -> DataFrame:
    """a, b: the roots of linked fingerprints (fp, root) of different roots, the lesser one first."""
    here, there = homes(named), replicas(named).select("anchor", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    met = here.join(there.hint("merge"), (here.anchor == there.anchor) & (F.col("root") < F.col("root2")) & linked(F.col("fp"), F.col("fp2")))
    return met.select(F.col("root").alias("a"), F.col("root2").alias("b"))


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(node, root) over the distinct fingerprints in column fp; those without links are left out."""
    stars = stored(first_links(prints), "simhash-stars")
    roots = components(stars)
    named = stored(prints.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(open_links(named).distinct()))
    forget(stars, named, roots)
    return joined


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    rows = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = fingerprint_components(prints)
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(ids, "root").select(F.col("fp").alias("p"), "component_id")
    # by merge: in memory rows are several times what their files are, by which Spark would broadcast them
    return rows.hint("merge").join(by_print, F.col("fp") == F.col("p")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
