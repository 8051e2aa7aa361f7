"""Split-block Bloom filters as aggregations.

A filter is a table (block, w0 .. w7) of the blocks that hold a key, w0 .. w7 being 32-bit words.
Building is a bitwise OR by block, combined before its shuffle, so neither a repeated key nor a
hot block grows what is moved. OR is commutative: every strategy gives the same table.
Null keys are left out of a filter and are never found in one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filterlab.functions import bits

WORDS = [f"w{k}" for k in range(8)]
#: A filter of at most so many blocks (32 bytes each, some 150 as rows) is broadcast to its probes.
BROADCAST_BLOCKS = 100_000


def n_blocks(n_keys: int, bits_per_key: float = 10.0) -> int:
    return max(1, math.ceil(math.ceil(n_keys * bits_per_key) / 256))


def block_of(h: Column, blocks: int) -> Column:
    return F.shiftright(bits.high32(h) * F.lit(blocks), 32)


def bit_of(h: Column, word: int) -> Column:
    """The place of a key's bit in a word: the top five bits of a 32-bit product."""
    return F.shiftright(bits.mul32(bits.low32(h), bits.SALTS[word]), 27)


def placed(keys: DataFrame, blocks: int, column: str = "key") -> DataFrame:
    """keys with block and p0 .. p7, the places of their bits."""
    hashed = bits.with_mix64(keys.where(F.col(column).isNotNull()), column, "h", filled=True)
    return hashed.withColumn("block", block_of(F.col("h"), blocks)).withColumns({f"p{k}": bit_of(F.col("h"), k).cast("int") for k in range(8)}).drop("h")


def _or(places: bool) -> list[Column]:
    one = (lambda k: bits.shift_left(F.lit(1).cast("bigint"), F.col(f"p{k}"))) if places else (lambda k: F.col(f"w{k}"))
    return [F.bit_or(one(k)).alias(f"w{k}") for k in range(8)]


def ored_places() -> list[Column]:
    """The words of a block, aggregated over the rows of placed keys."""
    return _or(True)


def build(keys: DataFrame, blocks: int, column: str = "key", strategy: str = "grouped", parts: int = 4) -> DataFrame:
    """The filter of the keys.

    grouped: partial and final aggregation. range: keys are dealt to ranges of blocks first, then
    aggregated without another shuffle. partials: filters of parts of the keys, merged. owners: the keys are
    replicated to each owner of a block range, which keeps its own (a comparison; moves most)."""
    rows = placed(keys.select(column), blocks, column)
    if strategy == "grouped":
        return rows.groupBy("block").agg(*_or(True))
    if strategy == "range":
        return rows.repartitionByRange("block").groupBy("block").agg(*_or(True))
    if strategy == "partials":
        part = F.pmod(F.xxhash64(column), F.lit(parts))
        return rows.withColumn("part", part).groupBy("part", "block").agg(*_or(True)).groupBy("block").agg(*_or(False))
    if strategy == "owners":
        owner = F.floor(F.col("block") * parts / blocks)
        return rows.withColumn("owner", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(owner == F.col("owner")).groupBy("owner", "block").agg(*_or(True)).drop("owner")
    raise ValueError(f"no such strategy: {strategy}")


def union(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of one size."""
    both = filters[0]
    for other in filters[1:]:
        both = both.unionByName(other)
    return both.groupBy("block").agg(*_or(False))


def might_contain(probes: DataFrame, filter_: DataFrame, blocks: int, column: str = "key", out: str = "hit") -> DataFrame:
    """probes with whether the filter may hold their key. A block that isn't there holds none.
    The filter is broadcast if its number of blocks allows it; else both sides are dealt by block."""
    hashed = bits.with_mix64(probes, column, "__h", filled=True).withColumn("__block", block_of(F.col("__h"), blocks))
    words = filter_.select(F.col("block").alias("__b"), *(F.col(w).alias(f"__{w}") for w in WORDS))
    joined = hashed.join(F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words, F.col("__block") == F.col("__b"), "left")
    hit = F.col(column).isNotNull()
    for k in range(8):
        hit = hit & (bits.shift_right(F.col(f"__w{k}"), bit_of(F.col("__h"), k)).bitwiseAND(F.lit(1)) == 1)
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__h", "__block", "__b", *(f"__{w}" for w in WORDS))


def false_positives(absent: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """fp, n, fpr over probes that are no members."""
    return might_contain(absent, filter_, blocks).agg(F.count_if("hit").alias("fp"), F.count("*").alias("n")).withColumn("fpr", F.round(F.col("fp") / F.col("n"), 9))


def packed(filter_: DataFrame) -> DataFrame:
    """block, bytes: the 32 little-endian bytes of each block that holds a key."""
    def le(w: Column) -> Column:
        h = F.lpad(F.hex(w), 8, "0")
        return F.concat(*(F.substring(h, 7 - 2 * k, 2) for k in range(4)))

    return filter_.select("block", F.unhex(F.concat(*(le(F.col(w)) for w in WORDS))).alias("bytes"))


def digest(filter_: DataFrame, blocks: int) -> DataFrame:
    """One row (blocks, bytes, fingerprint): an order-free fingerprint of the filter's content."""
    return packed(filter_).agg(F.lit(blocks).cast("bigint").alias("blocks"), F.lit(32 * blocks).cast("bigint").alias("bytes"), F.expr("bit_xor(xxhash64(block, bytes))").alias("fingerprint"))
