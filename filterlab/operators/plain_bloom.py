"""The unblocked Bloom filter: k bits of a key anywhere in one array of bits, for comparison with the split-block form
at an equal budget. A filter is a table (word, w) of the 32-bit words that hold a bit; building is a bitwise OR by word."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filterlab.functions import bits

#: A filter of at most so many words is broadcast to its probes.
BROADCAST_WORDS = 500_000


def best_k(n_keys: int, n_bits: int) -> int:
    return max(1, round(n_bits / max(1, n_keys) * math.log(2)))


def _placed(keys: DataFrame, n_bits: int, k: int, column: str) -> DataFrame:
    """keys with word and bit of each of their k places: the halves of one hash, the second times i added to the first."""
    if not 0 < n_bits < 1 << 31:
        raise ValueError("a filter has fewer than 2**31 bits")
    hashed = bits.with_mix64(keys.where(F.col(column).isNotNull()), column, "__h", filled=True)
    each = hashed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    at = F.shiftright(bits.low32(bits.high32(F.col("__h")) + F.col("__i") * bits.low32(F.col("__h")).bitwiseOR(F.lit(1))) * F.lit(n_bits), 32)
    return each.withColumn("__at", at).withColumns({"word": F.shiftright("__at", 5), "bit": F.col("__at").bitwiseAND(F.lit(31))}).drop("__h", "__i", "__at")


def _mask() -> Column:
    return bits.shift_left(F.lit(1).cast("bigint"), F.col("bit"))


def build(keys: DataFrame, n_bits: int, k: int, column: str = "key") -> DataFrame:
    return _placed(keys.select(column), n_bits, k, column).groupBy("word").agg(F.bit_or(_mask()).alias("w"))


def probed(probes: DataFrame, filter_: DataFrame, n_bits: int, k: int, column: str = "key") -> DataFrame:
    """(key, hit) of the distinct probes that aren't null."""
    there = filter_.select(F.col("word").alias("at"), "w")
    there = F.broadcast(there) if n_bits // 32 <= BROADCAST_WORDS else there
    asked = _placed(probes.select(F.col(column).alias("key")).distinct(), n_bits, k, "key")
    met = asked.join(there, F.col("word") == F.col("at"), "left")
    return met.groupBy("key").agg(F.every(F.coalesce(F.col("w"), F.lit(0)).bitwiseAND(_mask()) != 0).alias("hit"))
