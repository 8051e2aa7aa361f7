"""Sharding by sampled splitters (law ``bytes``).

Records are ordered by a key whose upper half is a hash of the text and whose lower half is a
hash of the id, so equal texts lie side by side while one hot text still spreads over many keys.

1. *Sampled splitters*: a size-weighted sample of keys gives quantile boundaries of fine ranges.
2. *Subdivision*: exact bytes per range show the overfull ones; each is cut into equal key
   intervals in proportion to its surplus.
3. *Shard boundaries*: running bytes over the cells place each record exactly; a shard begins at
   the first record past its share. A boundary that would cut a small group of equal texts moves
   to the group's start.
4. Slots count the records of a shard in key order, without gaps.

Null texts count as no bytes; null ids share one hash; repeated rows get a slot each, dealt to pieces by
lot if they alone overfill a range; ties of the key go by id, size and checksum. An empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import stored

#: Fine ranges for each shard at least, records for each range at most, ranges at most (so the
#: sample on the driver stays under 20 * MAX_RANGES keys).
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES, SAMPLES_PER_RANGE = 8, 200_000, 100_000, 20
#: A group of equal texts is kept whole up to this part of a shard's bytes.
GROUP_SHARE = 0.01


def record_key(text: Column, doc_id: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 32))


def weighted_splitters(slim: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantile boundaries of the keys by size, from a size-weighted sample."""
    wanted = ranges * SAMPLES_PER_RANGE
    u = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit("sample")), 11) / F.lit(float(2**53))
    drawn = slim.where(u < F.col("size") * F.lit(wanted / total)).select("key", F.greatest("size", F.lit(total / wanted)).alias("w"))
    rows = drawn.toPandas().sort_values("key")
    if rows.empty:
        return np.empty(0, np.int64)
    at = np.searchsorted(rows.w.cumsum().to_numpy(), rows.w.sum() * np.arange(1, ranges) / ranges)
    return np.unique(rows.key.to_numpy()[np.minimum(at, len(rows) - 1)])


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs."""
    text = F.col(text_col)
    slim = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            record_key(text, F.col(id_col)).alias("key"),
            F.xxhash64(F.monotonically_increasing_id()).alias("lot"),
        ),
        "shard-keys",
    )
    total, n = slim.agg(F.sum("size"), F.count("*")).first()
    empty = slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if not n:
        return empty
    ranges = min(MAX_RANGES, max(n_shards * RANGES_PER_SHARD, n // ROWS_PER_RANGE))
    cuts = weighted_splitters(slim, total, ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype("int32"))

    ranged = stored(slim.withColumn("range", range_of("key")), "shard-ranged")
    # at most len(cuts) + 1 ranges, and as many pieces more: small enough for the driver and a broadcast
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    sums = sums.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") * ranges / F.lit(2.0 * total))).cast("int"))
    plan = stored(sums.coalesce(1), "shard-ranges")
    piece = F.when(F.col("lo") == F.col("hi"), F.pmod("lot", "pieces")).when(F.col("pieces") > 1, F.floor((F.col("key").cast("double") - F.col("lo")) * F.col("pieces") / (F.col("hi").cast("double") - F.col("lo") + 1)))
    celled = ranged.join(F.broadcast(plan.select("range", "lo", "hi", "pieces")), "range").withColumn(
        "cell", F.struct("range", F.coalesce(F.least(piece, F.col("pieces") - 1), F.lit(0)).cast("int").alias("piece"))
    )
    cells = celled.groupBy("cell").agg(F.sum("size").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("cell", before.alias("before"))
    inside = W.partitionBy("cell").orderBy("key", "doc_id", "size", "text_crc32", "lot")
    placed = celled.join(F.broadcast(offsets), "cell").withColumn("at", F.col("before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2)
    guess = F.least(F.lit(n_shards - 1), F.floor(F.col("at") * n_shards / F.lit(total))).cast("int")
    firsts = {r.shard: r.key for r in placed.groupBy(guess.alias("shard")).agg(F.min("key").alias("key")).collect()}  # a row for each shard
    bounds, following = [], None
    for s in range(n_shards - 1, 0, -1):
        following = firsts.get(s, following)
        bounds.append(following)
    bounds = [b for b in reversed(bounds)]
    group = F.shiftright("key", 32)
    wanted = {b >> 32 for b in bounds if b is not None}
    small = {
        r.g
        for r in slim.where(group.isin(*wanted)).groupBy(group.alias("g")).agg(F.sum("size").alias("bytes")).collect()  # n_shards rows at most
        if r.bytes <= GROUP_SHARE * total / n_shards
    } if wanted else set()
    bounds = [b if b is None or b >> 32 not in small else (b >> 32) << 32 for b in bounds]
    shard = sum((F.when(F.col("key") >= b, 1).otherwise(0) for b in bounds if b is not None), F.lit(0))
    final = celled.withColumn("shard", shard.cast("int"))
    counts = final.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "cell", ahead.alias("ahead"))
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "doc_id", "size", "text_crc32", "lot"))
    return final.join(F.broadcast(starts), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + number - 1).cast("long").alias("slot"))
