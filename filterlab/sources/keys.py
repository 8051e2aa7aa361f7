"""Key sources: generated streams, probe batches, key samples, raw key files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.functions import bits
from filterlab.sources import raw
from filterlab.sources.shared import earlier, in_ranges, stored

#: The seeds of the member and absent streams, and what absent keys are XORed with.
MEMBER_SEED, ABSENT_SEED, ABSENT_XOR = 0xA11CE, 0xD15EA5E, 0x5555555555555555


def key_stream(spark: SparkSession, n: int, seed: int = MEMBER_SEED, rep: int = 0) -> DataFrame:
    """ordinal, key: the first n keys of the splitmix64 stream of seed + rep, in closed form, so
    every partition makes its own."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64)
            mixed = bits.np_mix64((at + np.uint64(1)) * np.uint64(bits.GOLDEN) + np.uint64(seed + rep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mixed.view(np.int64))], ["ordinal", "key"])

    # arrays rather than column expressions: what reads the keys hashes them further, and Spark would merge all of it into one
    return spark.range(n).mapInArrow(make, "ordinal bigint, key bigint")


def absent_stream(spark: SparkSession, n: int) -> DataFrame:
    """ordinal, key: probes that are members of no stream used here."""
    return key_stream(spark, n, ABSENT_SEED).withColumn("key", F.col("key").bitwiseXOR(F.lit(ABSENT_XOR)))


def probe_batches(keys: DataFrame, size: int = 8192) -> DataFrame:
    """keys with the number of the batch each falls in, so that no probe set is used twice."""
    return keys.withColumn("batch", F.floor(F.col("ordinal") / size))


def string_probes(spark: SparkSession, n: int) -> DataFrame:
    """ordinal, key: strings that begin with a byte no key has."""
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("\x01probe-"), F.col("id")).alias("key"))


def fixed_length_strings(spark: SparkSession, n: int, length: int = 16, seed: int = 0) -> DataFrame:
    """ordinal, key: n distinct byte strings of one length of at least 8. The first 8 bytes are the ordinal,
    big-endian, the others hash bytes of ordinal and seed."""
    if length < 8:
        raise ValueError("a key needs 8 bytes for its ordinal")
    ids = spark.range(n).withColumnRenamed("id", "ordinal")
    rest = F.concat(F.lit(""), *(F.md5(F.concat_ws("/", "ordinal", F.lit(seed), F.lit(k)).cast("binary")) for k in range(-(-(length - 8) // 16))))
    return ids.select("ordinal", F.unhex(F.concat(F.lpad(F.hex("ordinal"), 16, "0"), F.substring(rest, 1, 2 * (length - 8)))).alias("key"))


#: Keys left to choose the last of a sample from.
FEW = 10_000


def _last_drawn(drawn: DataFrame, n: int, column: str) -> tuple[int, object]:
    """The n-th least (draw, key): counts by twelve bits of the draw show where it lies, again and again."""
    shift = 52
    while True:
        counts = {r.b: r.n for r in drawn.groupBy(F.shiftrightunsigned("draw", shift).bitwiseAND(F.lit(4095)).alias("b")).agg(F.count("*").alias("n")).collect()}  # 4,096 rows
        for b in sorted(counts):
            if n <= counts[b]:
                break
            n -= counts[b]
        drawn = drawn.where(F.shiftrightunsigned("draw", shift).bitwiseAND(F.lit(4095)) == b)
        if counts[b] <= FEW or shift < 12:
            break
        shift -= 12
    unsigned = F.col("draw").bitwiseXOR(F.lit(-(1 << 63)))
    last = drawn.orderBy(unsigned, column).limit(n).agg(F.max(F.struct(unsigned.alias("u"), F.col(column).alias("key"))).alias("m")).first().m
    return last.u, last.key


def sample_keys(keys: DataFrame, n: int, seed: int, column: str = "key", rows: int | None = None) -> DataFrame:
    """n of the distinct keys, drawn by a seeded hash and sorted; the same ones in every run. If there are fewer, the
    largest multiple of n / 10 that there is. rows: how many rows keys must have.

    The sample is a filter: the last of it is found from counts, so keys aren't sorted to be cut."""
    if rows is not None and (found := keys.count()) != rows:
        raise ValueError(f"{found} keys, not {rows}")
    drawn = bits.with_mix64(keys.select(column).where(F.col(column).isNotNull()).distinct(), F.col(column).bitwiseXOR(F.lit(bits.signed(seed))), "draw")
    drawn = stored(drawn, "drawn")
    total, tenth = drawn.count(), max(1, n // 10)
    n = n if total >= n else total // tenth * tenth
    if not n:
        raise ValueError(f"{total} distinct keys are too few")
    u, key = _last_drawn(drawn, n, column)
    unsigned = F.col("draw").bitwiseXOR(F.lit(-(1 << 63)))
    return drawn.where((unsigned < u) | ((unsigned == u) & (F.col(column) <= key))).select(column).orderBy(column)


def without_adjacent_repeats(rows: DataFrame, value: str, order: str | list[str], n: int | None = None, distinct: bool = False) -> DataFrame:
    """The rows whose value isn't null and differs from that of the row before, in any order (ties go by the value);
    the first n of them, if n is given, which must be there. distinct: no value may be left twice.

    Rows are range-sorted. Inside a range the row before is the window's; a range's first row has the last value
    of the range before carried to it, by a row for each range."""
    columns = [order] if isinstance(order, str) else list(order)
    held = in_ranges(rows, [*map(F.col, columns), F.col(value)], "adjacent")
    inside = W.partitionBy("__range").orderBy("__place")
    last = held.groupBy("__range").agg(F.max_by(F.struct(F.col(value).alias("v")), "__place").alias("__last"))
    carried = last.select("__range", F.lag("__last").over(W.orderBy("__range")).alias("__carried"))
    before = held.withColumn("__before", F.lag(F.struct(F.col(value).alias("v"))).over(inside)).join(carried, "__range", "left")
    kept = before.where(F.col(value).isNotNull() & ~F.coalesce("__before", "__carried")["v"].eqNullSafe(F.col(value)))
    if n is not None or distinct:
        kept = stored(kept.select(*rows.columns, "__range", "__place"), "adjacent-kept")
    if n is not None:
        sums = kept.groupBy("__range").agg(F.count("*").alias("__n"))
        ahead = sums.select("__range", earlier("__n", "__range").alias("__ahead"))
        kept = kept.join(ahead, "__range").withColumn("__at", F.col("__ahead") + F.row_number().over(inside)).where(F.col("__at") <= n)
        if (found := kept.count()) != n:
            raise ValueError(f"only {found} rows, not {n}")
    if distinct and kept.groupBy(value).count().where("count > 1").limit(1).count():
        raise ValueError(f"values of {value} are not distinct")
    return kept.select(*rows.columns)


def read_u64(spark: SparkSession, path: str, n: int | None = None, part_bytes: int = raw.PART_BYTES) -> DataFrame:
    """ordinal, key of a raw file of little-endian 64-bit keys, or of its first n."""
    spark.dataSource.register(raw.RawNumbers)
    reader = spark.read.format("raw_u64").option("partBytes", str(part_bytes))
    return (reader if n is None else reader.option("n", str(n))).load(path)


def read_strings(spark: SparkSession, path: str, part_bytes: int = raw.PART_BYTES) -> DataFrame:
    """ordinal, key of a raw string file: a count, count + 1 offsets, then the bytes."""
    spark.dataSource.register(raw.RawStrings)
    return spark.read.format("raw_strings").option("partBytes", str(part_bytes)).load(path)
