"""Reads that a filter skips: an index of one Bloom filter for each file of a table.

Keys that are looked up choose the files before anything is scanned; only these are opened, and an
exact join on their rows decides. All filters have the size that the file with most keys needs, so a key
falls into the same block of every filter: keys meet the index in one join on the block, and the work is
keys x files at most, less by the range of keys that each file has. The chosen files are names on the driver, as the
table's own files are.

Files that came to the table after the index are always read. Null keys are in no filter and match nothing.
"""

from __future__ import annotations

import math
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filterlab.functions import bits
from filterlab.operators import bloom
from filterlab.sources.shared import stored


#: Bits that each doubling of the files adds to those of a key: some 2 make half as many keys stray.
FILE_BITS = 5.0


def write_index(spark: SparkSession, table: str, column: str, out: str, bits_per_key: float = 10.0) -> None:
    """Writes the index of a Parquet table's column to out: files (file, n, least, most, blocks) and words (file, block, w0 .. w7).

    bits_per_key is what the filter of an only file has. Of n files each is asked for every key, and some n keys are asked for
    before they need most files, so files that open for nothing grow with n * n: FILE_BITS for each doubling make up for it."""
    keys = stored(spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("key")).distinct(), "index-keys")
    sizes = stored(keys.groupBy("file").agg(F.count("key").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")), "index-sizes")
    most, files = sizes.agg(F.max("n"), F.count("*")).first()
    blocks = bloom.n_blocks(most or 0, bits_per_key + FILE_BITS * math.log2(max(files, 1)))
    sizes.withColumn("blocks", F.lit(blocks).cast("bigint")).write.parquet(f"{out}/files")
    words = bloom.placed(keys, blocks).groupBy("file", "block").agg(*bloom.ored_places())
    words.join(sizes.select("file", "least", "most"), "file").repartitionByRange("block").write.parquet(f"{out}/words")


def chosen_files(spark: SparkSession, index: str, keys: DataFrame, column: str) -> DataFrame:
    """file: those whose filter may hold one of the keys."""
    size = spark.read.parquet(f"{index}/files").select("blocks").first()
    words = spark.read.parquet(f"{index}/words")
    if size is None:
        return words.select("file")
    asked = keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
    placed = bloom.placed(asked, size.blocks)
    met = placed.join(words.withColumnRenamed("block", "at"), (F.col("block") == F.col("at")) & F.col("key").between(F.col("least"), F.col("most")))
    hit = F.lit(True)
    for k in range(8):
        hit = hit & (bits.shift_right(F.col(f"w{k}"), F.col(f"p{k}")).bitwiseAND(F.lit(1)) == 1)
    return met.where(hit).select("file").distinct()


def _name(file: str) -> str:
    """A file's name, whether its address has one slash after the scheme or three, and escapes or not."""
    return unquote(re.sub(r"^(\w+):/+", r"\1:/", file))


def pruned(spark: SparkSession, table: str, index: str, keys: DataFrame, column: str) -> DataFrame:
    """The rows of the table's files that may hold one of the keys."""
    whole = spark.read.parquet(table)
    known = {_name(r.file) for r in spark.read.parquet(f"{index}/files").select("file").collect()}  # a name for each file
    chosen = {_name(r.file) for r in chosen_files(spark, index, keys, column).collect()}
    files = [f for f in whole.inputFiles() if _name(f) not in known or _name(f) in chosen]
    if not files:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).option("basePath", table).parquet(*files)


def semi_join(spark: SparkSession, table: str, index: str, column: str, build_side: DataFrame, build_col: str) -> DataFrame:
    """The table's rows whose key the build side has."""
    keys = build_side.select(F.col(build_col).alias("__key")).distinct()
    few = pruned(spark, table, index, keys, "__key")
    return few.join(keys, F.col(column) == F.col("__key"), "left_semi")


def inner_join(spark: SparkSession, table: str, index: str, column: str, build_side: DataFrame, build_col: str) -> DataFrame:
    few = pruned(spark, table, index, build_side, build_col)
    return few.join(build_side, F.col(column) == F.col(build_col))


def absent(spark: SparkSession, table: str, index: str, column: str, probe_side: DataFrame, probe_col: str) -> DataFrame:
    """The probe rows whose key the table hasn't; only files that may hold one of the keys are read for it."""
    there = pruned(spark, table, index, probe_side, probe_col).select(F.col(column).alias("__key")).distinct()
    return probe_side.join(there, F.col(probe_col) == F.col("__key"), "left_anti")
