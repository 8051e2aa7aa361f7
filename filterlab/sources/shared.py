"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_own: dict[str, str] = {}
#: Rows of a range on average, and ranges at least, when rows are put in order.
ROWS_PER_RANGE, MIN_RANGES = 50_000, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/filterlab/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back, so its lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(rows: DataFrame, order: list[Column], tag: str, n: int | None = None) -> DataFrame:
    """A stored table of rows with __range and __place: range partitions of the order, and the place from 0 in
    them. Rows alike in the order lie in one range. rows are read twice: store what is dear to make."""
    ranges = max(MIN_RANGES, (rows.count() if n is None else n) // ROWS_PER_RANGE)
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    written = stored(placed.withColumn("__id", F.monotonically_increasing_id()), tag)
    return written.withColumns({"__range": F.shiftrightunsigned("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def earlier(x: str, order: str, by: list[str] | None = None) -> Column:
    """The sum of x over the rows before, in a table of a row for each range."""
    return F.coalesce(F.sum(x).over(W.partitionBy(*(by or [])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
