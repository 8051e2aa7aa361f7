"""What the training-data operators share: reading tables, stored intermediates, texts handed to Python."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

#: A word, in Java's and Python's regular expressions alike; bytes.split() splits the same way.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame) -> Column:
    """128 bits of hashes of a row's columns. A null leaves a hash as it is, so which columns are null is hashed too."""
    both = [*(df[c] for c in df.columns), *(df[c].isNull() for c in df.columns)]
    return F.struct(F.xxhash64(*both).alias("one"), F.xxhash64(F.lit(1), *both).alias("other"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session gets a folder of its
    own; a cluster has no folder that all its machines share, so there it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def stored(df: DataFrame, tag: str, plain: bool = False) -> DataFrame:
    """df written once as a table in the shared folder and read back: its lineage ends there,
    so a lost executor costs the reading of a file and not the work before it. Plain: without dictionaries
    and compression, which hashes don't gain by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filterlab/{tag}-{uuid.uuid4().hex}"
    options = {"parquet.enable.dictionary": "false", "compression": "none"} if plain else {}
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing will read again; what a result still reads must stay."""
    for df in tables:
        if df is not None and (path := _paths.pop(df, None)):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Rows whose texts are Python strings at a time: texts are long, a batch of Arrow holds many.
BATCH_ROWS = 500


def mapped(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[pa.Array]]], fields: str, keep: list[str] | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """The columns keep of df (all if None) and the new fields. make gives, once for each task, the function
    that turns a list of values of a column into one array for each new field."""
    kept, new = df.columns if keep is None else keep, StructType.fromDDL(fields)
    schema = StructType([*(df.schema[c] for c in kept), *new])
    also = [] if column in kept else [df[column].alias("__mapped")]  # texts are long: a column that is kept goes once
    place = len(kept) if also else kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), *function(part.column(place).to_pylist())], names=schema.names)

    return df.select(*kept, *also).mapInArrow(run, schema)


#: Rows of a range on average, and ranges at least, when rows are numbered.
ROWS_PER_RANGE, MIN_RANGES = 50_000, 16


def ranked(rows: DataFrame, order: list[Column], group: str) -> DataFrame:
    """A stored table of rows (a stored one too) with idx, the place from 0 in the order among the rows of a group (never null), and n,
    the rows of the group. Rows are range-sorted by group and order; a row's number is its place in its range plus the
    rows of its group in the ranges before, so a hot group is many ranges. The order should tell repeated rows apart, by
    a lot if nothing else does: rows alike in it can't be in two ranges."""
    ranges = max(MIN_RANGES, rows.count() // ROWS_PER_RANGE)
    placed = rows.repartitionByRange(ranges, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    written = stored(placed.withColumn("__id", F.monotonically_increasing_id()), "ranked")  # range, and place in it
    placed = written.withColumns({"__range": F.shiftrightunsigned("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    # a row for each range and group in it
    sums = placed.groupBy(group, "__range").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    ahead = F.coalesce(F.sum("__rows").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), (ahead - F.col("__first")).alias("__shift"), F.sum("__rows").over(W.partitionBy(group)).alias("n")), "ranked-sums")
    joined = placed.join(sums, (F.col(group) == F.col("__g")) & (F.col("__range") == F.col("__r")))
    found = stored(joined.select(*rows.columns, (F.col("__shift") + F.col("__place")).alias("idx"), "n"), "numbered")
    forget(written, sums)
    return found
