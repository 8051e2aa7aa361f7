"""A Bloom filter kept up to date over a stream of keys.

Each micro-batch's filter is merged into the stored one: OR is associative, so the result equals
the filter of all keys so far, whatever the batches were. A batch writes a new version beside the
old one; a version is named by its batch, so a batch that is run again writes the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from filterlab.operators import bloom


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest stored version, or the newest before a batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    done = [int(x.getPath().getName()[2:]) for x in files.listStatus(folder) if x.getPath().getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(done)}") if done else None


def keep(keys: DataFrame, path: str, blocks: int, checkpoint: str, column: str = "key", **trigger) -> StreamingQuery:
    """Starts a query that keeps the filter of the streaming keys under path."""
    def merge(batch: DataFrame, number: int) -> None:
        new = bloom.build(batch, blocks, column)
        old = latest(batch.sparkSession, path, number)
        (bloom.union(old, new) if old is not None else new).write.mode("overwrite").parquet(f"{path}/v={number}")

    return keys.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
