"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. Within its source, the copy ``e`` of a document has
the virtual finish time ``(e * source tokens + cumulative tokens) / target``. All copies are
range-sorted by that time and the order is cut where its tokens reach the budget, so every source runs
out of its share at the same moment. Cumulative sums are two-level (buckets of the shuffled order or ranges of
the sorted one, then a window inside each), so a source with a third of all rows spreads over many tasks.

Null texts have no words. The null source is a source of its own, last in order. Documents of no
size are never taken. Repeated rows are separate documents; ties in the shuffled order go by id, size and a
hash of the text, so only rows alike in all of these can change places between runs. An empty table gives an
empty mix. Columns of the input other than those named are ignored by ``mix_plan`` and carried by ``mixed``.
The table of sources (one row each, with their sizes) is ranked in one task; it is broadcast up to
``BROADCAST_SOURCES`` rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import WORD, row_key, stored

#: Rows of a bucket of the shuffled order, and of a range of the sorted one, on average; buckets at least; sources broadcast.
ROWS_PER_BUCKET, MIN_BUCKETS, BROADCAST_SOURCES = 50_000, 64, 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(doc_id: Column, seed: str) -> Column:
    """60 bits of a hash of the id, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> target too. One row for each source: weights by code point order,
    shares of the budget by weight, none above ``most`` times its source, the excess reshared.

    Sources reach their ceiling in the order of ceiling / weight, so the level at which the
    rest share is found with running sums over that order."""
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    every, upto = W.partitionBy(), W.orderBy("ratio", "n").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    ranked = ranked.withColumn("used", F.coalesce(F.sum("ceiling").over(upto), F.lit(0.0))).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("used")) / F.col("left"))
    # the first source that stays under its ceiling sets the level for itself and all after it
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "n", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.least("ceiling", F.coalesce(level * F.col("weight"), F.col("ceiling")))).select("source", "source_size", "n", "target")


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source."""
    there = sources.withColumnRenamed("source", "s")
    return rows.join(F.broadcast(there) if sources.count() <= BROADCAST_SOURCES else there, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def timed(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str, id_col: str, text_col: str, source_col: str, tag: Column) -> DataFrame:
    """row, doc_id, source, size, u, tie, tag, n, source_size, target, cum of every row of docs."""
    # string order in Spark is that of UTF-8 bytes, which is code point order
    text = F.col(text_col)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), shuffled(F.col(id_col), seed).alias("u"), F.xxhash64(text).alias("tie"), tag.alias("tag"))
    slim = stored(slim, "mix-sizes")
    buckets = max(MIN_BUCKETS, slim.count() // ROWS_PER_BUCKET)
    sources = stored(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).coalesce(1), "mix-targets")
    bucketed = slim.withColumn("bucket", F.floor(F.col("u") / F.lit(2.0**60) * buckets).cast("int"))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    ahead = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), ahead.alias("ahead"))
    inside = W.partitionBy("source", "bucket").orderBy("u", "doc_id", "size", "tie", "row").rowsBetween(W.unboundedPreceding, 0)
    bucketed = bucketed.withColumn("inside", F.sum("size").over(inside))
    summed = bucketed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("cum", F.col("ahead") + F.col("inside")).drop("s", "b", "bucket", "inside", "ahead")
    return stored(by_source(summed, sources), "mix-times")


def truncated(rows: DataFrame, most: int) -> DataFrame:
    """row, copy, time, upto: the copies of rows in the mix, in ranges of falling order of finish time, with the
    tokens up to each: those whose running tokens stay in the budget."""
    live = rows.where((F.col("size") > 0) & (F.col("target") > 0))
    time = (F.col("source_size") * F.col("copy") + F.col("cum")) / F.col("target")
    copies = live.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("row", "copy", time.alias("time"), "n", "u", "doc_id", "size", "tie")
    order = ["time", "n", "u", "doc_id", "size", "tie", "row"]
    ranges = max(MIN_BUCKETS, most * rows.count() // ROWS_PER_BUCKET)
    sorted_copies = stored(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-order")
    # a row for each range: ROWS_PER_BUCKET times fewer than copies
    sums = sorted_copies.groupBy("range").agg(F.sum("size").alias("tokens"))
    ahead = F.coalesce(F.sum("tokens").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("size").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    summed = sorted_copies.withColumn("inside", inside).join(sums.select("range", ahead.alias("ahead")), "range")
    budget = rows.select("n", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    return summed.withColumn("upto", F.col("ahead") + F.col("inside")).where(F.col("upto") <= F.lit(budget)).select("row", "copy", "time", "upto")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, u, size, source_size, target, copies, taken of every row."""
    rows = timed(docs, weights, share, most, seed, id_col, text_col, source_col, F.lit(None).cast("long"))
    counts = truncated(rows, most).groupBy(F.col("row").alias("r")).agg(F.count("*").cast("int").alias("n_copies"))
    copies = F.coalesce("n_copies", F.lit(0))
    joined = rows.join(counts, F.col("row") == F.col("r"), "left")
    return joined.select("doc_id", "source", "u", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in order of finish time: every row of docs as often as the plan takes it, with docs'
    own columns. Rows are known by 128 bits of hashes of all their columns, so rows alike in all of them share their copies."""
    rows = timed(docs, weights, share, most, seed, id_col, text_col, source_col, row_key(docs))
    taken = truncated(rows, most).join(rows.select("row", "tag"), "row").select(F.col("tag").alias("__mix_tag"), F.col("upto").alias("__mix_upto"))
    keyed = docs.withColumn("__mix_row", row_key(docs)).dropDuplicates(["__mix_row"])
    return taken.join(keyed, F.col("__mix_tag") == F.col("__mix_row")).sort("__mix_upto").select(*docs.columns)
