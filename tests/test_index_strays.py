"""Files that an index opens although they hold none of the keys."""

from pyspark.sql import functions as F

from filterlab.operators import file_index
from filterlab.plans import catalogue


def test_few_files_open_for_nothing(spark, tmp_path):
    at, index = str(tmp_path / "table"), str(tmp_path / "index")
    rows = spark.range(32_000).select(F.col("id").alias("k"), (F.col("id") % 32).alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(at)
    file_index.write_index(spark, at, "k", index)
    for first in (0, 9_600, 20_000):
        asked = spark.range(first, first + 320).where("id % 32 < 8").withColumnRenamed("id", "j")  # 80 keys of 8 files
        assert 8 <= len(file_index.pruned(spark, at, index, asked, "j").inputFiles()) <= 9


def test_lines_without_an_order(spark, tmp_path):
    lines = spark.createDataFrame([(k, 1, 1) for k in (1, 2, 3, None)], "l_orderkey long, l_linenumber int, l_partkey int")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 7, "O"), (5, 8, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    assert tuple(catalogue.queries()["file_index_opened"](spark, str(tmp_path)).first()) == (3, 1, True, True)
