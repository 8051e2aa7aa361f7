"""Run records, tables with missing values, logs and ledgers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every field that a run record may have; a record lacks some, so all are nullable.
RUN_RECORD = (
    "strategy string, n bigint, rep int, num_slots bigint, w int, r int, keys string, string_keys_direct boolean, mean_key_bytes double, overhead double, "
    "hash_ns_per_key double, reorder_ns_per_key double, banding_ns_per_key double, backsubst_ns_per_key double, total_ns_per_key double, "
    "counters string, banding_cycles_per_key double, banding_instr_per_key double, banding_miss_per_key double, banding_l2d_lmiss_rd_per_key double, "
    "banding_raw_per_key map<string,double>, false_negatives bigint, fpr double, bits_per_key double, window_shift int, threads int, deferred bigint, "
    "spilled bigint, soln_fnv string, margin bigint, peak_rss_kb bigint"
)
ESTIMATES = "mean struct<point_estimate: double, confidence_interval: struct<lower_bound: double, upper_bound: double>>, std_dev struct<point_estimate: double>"


def read_records(spark: SparkSession, path: str, glob: str = "*.json", schema: str = RUN_RECORD, one_per_file: bool = True, corrupt: str | None = None) -> DataFrame:
    """JSON records, one to a file or one to a line, in all folders below path, with the path each came from. corrupt: a
    column that holds what isn't a record of the schema (which is null otherwise)."""
    reader = spark.read.schema(schema + (f", {corrupt} string" if corrupt else "")).option("multiLine", one_per_file).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, missing: str = "NA") -> DataFrame:
    """Separated values, plain or gzipped, where ``missing`` stands for null."""
    return spark.read.schema(schema).option("nullValue", missing).csv(path, sep=sep, header=header)


def digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, bytes bigint, sha256 string").csv(path, sep=" ")


def write_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON records, in a folder for each value of by; refuses a path that is there."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).json(path)


def write_table(df: DataFrame, path: str, missing: str = "", gzipped: bool = False) -> None:
    """CSV, all or nothing: the commit of a Spark write."""
    df.write.mode("errorifexists").csv(path, header=True, nullValue=missing, compression="gzip" if gzipped else "none")


def path_part(pattern: str, group: int = 1, path: Column | str = "path") -> Column:
    """A column read from a file's path; null where the pattern isn't found."""
    found = F.regexp_extract(path, pattern, group)
    return F.when(found != "", found)


def fields(line: Column, patterns: dict[str, tuple[str, str]], required: bool = False) -> list[Column]:
    """name -> (pattern with one group, type): a column each. If required, a line that lacks one is an error."""
    out = []
    for name, (pattern, kind) in patterns.items():
        found = F.regexp_extract(line, pattern, 1)
        value = F.when(found != "", found)
        if required:
            value = F.when(found == "", F.raise_error(F.concat(F.lit(f"no {name} in: "), line))).otherwise(value)
        out.append(value.cast(kind).alias(name))
    return out


def counters(line: Column, names: list[str]) -> list[Column]:
    """The whole-number counters of a line of key=value words."""
    pairs = F.str_to_map(line, F.lit(" "), F.lit("="))
    return [pairs[n].cast("bigint").alias(n) for n in names]


def from_the_end(line: Column, k: int) -> Column:
    """The k-th white-space separated word from the end of a line."""
    return F.element_at(F.split(F.trim(line), r"\s+"), -k)


def ledger(lines: DataFrame, column: str = "value") -> DataFrame:
    """The rows of a Markdown table as an array of trimmed cells; rulers and other lines go."""
    cells = F.transform(F.slice(F.split(column, r"\|"), 2, F.size(F.split(column, r"\|")) - 2), lambda cell: F.trim(cell))
    return lines.where(F.trim(column).startswith("|") & ~F.col(column).rlike(r"^[\s|:-]+$")).select(cells.alias("cells"))


def unproven(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """claims (id, path, status) that are said to be measured or derived but whose path isn't in paths."""
    return claims.where(F.col("status").isin("measured", "derived")).join(paths, "path", "left_anti")


def without_header(lines: DataFrame, mark: str = "generated-by:", first: int = 3) -> DataFrame:
    """path of the files (path, number, line) that lack the mark in their first lines."""
    has = F.max(F.when((F.col("number") <= first) & F.col("line").contains(mark), 1).otherwise(0))
    return lines.groupBy("path").agg(has.alias("has")).where("has = 0").select("path")
