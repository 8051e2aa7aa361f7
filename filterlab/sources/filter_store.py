"""A store of filters: numbered versions, each written once with a manifest, and checked when it is read.

A version is a folder v000001, v000002 ... of the filter's rows and one manifest record (version, kind, rows,
fingerprint, facts). The fingerprint doesn't depend on the order or the files of the rows. A version is there
once its manifest is; a write that broke off leaves a number that is never used again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, kind string, rows bigint, fingerprint string, facts string"


def fingerprint(filter_: DataFrame) -> tuple[int, str]:
    """Rows, and 128 bits over all of them: hashes with two salts, XORed."""
    columns = sorted(filter_.columns)
    one, two = (F.bit_xor(F.xxhash64(F.lit(salt), *columns)) for salt in (1, 2))
    n, a, b = filter_.agg(F.count("*"), F.coalesce(one, F.lit(0)), F.coalesce(two, F.lit(0))).first()
    return n, f"{a & (1 << 64) - 1:016x}{b & (1 << 64) - 1:016x}"


def numbers(spark: SparkSession, root: str, pattern: str = "v*") -> list[int]:
    """The numbers under root that are taken, in order."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = place.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted({int(m[1]) for x in found if (m := re.search(r"/v(\d+)(?:/|$)", x.getPath().toString()))})


def write(filter_: DataFrame, root: str, kind: str, **facts) -> int:
    """Writes filter_ as the next version, and gives its number. What another writer has taken meanwhile is an error."""
    spark = filter_.sparkSession
    version = max(numbers(spark, root), default=0) + 1
    at = f"{root}/v{version:06d}"
    filter_.write.mode("errorifexists").parquet(f"{at}/filter")
    rows, mark = fingerprint(spark.read.parquet(f"{at}/filter"))
    record = Row(version=version, kind=kind, rows=rows, fingerprint=mark, facts=json.dumps(facts, sort_keys=True))
    spark.createDataFrame([record], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{at}/manifest")
    return version


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, Row]:
    """A version's filter (the latest, if none is named) and its manifest, after its rows are checked against it."""
    whole = numbers(spark, root, "v*/manifest/_SUCCESS")
    version = max(whole, default=0) if version is None else version
    if version not in whole:
        raise ValueError(f"no such version: {version}")
    at = f"{root}/v{version:06d}"
    manifest, filter_ = spark.read.schema(MANIFEST).json(f"{at}/manifest").first(), spark.read.parquet(f"{at}/filter")
    if fingerprint(filter_) != (manifest.rows, manifest.fingerprint):
        raise ValueError(f"version {version} isn't what was written")
    return filter_, manifest
