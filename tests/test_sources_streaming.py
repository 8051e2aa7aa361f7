import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from filterlab.operators import bloom
from filterlab.sources import artifacts, keys
from filterlab.streaming import bloom_stream


def test_raw_keys(spark, tmp_path):
    (tmp_path / "a.u64").write_bytes(struct.pack("<4q", 5, -1, 2**62, 0))
    assert [tuple(r) for r in keys.read_u64(spark, str(tmp_path / "a.u64")).collect()] == [(0, 5), (1, -1), (2, 2**62), (3, 0)]
    assert keys.read_u64(spark, str(tmp_path / "a.u64"), 2).count() == 2
    words = ["é", "", "abc"]
    body = "".join(words).encode()
    (tmp_path / "a.str").write_bytes(struct.pack("<5Q", 3, 0, 2, 2, 5) + body)
    assert [r.key for r in keys.read_strings(spark, str(tmp_path / "a.str")).collect()] == words
    (tmp_path / "b.str").write_bytes(struct.pack("<5Q", 3, 0, 2, 2, 9) + body)
    with pytest.raises(Exception, match="offsets"):
        keys.read_strings(spark, str(tmp_path / "b.str")).collect()


def test_records_tables_ledgers(spark, tmp_path):
    for k, run in enumerate([{"strategy": "sorted", "n": 10, "fpr": 0.01, "banding_raw_per_key": {"0x10": 0.5}}, {"strategy": "arrival", "n": 20, "spilled": None}]):
        (tmp_path / f"m{k}_rep{k}.json").write_text(json.dumps(run))
    got = artifacts.read_records(spark, str(tmp_path), "*_rep*.json").withColumn("rep", artifacts.path_part(r"_rep(\d+)\.json").cast("int")).orderBy("n").collect()
    assert [(r.strategy, r.rep, r.spilled) for r in got] == [("sorted", 0, None), ("arrival", 1, None)] and got[0].banding_raw_per_key == {"0x10": 0.5}
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("a,b\n1,NA\n2,x\n")
    assert [tuple(r) for r in artifacts.read_table(spark, str(tmp_path / "t.csv.gz"), "a int, b string").collect()] == [(1, None), (2, "x")]
    lines = spark.createDataFrame([("| id | what |",), ("|---|---|",), ("| C1 | it is | so |",), ("text",)], "value string")
    assert [r.cells for r in artifacts.ledger(lines).collect()] == [["id", "what"], ["C1", "it is", "so"]]
    out = str(tmp_path / "out")
    artifacts.write_records(spark.range(3), out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        artifacts.write_records(spark.range(3), out)
    files = spark.createDataFrame([("a", 1, "generated-by: x"), ("b", 5, "generated-by: x"), ("b", 1, "no")], "path string, number int, line string")
    assert [r.path for r in artifacts.without_header(files).collect()] == ["b"]
    with pytest.raises(Exception, match="no ms"):
        spark.createDataFrame([("took",)], "line string").select(*artifacts.fields(F.col("line"), {"ms": (r"(\d+) ms", "int")}, required=True)).collect()
    assert spark.createDataFrame([("all of it 1 2 3 4",)], "line string").select(artifacts.from_the_end(F.col("line"), 2).alias("x")).first().x == "3"


def test_adjacent_repeats(spark):
    rows = spark.createDataFrame(list(enumerate(["a", "a", None, "a", "b", "b", "a"])), "n long, v string")
    assert [r.n for r in keys.without_adjacent_repeats(rows, "v", "n").orderBy("n").collect()] == [0, 3, 4, 6]


def test_filter_over_a_stream(spark, tmp_path):
    """Batches of any size end in the filter of all keys; a second run adds only what is new."""
    blocks, source = bloom.n_blocks(3000), tmp_path / "in"
    for k in range(3):
        keys.key_stream(spark, 1000, seed=k).select("key").coalesce(1).write.parquet(str(source / f"p{k}"))
    stream = lambda: spark.readStream.schema("key long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    bloom_stream.keep(stream(), str(tmp_path / "f"), blocks, str(tmp_path / "c")).awaitTermination()
    keys.key_stream(spark, 500, seed=9).select("key").coalesce(1).write.parquet(str(source / "p9"))
    bloom_stream.keep(stream(), str(tmp_path / "f"), blocks, str(tmp_path / "c")).awaitTermination()
    every = spark.read.option("recursiveFileLookup", True).parquet(str(source))
    assert sorted(bloom_stream.latest(spark, str(tmp_path / "f")).collect()) == sorted(bloom.build(every, blocks).collect())
