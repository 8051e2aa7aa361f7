"""Raw key files, read in byte ranges: a file of any size is many partitions, each of which reads its own part.

``raw_u64`` is a file of little-endian 64-bit keys. ``raw_strings`` is a count, count + 1 offsets of 64 bits, and the
bytes. Both give (ordinal, key), and refuse a file whose length isn't what its content asks for. Paths may be local or of
any file system that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and keys of a batch.
PART_BYTES, BATCH_KEYS = 64 << 20, 1 << 16


@dataclass
class Keys(InputPartition):
    first: int
    end: int


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _numbers(file, at: int, n: int) -> np.ndarray:
    return np.frombuffer(file.read_at(8 * n, at), "<i8")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.limit = int(options["n"]) if "n" in options else None
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def count(self, file, size: int) -> int:
        """The file's keys; an error if its length is wrong."""
        raise NotImplementedError

    def batch(self, file, first: int, end: int) -> pa.Array:
        raise NotImplementedError

    def partitions(self) -> list[Keys]:
        with _opened(self.path) as file:
            size = file.size()
            n = self.count(file, size)
        parts = max(1, -(-size // self.part_bytes))
        n = n if self.limit is None else min(n, self.limit)
        return [Keys(n * k // parts, n * (k + 1) // parts) for k in range(parts)]

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as file:
            for first in range(partition.first, partition.end, BATCH_KEYS):
                end = min(first + BATCH_KEYS, partition.end)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end)), self.batch(file, first, end)], ["ordinal", "key"])


class _NumberReader(_Reader):
    def count(self, file, size: int) -> int:
        if size % 8:
            raise ValueError("the file isn't a whole number of keys")
        return size // 8

    def batch(self, file, first: int, end: int) -> pa.Array:
        return pa.array(_numbers(file, 8 * first, end - first))


class _StringReader(_Reader):
    def count(self, file, size: int) -> int:
        n = int(_numbers(file, 0, 1)[0]) if size >= 16 else -1
        if n < 0 or size < 8 * (n + 2) or 8 * (n + 2) + int(_numbers(file, 8 * (n + 1), 1)[0]) != size:
            raise ValueError("the offsets don't cover the file")
        return n

    def batch(self, file, first: int, end: int) -> pa.Array:
        start = 8 * (int(_numbers(file, 0, 1)[0]) + 2)
        at = _numbers(file, 8 * (first + 1), end - first + 1)
        data = file.read_at(int(at[-1] - at[0]), start + int(at[0]))
        at = (at - at[0]).tolist()
        return pa.array([data[a:b].decode() for a, b in zip(at, at[1:])], pa.string())


class RawNumbers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_u64"

    def schema(self) -> str:
        return "ordinal bigint, key bigint"

    def reader(self, schema) -> DataSourceReader:
        return _NumberReader(self.options)


class RawStrings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_strings"

    def schema(self) -> str:
        return "ordinal bigint, key string"

    def reader(self, schema) -> DataSourceReader:
        return _StringReader(self.options)
