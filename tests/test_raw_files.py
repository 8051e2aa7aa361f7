import struct

import numpy as np
import pytest

from filterlab.sources import keys, raw


def test_numbers_in_ranges(spark, tmp_path):
    path, values = tmp_path / "k.u64", np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    path.write_bytes(values.astype("<i8").tobytes())
    for n, part in ((None, 900), (None, 1 << 20), (37, 100)):
        got = keys.read_u64(spark, str(path), n, part)
        assert sorted(map(tuple, got.collect())) == list(enumerate(values.tolist()[:n])) and got.rdd.getNumPartitions() == max(1, -(-8000 // part))
    path.write_bytes(b"123456789")
    with pytest.raises(Exception, match="whole number of keys"):
        keys.read_u64(spark, str(path)).count()


def test_strings_in_ranges(spark, tmp_path):
    words = ["", "a", "Straße", "漢字" * 30, *(f"key {k}" for k in range(400))]
    data = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, data)])
    whole = struct.pack("<Q", len(words)) + offsets.astype("<u8").tobytes() + b"".join(data)
    path = tmp_path / "k.str"
    path.write_bytes(whole)
    for part in (500, 1 << 20):
        assert sorted(map(tuple, keys.read_strings(spark, str(path), part).collect())) == list(enumerate(words))
    for bad in (whole[:-1], whole + b"x", b"", whole[:20]):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="don't cover the file"):
            keys.read_strings(spark, str(path)).count()


def test_file_past_two_gigabytes(tmp_path):
    path, size = tmp_path / "large.u64", (5 << 30) + 8
    with path.open("wb") as f:  # sparse
        f.seek(size - 8)
        f.write((77).to_bytes(8, "little"))
    reader = raw._NumberReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) == 81 and parts[0].first == 0 and parts[-1].end == size // 8 and all(a.end == b.first for a, b in zip(parts, parts[1:]))
    last = list(reader.read(raw.Keys(size // 8 - 3, size // 8)))
    assert last[0].to_pydict() == {"ordinal": [size // 8 - 3, size // 8 - 2, size // 8 - 1], "key": [0, 0, 77]}
