"""Joins behind a membership filter. A filter only thins the probe side; the exact join decides,
so results equal those of the plain join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filterlab.operators import bloom


def filter_of(build_side: DataFrame, column: str, bits_per_key: float = 10.0) -> tuple[DataFrame, int]:
    """The filter of a key column and its number of blocks, sized by the distinct keys."""
    keys = build_side.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
    blocks = bloom.n_blocks(keys.count(), bits_per_key)
    return bloom.build(keys, blocks), blocks


def thinned(probe_side: DataFrame, build_side: DataFrame, probe_col: str, build_col: str, keep: bool = True) -> DataFrame:
    """The probe rows whose key may be (or, if not keep, surely isn't) on the build side."""
    filter_, blocks = filter_of(build_side, build_col)
    return bloom.might_contain(probe_side, filter_, blocks, probe_col, "__hit").where(F.col("__hit") if keep else ~F.col("__hit")).drop("__hit")


def semi_join(probe_side: DataFrame, build_side: DataFrame, probe_col: str, build_col: str) -> DataFrame:
    few = thinned(probe_side, build_side, probe_col, build_col)
    return few.join(build_side.select(F.col(build_col).alias("__key")).distinct(), F.col(probe_col) == F.col("__key"), "left_semi")


def inner_join(probe_side: DataFrame, build_side: DataFrame, probe_col: str, build_col: str) -> DataFrame:
    return thinned(probe_side, build_side, probe_col, build_col).join(build_side, F.col(probe_col) == F.col(build_col))


def anti_join(probe_side: DataFrame, build_side: DataFrame, probe_col: str, build_col: str) -> DataFrame:
    """The rows that the build side hasn't: a row that is surely absent gets no key to look up, so it only
    passes through the exact join; possible members are looked up. The probe side is read once."""
    filter_, blocks = filter_of(build_side, build_col)
    asked = bloom.might_contain(probe_side, filter_, blocks, probe_col, "__hit")
    keys = build_side.select(F.col(build_col).alias("__key")).distinct()
    return asked.join(keys, F.col("__hit") & (F.col(probe_col) == F.col("__key")), "left_anti").drop("__hit")
