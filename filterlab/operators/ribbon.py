"""Ribbon filters as grouped aggregations.

Keys are dealt to shards of bounded size by a hash; each shard is a ribbon filter of its own, so
no task ever holds the whole. Inside a shard the order of insertion is free: arrival, sorted,
windowed (one counting pass instead of a sort), ranges banded apart with a cap and a tail for what
crosses it, or partial tables merged. All give one solution.

A filter is a stored table (shard, seed, n, slots, occupied, redundant, spilled, contradictions, z), z holding
one 16-bit little-endian value for each slot. In a standard ribbon each shard has the first seed under which
its equations don't contradict each other; only shards that fail are built again.

One ribbon whose slots are too many for a task is built over ranges of slots (``build_over_ranges``): what a range's
table can't hold goes on to the next range, and the ranges' solutions, affine maps of the w - 1 slots to
their right, are composed in a parallel scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from filterlab.functions import bits
from filterlab.operators import ribbon_kernel as kernel
from filterlab.sources.shared import stored

#: Keys of a shard on average; bytes of a filter that is broadcast to its probes; shards whose sizes are; seeds tried by a standard ribbon.
SHARD_KEYS, BROADCAST_BYTES, BROADCAST_SHARDS, SEEDS = 1 << 18, 64 << 20, 100_000, 256
FILTER = "shard bigint, seed bigint, n bigint, slots bigint, occupied bigint, redundant bigint, spilled bigint, contradictions bigint, z binary"
STRATEGIES = ("arrival", "sorted", "windowed", "ranges", "partials")


@dataclass(frozen=True)
class Spec:
    """Width of an equation, result bits, slots for each key (None: from w and r), standard or homogeneous, seed."""

    w: int = 64
    r: int = 7
    overhead: float | None = None
    standard: bool = False
    seed: int = 0

    def slots(self, n: int) -> int:
        factor = self.overhead or 1 + (4 + self.r * 0.25) / self.w
        return max(self.w * 2, -(-int(factor * n) // 64) * 64)


def slots_column(n: Column, spec: Spec) -> Column:
    factor = spec.overhead or 1 + (4 + spec.r * 0.25) / spec.w
    return F.greatest(F.lit(2 * spec.w).cast("bigint"), (F.ceil(F.floor(n * F.lit(factor)) / 64) * 64).cast("bigint"))


def starts(keys: DataFrame, slots: int, spec: Spec = Spec(), column: str = "key") -> DataFrame:
    """keys, less those that are null, with h and start, for a filter of one shard."""
    return bits.with_hash(keys.where(F.col(column).isNotNull()), column, "h", spec.seed, filled=True).withColumn("start", bits.scaled(F.col("h"), slots - spec.w + 1))


#: 2**GROUP_SHIFT windows have their counts added up in one task.
GROUP_SHIFT = 12


def window_counts(started: DataFrame, shift: int) -> DataFrame:
    """win, n, before: keys of each window of slots and of all windows before it. Sums run inside groups of
    2**GROUP_SHIFT windows and over the groups' sums, which are as many times fewer."""
    counts = started.groupBy(F.shiftright("start", shift).alias("win")).agg(F.count("*").alias("n")).withColumn("__g", F.shiftright("win", GROUP_SHIFT))
    groups = counts.groupBy("__g").agg(F.sum("n").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("__g", earlier.alias("__earlier"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("__g").orderBy("win").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__inside", inside).join(groups, "__g").select("win", "n", (F.col("__earlier") + F.col("__inside")).alias("before"))


def window_order(started: DataFrame, shift: int, arrival: str = "key") -> DataFrame:
    """started with win and place: its windows in order, arrival order inside a window."""
    counts = window_counts(started, shift).select(F.col("win").alias("__w"), "before")
    number = F.row_number().over(W.partitionBy("win").orderBy(arrival))
    dealt = started.withColumn("win", F.shiftright("start", shift))
    return dealt.join(counts, F.col("win") == F.col("__w")).withColumn("place", F.col("before") + number - 1).drop("__w", "before")


def equal_ranges(counts: DataFrame, ranges: int) -> DataFrame:
    """range, first_win: the window where each of so many ranges of about as many keys begins."""
    total = counts.agg(F.sum("n")).scalar()
    # the last range that a window is late enough for; a range begins in the first window late enough for it
    last = F.least(F.floor(F.col("before") * ranges / total), F.lit(ranges - 1).cast("bigint"))
    firsts = counts.groupBy(last.alias("last")).agg(F.min("win").alias("first_win"))  # a row for each range at most
    earlier = F.coalesce(F.lag("last").over(W.orderBy("last")), F.lit(-1).cast("bigint"))
    return firsts.withColumn("earlier", earlier).select(F.explode(F.sequence(F.col("earlier") + 1, "last")).alias("range"), "first_win")


def deferred(started: DataFrame, slots: int, ranges: int, margin: int) -> DataFrame:
    """range, n, n_deferred: keys whose start lies within margin of the end of their range of slots."""
    width = -(-slots // ranges)
    in_range = started.withColumn("range", F.floor(F.col("start") / width))
    late = (F.col("start") + margin >= (F.col("range") + 1) * width) & (F.col("range") < ranges - 1)
    return in_range.groupBy("range").agg(F.count("*").alias("n"), F.count_if(late).alias("n_deferred"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def _hashed(key: np.ndarray, seed: int, slots: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    h = bits.np_hash(key, seed)
    return h, bits.np_scaled(h, slots - w + 1)


@F.pandas_udf(LongType())
def _start_of(key: pd.Series, seed: pd.Series, span: pd.Series) -> pd.Series:
    """The first slot of each key's equation; span: the slots that one may start in."""
    out = np.zeros(len(key), np.int64)
    for (s, n), at in pd.Series(range(len(key))).groupby([seed.to_numpy(), span.to_numpy()]).indices.items():
        out[at] = bits.np_scaled(bits.np_hash(key.to_numpy()[at], int(s)), int(n))
    return pd.Series(out)


def dealt(keys: DataFrame, spec: Spec = Spec(), column: str = "key", shard_keys: int = SHARD_KEYS, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, shard, arrival) of the distinct keys, stored, and (shard, n, slots, seed) of the shards, stored.
    arrival: a column that numbers the rows; a key arrives with the first of its rows. Without it keys arrive by their value."""
    there = keys.where(F.col(column).isNotNull())
    if arrival:
        distinct = there.groupBy(F.col(column).alias("key")).agg(F.min(arrival).alias("arrival"))
    else:
        distinct = there.select(F.col(column).alias("key")).distinct().withColumn("arrival", F.col("key"))
    distinct = stored(distinct, "ribbon-keys")
    rows = distinct.withColumn("shard", shard_of(F.col("key"), max(1, -(-distinct.count() // shard_keys))))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).withColumn("slots", slots_column(F.col("n"), spec)).withColumn("seed", F.lit(spec.seed).cast("bigint"))
    return rows, stored(sizes, "ribbon-sizes")


def build(keys: DataFrame, spec: Spec = Spec(), strategy: str = "windowed", column: str = "key", ranges: int = 4, margin: int = 0, shift: int = 10, shard_keys: int = SHARD_KEYS, arrival: str | None = None, shuffle: int = 0) -> DataFrame:
    """The filter of the distinct keys that aren't null. The order of insertion is that of the strategy, or of a hash
    of key and shuffle for the strategy "shuffled"."""
    rows, sizes = dealt(keys, spec, column, shard_keys, arrival)
    return stored(_built(rows, sizes, spec, strategy, ranges, margin, shift, shuffle), "ribbon")


def _built(rows: DataFrame, sizes: DataFrame, spec: Spec, strategy: str = "windowed", ranges: int = 4, margin: int = 0, shift: int = 10, shuffle: int = 0) -> DataFrame:
    """The filter of the rows (key, shard, arrival) of the shards that sizes has."""
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SHARDS else sizes, "shard")
    w, r, standard = spec.w, spec.r, spec.standard

    def equations(pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
        key = pdf.key.to_numpy()
        h, start = _hashed(key, int(pdf.seed.iloc[0]), int(pdf.slots.iloc[0]), w)
        return kernel.equations(h, start, w, kernel.fingerprints(key, r) if standard else None)

    def finish(pdf: pd.DataFrame, n: int, band: kernel.Band, spilled: int, redundant: int, bad: int) -> pd.DataFrame:
        slots = int(pdf.slots.iloc[0])
        z = kernel.back_substitute(band.rows, slots, r, w)
        row = (int(pdf.shard.iloc[0]), int(pdf.seed.iloc[0]), n, slots, len(band.rows), redundant + band.redundant, spilled, bad + band.contradictions, z.astype("<u2").tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in FILTER.split(", ")])

    if strategy in ("arrival", "sorted", "windowed", "shuffled"):
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            if strategy == "arrival":
                pdf = pdf.sort_values(["arrival", "key"])
            elif strategy == "shuffled":
                pdf = pdf.iloc[np.argsort(bits.np_hash(bits.np_mix64(pdf.key.to_numpy()), shuffle))]
            else:
                at = _hashed(pdf.key.to_numpy(), int(pdf.seed.iloc[0]), int(pdf.slots.iloc[0]), w)[1] >> (shift if strategy == "windowed" else 0)
                pdf = pdf.iloc[np.argsort(at, kind="stable")]
            return finish(pdf, len(pdf), kernel.Band(int(pdf.slots.iloc[0])).add(equations(pdf)), 0, 0, 0)

        return rows.groupBy("shard").applyInPandas(whole, FILTER)
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "ranges":
        part = F.floor(_start_of(F.col("key"), F.col("seed"), F.col("slots") - w + 1) / F.ceil(F.col("slots") / ranges))
    else:
        part = F.pmod(F.xxhash64("key"), F.lit(ranges))
    partial = "shard bigint, seed bigint, n bigint, slots bigint, redundant bigint, spilled bigint, contradictions bigint, starts array<bigint>, coeffs array<binary>, rhs array<int>"

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        """The table of a part; keys past its cap, or within margin of it, are left to the tail."""
        slots = int(pdf.slots.iloc[0])
        cap = slots
        if strategy == "ranges":
            size = -(-slots // ranges)
            cap = min(slots, (int(pdf.part.iloc[0]) + 1) * size)
        made = equations(pdf)
        late = [e for e in made if cap < slots and e[0] + margin >= cap]
        band = kernel.Band(cap).add(e for e in made if not (cap < slots and e[0] + margin >= cap))
        row = {"shard": [int(pdf.shard.iloc[0])], "seed": [int(pdf.seed.iloc[0])], "n": [len(pdf)], "slots": [slots], "redundant": [band.redundant], "spilled": [len(band.spilled) + len(late)], "contradictions": [band.contradictions]}
        return pd.DataFrame(row | _packed(band.equations() + band.spilled + late, w))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        band = kernel.Band(int(pdf.slots.iloc[0]))
        for p in pdf.itertuples():
            band.add(_unpacked(p.starts, p.coeffs, p.rhs))
        return finish(pdf, int(pdf.n.sum()), band, int(pdf.spilled.sum()), int(pdf.redundant.sum()), int(pdf.contradictions.sum()))

    pieces = rows.withColumn("part", part.cast("bigint")).groupBy("shard", "part").applyInPandas(piece, partial)
    return pieces.groupBy("shard").applyInPandas(merge, FILTER)


def _packed(equations: list[tuple[int, int, int]], w: int, prefix: str = "") -> dict[str, list]:
    return {f"{prefix}starts": [[e[0] for e in equations]], f"{prefix}coeffs": [[e[1].to_bytes(w // 8, "little") for e in equations]], f"{prefix}rhs": [[e[2] for e in equations]]}


def _unpacked(starts, coeffs, rhs):
    return ((int(s), int.from_bytes(c, "little"), int(b)) for s, c, b in zip(starts, coeffs, rhs, strict=True))


def build_standard(keys: DataFrame, spec: Spec, column: str = "key", shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, Spec]:
    """A standard ribbon, whose lookups give the keys' fingerprints. Each shard has its own seed: shards whose equations
    contradict each other are built again under the next one, alone. seed less spec.seed is a shard's number of rebuilds."""
    spec = replace(spec, standard=True)
    rows, sizes = dealt(keys, spec, column, shard_keys)
    if sizes.where("n > slots").limit(1).count():
        raise ValueError("a shard has more keys than slots: no seed can work")
    done, todo = None, sizes
    for seed in range(spec.seed, spec.seed + SEEDS):
        tried = stored(_built(rows, todo, spec), "ribbon-tried")
        good = tried.where("contradictions = 0")
        done = good if done is None else done.unionByName(good)
        todo = tried.where("contradictions > 0").select("shard", "n", "slots", F.lit(seed + 1).cast("bigint").alias("seed"))
        if not todo.limit(1).count():
            return stored(done, "ribbon"), spec
        rows = rows.join(F.broadcast(todo.select("shard")) if sizes.count() <= BROADCAST_SHARDS else todo.select("shard"), "shard", "left_semi")
    raise ValueError(f"no seed of {SEEDS} works at this size")


def looked_up(probes: DataFrame, filter_: DataFrame, spec: Spec = Spec(), column: str = "key", out: str = "value", salts: int = 8) -> DataFrame:
    """probes with the value that the filter gives for their key: 0 for every member of a homogeneous ribbon, its
    fingerprint for one of a standard ribbon, anything for other keys; null for null keys and shards without keys.

    A filter of bounded size is broadcast; a larger one meets its probes shard by shard, a hot
    shard's probes being dealt to several groups."""
    w = spec.w
    size, shards = filter_.agg(F.coalesce(F.sum("slots"), F.lit(0)) * 2, F.coalesce(F.max("shard"), F.lit(-1)) + 1).first()
    if not shards:
        return probes.withColumn(out, F.lit(None).cast("int"))

    def ask(z: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
        h, start = _hashed(key, seed, len(z), w)
        return kernel.lookup(z, h, start, w)

    there = F.col(column).isNotNull()
    hashed = probes.withColumns({"__shard": F.when(there, shard_of(F.col(column), int(shards))).otherwise(-1), "__key": F.coalesce(column, F.lit(0).cast("bigint"))})
    if size <= BROADCAST_BYTES:
        tables = {x.shard: (np.frombuffer(x.z, "<u2"), x.seed) for x in filter_.select("shard", "z", "seed").collect()}  # BROADCAST_BYTES at most
        sent = probes.sparkSession.sparkContext.broadcast(tables)

        @F.pandas_udf("int")
        def values(shard: pd.Series, key: pd.Series) -> pd.Series:
            found, which, asked = np.full(len(key), -1, np.int32), shard.to_numpy(), key.to_numpy()
            for s in np.unique(which):
                if s in sent.value:
                    at = which == s
                    found[at] = ask(sent.value[s][0], asked[at], sent.value[s][1])
            return pd.Series(found).astype("Int32").where(found >= 0)

        return hashed.withColumn(out, values("__shard", "__key")).drop("__shard", "__key")
    left = hashed.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    right = filter_.select(F.col("shard").alias("__shard"), "z", "seed").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    columns = [F.struct(*probes.columns).alias("__row"), "__shard", "__key", "__salt"]
    inner = left.select(*columns)
    arrow = inner.schema["__row"].dataType.simpleString()

    def shard_values(rows: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        found = np.full(len(rows), -1, np.int32)
        if len(tables):
            found[:] = ask(np.frombuffer(tables.z.iloc[0], "<u2"), rows["__key"].to_numpy(np.int64), int(tables.seed.iloc[0]))
        return pd.DataFrame({"__row": rows["__row"], "__value": found})

    met = inner.groupBy("__shard", "__salt").cogroup(right.groupBy("__shard", "__salt")).applyInPandas(shard_values, f"__row {arrow}, __value int")
    return met.select("__row.*", F.when(F.col("__value") >= 0, F.col("__value")).alias(out))


def fingerprint(key: Column, r: int) -> Column:
    """kernel.fingerprints as a column, by lambdas."""
    return bits.mix64(key.bitwiseXOR(F.lit(bits.signed(bits.GOLDEN)))).bitwiseAND(F.lit((1 << r) - 1)).cast("int")


def might_contain(probes: DataFrame, filter_: DataFrame, spec: Spec = Spec(), column: str = "key", out: str = "hit", salts: int = 8) -> DataFrame:
    """probes with whether the filter may hold their key; null keys are never found."""
    found = looked_up(probes, filter_, spec, column, "__value", salts)
    want = fingerprint(F.col(column), spec.r) if spec.standard else F.lit(0)
    return found.withColumn(out, F.coalesce(F.col("__value") == want, F.lit(False))).drop("__value")


# --- one ribbon over ranges of slots -------------------------------------------------------------------
_BAND = "range bigint, n bigint, redundant bigint, contradictions bigint, starts array<bigint>, coeffs array<binary>, rhs array<int>, late_starts array<bigint>, late_coeffs array<binary>, late_rhs array<int>"
RANGED = "range bigint, first bigint, n bigint, occupied bigint, redundant bigint, contradictions bigint, z binary"
_MAP = "range bigint, masks array<binary>, consts array<int>"


def build_over_ranges(keys: DataFrame, spec: Spec = Spec(), column: str = "key", range_slots: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(range, first, n, occupied, redundant, contradictions, z) for each range of slots of one ribbon, stored, and the
    ribbon's number of slots. The solution is that of the ribbon built as a whole; no task holds more than a range.

    Banding: each range inserts the equations that start in it; those reduced past its end go on to the range where
    they start now, until none is left (order doesn't matter, so it is the whole ribbon's table). Solving: the values that a
    range gives its left neighbour are an affine map of those it gets from the right; maps are composed by doubling
    (ceil(log2(ranges)) joins of a small row a range), then every range is solved with what it gets."""
    w, r, standard, seed = spec.w, spec.r, spec.standard, spec.seed
    distinct = stored(keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct(), "ribbon-keys")
    slots = spec.slots(distinct.count())
    width = max(range_slots, w)
    ranges = -(-slots // width)

    def cap(k: int) -> int:
        return min(slots, (k + 1) * width)

    def row(k: int, n: int, redundant: int, bad: int, band: kernel.Band) -> pd.DataFrame:
        counts = {"range": [k], "n": [n], "redundant": [redundant + band.redundant], "contradictions": [bad + band.contradictions]}
        return pd.DataFrame(counts | _packed(band.equations(), w) | _packed(band.spilled, w, "late_"))

    def banded(pdf: pd.DataFrame) -> pd.DataFrame:
        key, k = pdf.key.to_numpy(), int(pdf.range.iloc[0])
        h, start = _hashed(key, seed, slots, w)
        made = kernel.equations(h, start, w, kernel.fingerprints(key, r) if standard else None)
        return row(k, len(pdf), 0, 0, kernel.Band(cap(k)).add(made))

    def rebanded(there: pd.DataFrame, late: pd.DataFrame) -> pd.DataFrame:
        k = int(late.range.iloc[0])
        band = kernel.Band(cap(k))
        for p in there.itertuples():
            band.add(_unpacked(p.starts, p.coeffs, p.rhs))
        band.add(_unpacked(late.start, late.coeff, late.rhs))
        return row(k, int(there.n.sum()), int(there.redundant.sum()), int(there.contradictions.sum()), band)

    start = _start_of(F.col("key"), F.lit(seed).cast("bigint"), F.lit(slots - w + 1).cast("bigint"))
    every = distinct.withColumn("range", F.floor(start / width))
    bands = stored(every.groupBy("range").applyInPandas(banded, _BAND), "ribbon-bands")
    none = {f"late_{c}": F.array().cast(t) for c, t in (("starts", "array<bigint>"), ("coeffs", "array<binary>"), ("rhs", "array<int>"))}
    while True:
        late = bands.select(F.explode(F.arrays_zip("late_starts", "late_coeffs", "late_rhs")).alias("e"))
        late = late.select(F.floor(F.col("e.late_starts") / width).alias("range"), F.col("e.late_starts").alias("start"), F.col("e.late_coeffs").alias("coeff"), F.col("e.late_rhs").alias("rhs"))
        late = stored(late, "ribbon-late")
        if not late.limit(1).count():
            break
        touched = late.select("range").distinct()
        again = bands.join(touched, "range", "left_semi").groupBy("range").cogroup(late.groupBy("range")).applyInPandas(rebanded, _BAND)
        rest = bands.join(touched, "range", "left_anti").withColumns(none)
        bands = stored(rest.select(*again.columns).unionByName(again), "ribbon-bands")
    # a range without any equation solves to its free slots
    whole = bands.sparkSession.range(ranges).withColumnRenamed("id", "range").join(bands.drop(*none).hint("merge"), "range", "left")
    whole = stored(whole.fillna(0, ["n", "redundant", "contradictions"]), "ribbon-banded")

    def rows_of(p) -> dict[int, tuple[int, int]]:
        return {} if p.starts is None else {s: (c, b) for s, c, b in _unpacked(p.starts, p.coeffs, p.rhs)}

    def packed_map(k: int, found: kernel.Affine) -> dict:
        return {"range": k, "masks": [m.to_bytes(w // 8, "little") for m in found[0]], "consts": found[1]}

    def mapped(batches):
        for pdf in batches:
            yield pd.DataFrame([packed_map(p.range, kernel.affine(rows_of(p), p.range * width, cap(p.range) - p.range * width, r, w)) for p in pdf.itertuples()], columns=["range", "masks", "consts"])

    def joined(batches):
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                left, right = (([int.from_bytes(m, "little") for m in masks], list(map(int, consts))) for masks, consts in ((p.masks, p.consts), (p.masks2, p.consts2)))
                out.append(packed_map(p.range, kernel.composed(left, right)))
            yield pd.DataFrame(out, columns=["range", "masks", "consts"])

    tasks = max(1, -(-slots // max(width, SHARD_KEYS)))  # a task takes some SHARD_KEYS slots, or a range that has more
    maps = stored(whole.repartition(tasks, "range").mapInPandas(mapped, _MAP), "ribbon-maps")
    reach = 1
    while reach < ranges:  # each map covers reach ranges from its own on, or all to the end
        right = maps.select((F.col("range") - reach).alias("range"), F.col("masks").alias("masks2"), F.col("consts").alias("consts2"))
        maps = stored(maps.join(right, "range").mapInPandas(joined, _MAP).unionByName(maps.where(F.col("range") >= ranges - reach)), "ribbon-maps")
        reach *= 2
    states = maps.select((F.col("range") - 1).alias("range"), F.col("consts").alias("state"))

    def solved(batches):
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                rows, first = rows_of(p), p.range * width
                z = kernel.back_substitute(rows, cap(p.range) - first, r, w, first=first, state=None if p.state is None else [int(x) for x in p.state])
                out.append((p.range, first, p.n, len(rows), p.redundant, p.contradictions, z.astype("<u2").tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RANGED.split(", ")])

    return stored(whole.join(states, "range", "left").repartition(tasks, "range").mapInPandas(solved, RANGED), "ribbon-ranged"), slots


def build_standard_over_ranges(keys: DataFrame, spec: Spec, column: str = "key", range_slots: int = SHARD_KEYS) -> tuple[DataFrame, int, Spec]:
    """A standard ribbon over ranges of slots, by the first seed that works: it is one ribbon, so all of it has one seed."""
    for seed in range(spec.seed, spec.seed + SEEDS):
        tried = replace(spec, seed=seed, standard=True)
        filter_, slots = build_over_ranges(keys, tried, column, range_slots)
        if not filter_.where("contradictions > 0").limit(1).count():
            return filter_, slots, tried
    raise ValueError(f"no seed of {SEEDS} works at this size")


def slot_values(filter_: DataFrame) -> DataFrame:
    """slot, value of a ranged filter, a row for each slot."""
    at = filter_.select("first", "z", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.octet_length("z") / 2).cast("bigint") - 1)).alias("k"))

    def byte(j: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("z"), (2 * F.col("k") + 1 + j).cast("int"), F.lit(1))), 16, 10).cast("int")

    return at.select((F.col("first") + F.col("k")).alias("slot"), (byte(0) + 256 * byte(1)).alias("value"))


def slot_planes(filter_: DataFrame, r: int) -> DataFrame:
    """block, b0, b1 ..: 64 neighbouring slots of a ranged filter a row; bit j of word k is bit k of the value of the block's slot j."""
    each = slot_values(filter_).withColumns({"block": F.shiftright("slot", 6), "at": F.col("slot").bitwiseAND(F.lit(63))})

    def plane(k: int) -> Column:
        return F.bit_or(bits.shift_left(F.shiftright("value", k).bitwiseAND(F.lit(1)).cast("bigint"), F.col("at")))

    return each.groupBy("block").agg(*(plane(k).alias(f"b{k}") for k in range(r)))


def looked_up_by_join(probes: DataFrame, filter_: DataFrame, slots: int, spec: Spec = Spec(), column: str = "key", out: str = "value") -> DataFrame:
    """The distinct keys of probes that aren't null, with the value that a ranged filter gives them, as a relation:
    each key's equation is cut at the two blocks of 64 slots that it lies in, its parts meet the blocks' values, bit by bit,
    and are XORed by key. Only generated code: no task needs more of the filter than its part of the join, which goes by merge, since
    Spark sizes exploded slots like their packed row and would broadcast them. Slots are hashes, and a key is one
    row however often it is asked for, so neither side has a hot key. For equations of 64 slots."""
    if spec.w != 64:
        raise ValueError("an equation's slots are the bits of one word here")
    keys = probes.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
    placed = bits.with_hash(keys, "key", "h", spec.seed, filled=True).withColumn("start", bits.scaled(F.col("h"), slots - spec.w + 1))
    placed = bits.with_mix64(placed, "h", "coeff", filled=True).select("key", "start", F.col("coeff").bitwiseOR(F.lit(1)).alias("coeff"))
    each = placed.select("key", "start", "coeff", F.explode(F.array(F.lit(0), F.lit(1))).alias("next"))
    off = F.col("start").bitwiseAND(F.lit(63))
    # a shift by 64 is one by 0: what starts with a block has no part in the next
    rest = F.when(off > 0, F.call_function("shiftrightunsigned", F.col("coeff"), (64 - off).cast("int"))).otherwise(0)
    part = F.when(F.col("next") == 0, bits.shift_left(F.col("coeff"), off)).otherwise(rest)
    each = each.select("key", (F.shiftright("start", 6) + F.col("next")).alias("block"), part.alias("part"))
    value = sum((F.shiftleft(F.bit_count(F.col("part").bitwiseAND(F.col(f"b{k}"))).bitwiseAND(F.lit(1)), k) for k in range(spec.r)), F.lit(0))
    met = each.join(slot_planes(filter_, spec.r).hint("merge"), "block").select("key", value.alias("value"))
    return met.groupBy("key").agg(F.bit_xor("value").alias(out))


def broken_ranges(keys: DataFrame, filter_: DataFrame, slots: int, range_slots: int, spec: Spec = Spec(), column: str = "key") -> DataFrame:
    """range: the ranges of slots that the equation of a key lies in, for each key whose equation the filter's values break."""
    found = looked_up_by_join(keys, filter_, slots, spec, column, "value")
    want = fingerprint(F.col("key"), spec.r) if spec.standard else F.lit(0)
    at = starts(found.where(F.col("value") != want).select("key"), slots, spec)
    width = max(range_slots, spec.w)
    last = F.floor((F.col("start") + spec.w - 1) / width)
    return at.select(F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("range")).distinct()


def digest(filter_: DataFrame) -> DataFrame:
    """One row: sha256 over the shards' solutions in order, slots, occupied slots, redundant keys.
    A shard is reduced to its own digest first."""
    each = filter_.select("shard", "slots", "occupied", "redundant", F.sha2("z", 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shard", "d"))), lambda x: x["d"]), ""), 256)
    return each.agg(joined.alias("digest"), F.sum("slots").alias("slots"), F.sum("occupied").alias("occupied"), F.sum("redundant").alias("redundant"))
