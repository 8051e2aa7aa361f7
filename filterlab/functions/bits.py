"""64-bit hashing in column expressions that wrap like unsigned machine words, under ANSI mode.

A key is a bigint that holds 64 bits. Products are taken limb by limb, so nothing overflows. Each
step of a hash binds its input once (see ``let``), so a hash stays one small expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M16, M32, M64 = (1 << 16) - 1, (1 << 32) - 1, (1 << 64) - 1
#: The multipliers of the splitmix64 finalizer, its increment, and those of the seeded hash.
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
HASH_A, HASH_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: The salts of the Parquet split-block Bloom filter.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def signed(x: int) -> int:
    """The bigint with the bits of an unsigned x."""
    x &= M64
    return x - (1 << 64) if x >> 63 else x


def shift_left(x: Column, n: Column) -> Column:
    """x << n for a column n."""
    return F.call_function("shiftleft", x, n.cast("int"))


def shift_right(x: Column, n: Column) -> Column:
    """x >> n for a column n."""
    return F.call_function("shiftright", x, n.cast("int"))


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def high32(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def mul32(x: Column, c: int) -> Column:
    """x * c mod 2**32, for x below 2**32."""
    return low32(x * F.lit(c & M16) + F.shiftleft((x * F.lit(c >> 16 & M16)).bitwiseAND(F.lit(M16)), 16))


def let(x: Column, body) -> Column:
    """body(x) with x computed once. A limb product names its input six times; chained and inlined,
    a hash would grow beyond what the optimizer and the code generator can take. Lambdas are interpreted:
    where rows are many, use with_mix64 and with_hash."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _product(v: Column, c: int) -> Column:
    c_lo, c_hi = c & M32, c >> 32 & M32
    lo, hi = low32(v), high32(v)
    first, second = lo * F.lit(c_lo & M16), lo * F.lit(c_lo >> 16)
    low = first + F.shiftleft(second.bitwiseAND(F.lit(M16)), 16)
    high = high32(low) + F.shiftrightunsigned(second, 16) + mul32(lo, c_hi) + mul32(hi, c_lo)
    return F.shiftleft(low32(high), 32).bitwiseOR(low32(low))


def _plus(v: Column, c: int) -> Column:
    low = low32(v) + F.lit(c & M32)
    return F.shiftleft(low32(high32(v) + F.lit(c >> 32 & M32) + high32(low)), 32).bitwiseOR(low32(low))


def _times(c: int):
    return lambda v: _product(v, c)


def _shifted(n: int):
    return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n))


def mul64(x: Column, c: int) -> Column:
    """x * c mod 2**64."""
    return let(x, _times(c))


def add64(x: Column, c: int) -> Column:
    """x + c mod 2**64."""
    return let(x, lambda v: _plus(v, c)) if c else x


def xor_shift(x: Column, n: int) -> Column:
    return let(x, _shifted(n))


def mix64(x: Column) -> Column:
    """The splitmix64 finalizer."""
    return xor_shift(mul64(xor_shift(mul64(xor_shift(x, 30), MIX_A), 27), MIX_B), 31)


def seeded_hash(x: Column, seed: int = 0) -> Column:
    """Two xor-shift-multiply rounds over x + seed."""
    return xor_shift(mul64(xor_shift(mul64(xor_shift(add64(x, seed), 33), HASH_A), 33), HASH_B), 33)


def _stepped(df: DataFrame, source: Column, out: str, steps: list) -> DataFrame:
    """df with out, made of source by one projection for each step. A step names its input several times, so
    Catalyst leaves the projections apart, and all of them are generated code: a lambda (see let) isn't."""
    df = df.withColumn(out, F.coalesce(source, F.lit(0).cast("bigint")))
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return df


def with_mix64(df: DataFrame, source: Column | str, out: str, filled: bool = False) -> DataFrame:
    """df with the mix of source. filled hashes a null like 0, by generated code, which is faster. Take it
    where the hash only leads to joins, groups and orders: a filter on it would be pushed below all its steps,
    which the optimizer then writes out into one expression. That nothing is null keeps it from asking so itself."""
    x = F.col(source) if isinstance(source, str) else source
    return _stepped(df, x, out, [_shifted(30), _times(MIX_A), _shifted(27), _times(MIX_B), _shifted(31)]) if filled else df.withColumn(out, mix64(x))


def with_hash(df: DataFrame, source: Column | str, out: str, seed: int = 0, filled: bool = False) -> DataFrame:
    """df with the seeded hash of source; filled as in with_mix64."""
    x = F.col(source) if isinstance(source, str) else source
    first = [lambda v: _plus(v, seed)] if seed else []
    return _stepped(df, x, out, [*first, _shifted(33), _times(HASH_A), _shifted(33), _times(HASH_B), _shifted(33)]) if filled else df.withColumn(out, seeded_hash(x, seed))


def scaled(h: Column, n: Column | int) -> Column:
    """floor(h * n / 2**64) of an unsigned h, for n below 2**31."""
    n = F.lit(n) if isinstance(n, int) else n
    return high32(high32(h) * n + high32(low32(h) * n))


def string_key(text: Column) -> Column:
    """A 60-bit key of a string: the first fifteen hex digits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest set bit of a positive x."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


# --- the same over NumPy words, for kernels ------------------------------------------------------
def np_mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def np_hash(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The seeded hash."""
    x = x.astype(np.uint64) + np.uint64(seed & M64)
    for c in (HASH_A, HASH_B):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


def np_scaled(h: np.ndarray, n: int) -> np.ndarray:
    h, n, m, s = h.astype(np.uint64), np.uint64(n), np.uint64(M32), np.uint64(32)
    return (((h >> s) * n + (((h & m) * n) >> s)) >> s).astype(np.int64)


# --- the same in DuckDB's SQL, for oracles -------------------------------------------------------
def sql_unsigned(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN ({x})::HUGEINT + 18446744073709551616 ELSE ({x})::HUGEINT END)::UBIGINT"


def sql_signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN ({x})::HUGEINT - 18446744073709551616 ELSE ({x})::HUGEINT END)::BIGINT"


def sql_times(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def sql_chain(name: str, source: str, column: str, out: str, steps: list[str]) -> str:
    """CTEs name_0, name_1 ... over source; step k makes column out from {x}. The last is called name."""
    ctes, at = [], source
    for k, step in enumerate(steps):
        new = name if k == len(steps) - 1 else f"{name}_{k}"
        x = column if k == 0 else out
        keep = "*" if k == 0 else f"* EXCLUDE ({out})"
        ctes.append(f"{new} AS (SELECT {keep}, {step.format(x=x)} AS {out} FROM {at})")
        at = new
    return ", ".join(ctes)


def sql_mix64(name: str, source: str, column: str, out: str = "h") -> str:
    return sql_chain(name, source, column, out, ["xor({x}, {x} >> 30)", sql_times("{x}", MIX_A), "xor({x}, {x} >> 27)", sql_times("{x}", MIX_B), "xor({x}, {x} >> 31)"])


def sql_hash(name: str, source: str, column: str, out: str = "h", seed: int = 0) -> str:
    plus = f"((({{x}})::UHUGEINT + {seed}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return sql_chain(name, source, column, out, [plus, "xor({x}, {x} >> 33)", sql_times("{x}", HASH_A), "xor({x}, {x} >> 33)", sql_times("{x}", HASH_B), "xor({x}, {x} >> 33)"])


def sql_scaled(h: str, n: str) -> str:
    return f"((({h})::UHUGEINT * ({n})::UHUGEINT) >> 64)::BIGINT"
