"""Aggregates, rankings and scalars, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Aggregates


def group_concat(value: Column | str, order: Column | str, separator: str = ",") -> Column:
    """Values in this order; null is written 'null'."""
    rows = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), F.coalesce(_c(value).cast("string"), F.lit("null")).alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), separator)


def sum_int(value: Column | str) -> Column:
    """Nulls are skipped; 0 without a value. Doesn't wrap."""
    return F.coalesce(F.sum(_c(value).cast("long")), F.lit(0)).cast("long")


def sum_long(value: Column | str) -> Column:
    """A double; 0 without a value."""
    return F.coalesce(F.sum(_c(value).cast("double")), F.lit(0.0))


sum_double = sum_long


def max_of(value: Column | str) -> Column:
    return F.max(_c(value))


def min_of(value: Column | str) -> Column:
    return F.min(_c(value))


def count_rows() -> Column:
    return F.count(F.lit(1))


def avg_all_rows(value: Column | str) -> Column:
    """The sum over the number of all rows, those with null included."""
    return sum_double(value) / F.count(F.lit(1))


# Ranking


def top_n(df: DataFrame, partition: Sequence[str], value: str, n: int, position: str, rank: str = "rank") -> DataFrame:
    """The n rows of greatest value in each partition. At the boundary earlier positions win; among equal values
    the ranks of the chosen go to later positions first. Nulls come last."""
    window = Window.partitionBy(*partition)
    chosen = df.withColumn(rank, F.row_number().over(window.orderBy(F.col(value).desc_nulls_last(), F.col(position).asc()))).where(F.col(rank) <= n)
    return chosen.withColumn(rank, F.row_number().over(window.orderBy(F.col(value).desc_nulls_last(), F.col(position).desc())))


def row_rank() -> Column:
    """The number of a row in its partition."""
    return F.row_number()


# Scalars


def to_integer(value: Column | str) -> Column:
    return _c(value).try_cast("int")


def to_long(value: Column | str) -> Column:
    return _c(value).try_cast("long")


def to_double(value: Column | str) -> Column:
    return _c(value).try_cast("double")


def to_str(value: Column | str) -> Column:
    return _c(value).cast("string")


def to_big_decimal(value: Column | str, scale: int = 18) -> Column:
    return _c(value).try_cast(f"decimal(38,{scale})")


def substr(value: Column | str, begin: int, end: int | None = None) -> Column:
    """From begin, counted from 0, up to but without end. What lies outside is empty."""
    if begin < 0 or end is not None and end < begin:
        raise ValueError("begin must not be negative, nor end before it")
    v = _c(value).cast("string")
    return F.substring(v, begin + 1, (1 << 31) - 1 - begin if end is None else end - begin)


def ltrim(value: Column | str, char: str) -> Column:
    return F.ltrim(_c(value), F.lit(char))


def rtrim(value: Column | str, char: str) -> Column:
    return F.rtrim(_c(value), F.lit(char))


def trim(value: Column | str, char: str) -> Column:
    return F.trim(_c(value), F.lit(char))


def _murmur(data: bytes, seed: int = 104729) -> int:
    """MurmurHash3, 32 bits. Tail bytes count as signed, as in the widespread Java version of it."""
    mask, h = 0xFFFFFFFF, seed
    mix = lambda k: (((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) & mask) * 0x1B873593 & mask
    n = len(data) // 4 * 4
    for i in range(0, n, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    k = 0
    for i in reversed(range(len(data) - n)):
        byte = data[n + i] - 256 if data[n + i] > 127 else data[n + i]
        k ^= byte << 8 * i
    if len(data) > n:
        h ^= mix(k & mask)
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_hash32(value: Column | str) -> Column:
    """Signed; of the UTF-8 bytes of a string. Spark's own hash has another seed."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _murmur(bytes(x))).astype("Int32")

    return run(_c(value).cast("binary"))


# Dates; epoch milliseconds


def parse_date(value: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """In the session's time zone; null where it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(_c(value), F.lit(pattern)))


def parse_date_with_zone(value: Column | str) -> Column:
    return parse_date(value, "yyyy-MM-dd HH:mm:ss z")


def format_date(ms: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), pattern)
