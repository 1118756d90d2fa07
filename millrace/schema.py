"""Declared schemas, the five value types, event times in milliseconds, and checks of column names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnNameConflict(ValueError):
    """A result would hold two columns of one name."""


class IllegalSize(ValueError):
    """A callback gave a wrong number of rows or columns."""


#: Value types by name. BIGDECIMAL beyond 38 digits is kept exact as VARBYTE.
TYPES: dict[str, T.DataType] = {
    "VARBYTE": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BIGDECIMAL": T.DecimalType(38, 18),
}


class SchemaBuilder:
    """Ordered columns and their types: ``SchemaBuilder().column("id", "BIGINT").build()``."""

    def __init__(self) -> None:
        self._fields: list[T.StructField] = []

    def column(self, name: str, kind: str) -> SchemaBuilder:
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind}; known: {', '.join(TYPES)}")
        self._fields.append(T.StructField(name, TYPES[kind]))
        return self

    def build(self) -> T.StructType:
        check_names(f.name for f in self._fields)
        return T.StructType(self._fields)


def check_names(names: Iterable[str]) -> None:
    twice = [n for n, k in Counter(x.lower() for x in names).items() if k > 1]
    if twice:
        raise ColumnNameConflict(f"columns occur twice: {', '.join(sorted(twice))}")


def checked(df: DataFrame) -> DataFrame:
    check_names(df.columns)
    return df


def to_ms(ts: Column) -> Column:
    """Epoch milliseconds, rounded down; a time without zone counts as UTC where the session's zone is UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def with_event_time(df: DataFrame, ms_col: str, ts_col: str = "event_time", delay: str | None = None) -> DataFrame:
    """Adds the timestamp that event-time operators need; with a delay also the watermark on it."""
    out = df.withColumn(ts_col, to_ts(F.col(ms_col)))
    return out.withWatermark(ts_col, delay) if delay else out
