"""Event-time windows over bounded tables. Times are epoch milliseconds (bigint); null times are dropped."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import check_names, to_ts
from .callbacks import grouped

START, END = "window_start", "window_end"


def check_sizes(size: int, slide: int, keys: Sequence[str], outputs: Sequence[str]) -> None:
    if size <= 0 or slide <= 0 or slide > size:
        raise ValueError("sizes must be positive, and the slide at most the size")
    if not outputs:
        raise ValueError("at least one output column is needed")
    check_names([*keys, START, END, *outputs])


def assign_hops(df: DataFrame, time: str, size: int, slide: int, first: int | None = None) -> DataFrame:
    """Each row once for each window [start, start + size) that holds it; starts are first + k * slide, k >= 0.

    first: by default the multiple of size that lies at or before the earliest time of the table, found in
    the same job as one broadcast row."""
    rows = df.where(F.col(time).isNotNull())
    if first is None:
        low = rows.agg(F.min(time).alias("_low")).select((F.floor(F.col("_low") / size) * size).alias("_w0"))
        rows = rows.join(F.broadcast(low))  # one row
    else:
        rows = rows.withColumn("_w0", F.lit(first).cast("long"))
    last = F.floor((F.col(time) - F.col("_w0")) / slide)
    back = F.sequence(F.lit(0), F.lit(-(-size // slide) - 1))
    starts = F.transform(back, lambda k: F.col("_w0") + (last - k) * slide)
    fit = F.filter(starts, lambda s: (s >= F.col("_w0")) & (F.col(time) - s < size))
    return rows.withColumn(START, F.explode(fit)).withColumn(END, F.col(START) + size).drop("_w0")


def hop(df: DataFrame, keys: Sequence[str], time: str, size: int, slide: int, aggregates: Mapping[str, Column], first: int | None = None) -> DataFrame:
    """keys, window_start, window_end and aggregates of each hopping window that holds a row."""
    check_sizes(size, slide, keys, list(aggregates))
    return assign_hops(df, time, size, slide, first).groupBy(*keys, START, END).agg(*[c.alias(n) for n, c in aggregates.items()])


def tumble(df: DataFrame, keys: Sequence[str], time: str, size: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """Windows that don't overlap; no row is repeated."""
    check_sizes(size, size, keys, list(aggregates))
    start = (F.floor(F.col(time) / size) * size).cast("long")
    rows = df.where(F.col(time).isNotNull()).withColumn(START, start).withColumn(END, F.col(START) + size)
    return rows.groupBy(*keys, START, END).agg(*[c.alias(n) for n, c in aggregates.items()])


def session(df: DataFrame, keys: Sequence[str], time: str, gap: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """A session ends where the next row is gap or more later; it is [first time, last time + 1)."""
    check_sizes(gap, gap, keys, list(aggregates))
    out = [c.alias(n) for n, c in aggregates.items()]
    bounds = [F.min(time).alias(START), (F.max(time) + 1).alias(END)]
    rows = df.where(F.col(time).isNotNull())
    if gap == 1:  # a session is one millisecond
        grouped = rows.withColumn("_w", F.col(time)).groupBy(*keys, "_w")
    else:  # the built-in one merges rows that are exactly its gap apart
        grouped = rows.groupBy(*keys, F.session_window(to_ts(F.col(time)), f"{gap - 1} milliseconds").alias("_w"))
    return grouped.agg(*bounds, *out).select(*keys, START, END, *aggregates)


def over_duration(df: DataFrame, keys: Sequence[str], time: str, size: int, new: Mapping[str, Column]) -> DataFrame:
    """Each row with aggregates over its key's rows from its own time up to, but without, size later."""
    check_names([*df.columns, *new])
    if size <= 0:
        raise ValueError("size must be positive")
    frame = Window.partitionBy(*keys).orderBy(time).rangeBetween(0, size - 1)
    return df.where(F.col(time).isNotNull()).select("*", *[c.over(frame).alias(n) for n, c in new.items()])


def over_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, new: Mapping[str, Column]) -> DataFrame:
    """Each row with aggregates over the last n rows of its key, itself included."""
    check_names([*df.columns, *new])
    if n <= 0:
        raise ValueError("n must be positive")
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.select("*", *[c.over(frame).alias(k) for k, c in new.items()])


def window_transform(df: DataFrame, keys: Sequence[str], time: str, size: int, slide: int, body: Callable[[tuple, pd.DataFrame, int, int], list[tuple] | None], schema: str, first: int | None = None) -> DataFrame:
    """body(key, rows, start, end) gives any number of tuples for each hopping window; None gives none.

    Rows come in order of time. The output has keys, window_start, window_end and the columns of schema."""
    new = T.StructType.fromDDL(schema)
    check_sizes(size, slide, keys, new.fieldNames())
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField(START, T.LongType()), T.StructField(END, T.LongType()), *new.fields])

    def one(key: tuple, rows: pd.DataFrame) -> list[tuple]:
        *own, start, end = key
        made = body(tuple(own), rows.drop(columns=[START, END]), int(start), int(end)) or []
        return [(*key, *x) for x in made]

    return grouped(assign_hops(df, time, size, slide, first), [*keys, START, END], [time], one, out)
