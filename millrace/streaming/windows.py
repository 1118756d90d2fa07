"""The event-time windows of operators.windows on unbounded tables: append mode, each window once, after the watermark.

The watermark is declared on the time that the window uses, in whole milliseconds. Rows later than it are
dropped and counted in the query's progress (see metrics.late_rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import END, START, check_sizes
from ..schema import to_ts

TIME = "_event_time"


def timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    """df with its time in milliseconds as a timestamp column, and the watermark on that."""
    return df.where(F.col(time).isNotNull()).withColumn(TIME, to_ts(F.col(time))).withWatermark(TIME, delay)


def hop(df: DataFrame, keys: Sequence[str], time: str, size: int, slide: int, aggregates: Mapping[str, Column], delay: str = "1 second", first: int = 0) -> DataFrame:
    """Starts are first + k * slide for any whole k: what the earliest row will be isn't known."""
    check_sizes(size, slide, keys, list(aggregates))
    window = F.window(TIME, f"{size} milliseconds", f"{slide} milliseconds", f"{first % slide} milliseconds")
    out = timed(df, time, delay).groupBy(window.alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.unix_millis("_w.start").alias(START), F.unix_millis("_w.end").alias(END), *aggregates)


def tumble(df: DataFrame, keys: Sequence[str], time: str, size: int, aggregates: Mapping[str, Column], delay: str = "1 second") -> DataFrame:
    return hop(df, keys, time, size, size, aggregates, delay)


def session(df: DataFrame, keys: Sequence[str], time: str, gap: int, aggregates: Mapping[str, Column], delay: str = "1 second") -> DataFrame:
    """[first time, last time + 1) of rows less than gap apart; gap is at least 2 milliseconds here."""
    check_sizes(gap - 1, gap - 1, keys, list(aggregates))
    window = F.session_window(TIME, f"{gap - 1} milliseconds")
    bounds = [F.min(time).alias(START), (F.max(time) + 1).alias(END)]
    out = timed(df, time, delay).groupBy(window.alias("_w"), *keys).agg(*bounds, *[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, START, END, *aggregates)


def top_n_of_windows(batch: DataFrame, n: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """For foreachBatch: the best n rows of each window. One watermark closes a window's keys together, so a batch has them all."""
    window = Window.partitionBy(START).orderBy(*order)
    return batch.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= n)
