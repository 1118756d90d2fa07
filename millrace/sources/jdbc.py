"""Tables of relational databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .dimension import Dimension


def query(spark: SparkSession, url: str, sql: str, fetch: int = 40_000, properties: Mapping[str, str] | None = None) -> DataFrame:
    """The result of a query; nulls stay null."""
    return spark.read.format("jdbc").options(**{**(properties or {}), "url": url, "query": sql, "fetchsize": str(fetch)}).load()


def table(spark: SparkSession, url: str, name: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 8, fetch: int = 40_000, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table, read by parts tasks in ranges of a numeric column where one is given (its bounds are asked for if not given)."""
    options = {**(properties or {}), "url": url, "dbtable": name, "fetchsize": str(fetch)}
    if column:
        if low is None or high is None:
            low, high = query(spark, url, f"SELECT min({column}) AS lo, max({column}) AS hi FROM {name}", properties=properties).first()
        if low is not None:
            options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def dimension(spark: SparkSession, url: str, sql: str, keys: list[str], properties: Mapping[str, str] | None = None, **how) -> Dimension:
    """A dimension loaded again from a query when its time is over."""
    return Dimension(lambda: query(spark, url, sql, properties=properties), keys, **how)
