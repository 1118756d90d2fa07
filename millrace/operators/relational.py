"""Relational operators on tables. Conditions and results are Column expressions, which Catalyst sees
through; what can't be said as one goes to the callbacks module. Keys compare null-safely: null
equals null in joins and is a group of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import check_names, checked

Columns = Mapping[str, Column]


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true (null is not)."""
    return df.where(condition)


def select(df: DataFrame, new: Columns, keep_all: bool = False, unless_null: Column | None = None) -> DataFrame:
    """New columns, after all old ones with keep_all. Rows for which unless_null is null are dropped first."""
    check_names([*(df.columns if keep_all else ()), *new])
    rows = df if unless_null is None else df.where(unless_null.isNotNull())
    return rows.select(*(df.columns if keep_all else ()), *[c.alias(n) for n, c in new.items()])


def select_struct(df: DataFrame, struct: Column, keep_all: bool = False) -> DataFrame:
    """The fields of one struct expression as columns; a row whose struct is null is dropped."""
    rows = df.withColumn("_s", struct).where("_s is not null")
    fields = rows.schema["_s"].dataType.fieldNames()
    check_names([*(df.columns if keep_all else ()), *fields])
    return rows.select(*(df.columns if keep_all else ()), "_s.*")


def expand(df: DataFrame, many: Column, scalars: Columns | None = None, keep_all: bool = False, unless_null: Column | None = None) -> DataFrame:
    """One row for each struct of an array expression, the scalars repeated. A null or empty array drops the row."""
    scalars = scalars or {}
    rows = df if unless_null is None else df.where(unless_null.isNotNull())
    out = rows.select(*(df.columns if keep_all else ()), *[c.alias(n) for n, c in scalars.items()], F.inline(many))
    return checked(out)


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Columns, having: Column | str | None = None) -> DataFrame:
    """Groups by keys (all rows where there are none). having may use keys and aggregates; groups for which it isn't true go."""
    check_names([*keys, *aggregates])
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out if having is None else out.where(having)


def over(df: DataFrame, partition: Sequence[str], order: Sequence[str], new: Columns) -> DataFrame:
    """All rows with window expressions added, over partitions in ascending order, nulls first.

    The order should end in a tie-breaker. Aggregates see the rows up to the current one, peers included."""
    check_names([*df.columns, *new])
    window = Window.partitionBy(*partition).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.select("*", *[c.over(window).alias(n) for n, c in new.items()])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return checked(df.withColumnsRenamed(dict(names)))


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", left_names: Mapping[str, str] | None = None, right_names: Mapping[str, str] | None = None) -> DataFrame:
    """Joins on pairs (left column, right column), null-safely. Names that clash must be renamed. Both sides may come from one table."""
    if not keys:
        raise ValueError("a join needs at least one key; see theta_join")
    names = _names(left, right, how, left_names, right_names)
    a, b = _fresh(left, "_l"), _fresh(right, "_r")
    condition = reduce(lambda x, y: x & y, [F.col(_place(left, x, "_l")).eqNullSafe(F.col(_place(right, y, "_r"))) for x, y in keys])
    return a.join(b, condition, how).toDF(*names)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", left_names: Mapping[str, str] | None = None, right_names: Mapping[str, str] | None = None) -> DataFrame:
    """Joins on any condition; give it at least one equality where there is one, so that it needn't compare all pairs.
    The condition tells the sides apart by name: of two sides from one table, rename one first."""
    return left.join(right, condition, how).toDF(*_names(left, right, how, left_names, right_names))


def _fresh(df: DataFrame, prefix: str) -> DataFrame:
    """df under names of its own, so that a side isn't taken for the other where both come from one table."""
    return df.toDF(*[f"{prefix}{k}" for k in range(len(df.columns))])


def _place(df: DataFrame, name: str, prefix: str) -> str:
    lower = [c.lower() for c in df.columns]
    if name.lower() not in lower:
        raise ValueError(f"no column {name}; known: {', '.join(df.columns)}")
    return f"{prefix}{lower.index(name.lower())}"


def _names(left: DataFrame, right: DataFrame, how: str, left_names: Mapping[str, str] | None, right_names: Mapping[str, str] | None) -> list[str]:
    a, b = dict(left_names or {}), dict(right_names or {})
    half = how.replace("_", "").replace("left", "") in ("semi", "anti")
    names = [a.get(c, c) for c in left.columns] + ([] if half else [b.get(c, c) for c in right.columns])
    check_names(names)
    return names


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], **names) -> DataFrame:
    return join(left, right, keys, "inner", **names)


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], **names) -> DataFrame:
    return join(left, right, keys, "left", **names)


def outer_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], **names) -> DataFrame:
    return join(left, right, keys, "full", **names)


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int, keys: Sequence[tuple[str, str]] = (), how: str = "inner") -> DataFrame:
    """points whose value lies in [low, high) of a span: both go to buckets of this width, so that it is an equi-join.

    A span is repeated for each bucket that it touches; width near the usual span length is right."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    p = _fresh(points, "_l").withColumn("_bucket", F.floor(F.col(_place(points, point, "_l")) / width))
    at, start, end = F.col(_place(points, point, "_l")), F.col(_place(spans, low, "_r")), F.col(_place(spans, high, "_r"))
    s = _fresh(spans, "_r").where(end > start).withColumn("_b", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))
    on = [F.col("_bucket") == F.col("_b"), at >= start, at < end, *[F.col(_place(points, a, "_l")).eqNullSafe(F.col(_place(spans, b, "_r"))) for a, b in keys]]
    return checked(p.join(s, reduce(lambda a, b: a & b, on), how).drop("_bucket", "_b").toDF(*points.columns, *spans.columns))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its keys that isn't later than it (null without one).
    A right row without a time is never met, and a left one meets none.

    One shuffle and one sort: both sides go into one table, and the last right row seen is carried on."""
    check_names([*left.columns, *columns])
    row = F.struct(*[F.col(c) for c in columns])
    null = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), null.alias("_r"), F.struct(*left.columns).alias("_l"))
    b = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), row.alias("_r"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.col("_t").asc_nulls_first(), "_side")
    last = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("_hit", last).where("_side = 1").select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def project(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def project_negative(df: DataFrame, *names: str) -> DataFrame:
    """All columns but these; names that aren't there are ignored."""
    return df.drop(*names)


def add_columns(df: DataFrame, new: Columns) -> DataFrame:
    check_names([*df.columns, *new])
    return df.withColumns(dict(new))


def union_all(tables: Sequence[DataFrame]) -> DataFrame | None:
    """Rows of all tables, columns by position under the first table's names; None without a table."""
    return reduce(DataFrame.unionAll, tables) if tables else None


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return union_all([df, rows])


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def sort(df: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def rows_to_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame | None:
    """A table of these rows; None without a row."""
    return spark.createDataFrame(list(rows), schema) if rows else None


def indexed(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """df laid out by key once for several groupings and joins on it: they reuse the layout."""
    if not keys:
        raise ValueError("an index needs at least one column")
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def rebalanced(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows spread evenly, whatever their keys."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def show(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, truncate=False)
