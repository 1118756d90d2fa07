"""Operators whose body is opaque Python code. Batches and groups come as pandas frames over Arrow;
output types are declared. Where a Column expression can say the same, the relational module is faster."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import IllegalSize, check_names


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _local(column: pa.Array, zone: str) -> pa.Array:
    """Times without a zone, as they are in this zone; any other column as it is."""
    return pc.local_timestamp(column.cast(pa.timestamp("us", zone))) if pa.types.is_timestamp(column.type) and column.type.tz else column


#: Nullable pandas types of integers and booleans, which a float or an object column would not keep exact.
_EXACT = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}


def _zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def filter_with(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which keep, given a batch, is true. Integers and booleans with nulls come in pandas' nullable types, so they are exact."""
    zone = _zone(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = pd.DataFrame({n: _local(c, zone).to_pandas(types_mapper=_EXACT.get if c.null_count else None) for n, c in zip(b.schema.names, b.columns)})
            mask = keep(frame)
            yield b.filter(pa.array(mask.astype("boolean").fillna(False).to_numpy(bool)))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, body: Callable[[dict], tuple | None], schema: str | T.StructType, keep_all: bool = False) -> DataFrame:
    """body turns a row into a tuple of new values; None drops the row."""
    return flat_map_rows(df, lambda row: None if (x := body(row)) is None else [x], schema, keep_all)


def flat_map_rows(df: DataFrame, body: Callable[[dict], list[tuple] | None], schema: str | T.StructType, keep_all: bool = False) -> DataFrame:
    """body turns a row (plain Python values, None for null) into any number of tuples; None or none drop the row.

    Old columns never leave Arrow, and new values must fit the types of schema."""
    new = _struct(schema)
    names = new.fieldNames()
    check_names([*(df.columns if keep_all else ()), *names])
    out = T.StructType([*(df.schema.fields if keep_all else ()), *new.fields])
    zone = _zone(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(new).types
        for b in batches:
            at, made = [], []
            columns = [_local(c, zone).to_pylist() for c in b.columns]
            for k, row in enumerate(zip(*columns)):
                for x in body(dict(zip(b.schema.names, row))) or ():
                    if len(x) != len(names):
                        raise IllegalSize(f"{len(x)} values for {len(names)} columns")
                    at.append(k)
                    made.append(x)
            if made:
                old = b.take(pa.array(at, pa.int64())) if keep_all else None
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*(old.columns if old else ()), *arrays], names=out.fieldNames())

    return df.mapInArrow(run, out)


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable[[tuple, pd.DataFrame], list[tuple] | None], out: T.StructType) -> DataFrame:
    """body turns the key and the sorted rows of each group into output rows.

    Groups are made by one shuffle and Spark's sort, which spills; then many small groups share a batch, and a
    group that is larger than a batch is put together. Only one group, and one batch, are in Python at a time."""
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)

        def results(rows: pd.DataFrame, cuts: list[int]) -> list[tuple]:
            made = []
            for i, j in zip(cuts, cuts[1:]):
                part = rows.iloc[i:j].reset_index(drop=True)
                key = tuple(None if pd.isna(x) else x for x in part.loc[0, list(keys)])
                for x in body(key, part) or ():
                    if len(x) != len(names):
                        raise IllegalSize(f"{len(x)} values for {len(names)} columns")
                    made.append(x)
            return made

        held: list[pd.DataFrame] = []
        for batch in batches:
            new = batch.to_pandas(integer_object_nulls=True)
            if not len(new):
                continue
            rows = pd.concat([held[-1].iloc[-1:], new], ignore_index=True) if held else new
            differs = np.zeros(len(rows), bool)
            for c in keys:
                v, null = rows[c].to_numpy(), rows[c].isna().to_numpy()
                differs[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
            starts = [int(i) for i in differs.nonzero()[0]]
            if not starts:
                held.append(new)
                continue
            extra = 1 if held else 0
            first = pd.concat([*held, new.iloc[: starts[0] - extra]], ignore_index=True) if held else new.iloc[: starts[0]]
            made = results(first.reset_index(drop=True), [0, len(first)]) + results(rows, starts)
            held = [rows.iloc[starts[-1] :]]
            if made:
                yield from pa.Table.from_pandas(pd.DataFrame(made, columns=names, dtype=object), arrow, preserve_index=False).to_batches()
        if held:
            rows = pd.concat(held, ignore_index=True)
            if made := results(rows, [0, len(rows)]):
                yield from pa.Table.from_pandas(pd.DataFrame(made, columns=names, dtype=object), arrow, preserve_index=False).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in order]).mapInArrow(run, out)


def aggregate_with(df: DataFrame, keys: Sequence[str], body: Callable[[tuple, pd.DataFrame], tuple | None], schema: str | T.StructType, order: Sequence[str] = ()) -> DataFrame:
    """body turns a key and all rows of its group into one tuple; None drops the group. A group must fit in a task's memory."""
    if not keys:
        raise ValueError("at least one key is needed")
    out = T.StructType([df.schema[k] for k in keys] + _struct(schema).fields)
    check_names(out.fieldNames())

    def one(key: tuple, rows: pd.DataFrame) -> list[tuple] | None:
        made = body(key, rows)
        return None if made is None else [(*key, *made)]

    return grouped(df, keys, order, one, out)


def over_with(df: DataFrame, partition: Sequence[str], order: Sequence[str], body: Callable[[tuple, pd.DataFrame], list[tuple] | None], schema: str | T.StructType) -> DataFrame:
    """body turns a sorted partition (ascending, nulls first) into one tuple a row; None drops the partition. End the order in a tie-breaker."""
    out = T.StructType([*df.schema.fields, *_struct(schema).fields])
    check_names(out.fieldNames())

    def all_rows(key: tuple, rows: pd.DataFrame) -> list[tuple] | None:
        made = body(key, rows)
        if made is None:
            return None
        if len(made) != len(rows):
            raise IllegalSize(f"{len(made)} tuples for {len(rows)} rows")
        plain = rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)
        return [(*r, *m) for r, m in zip(plain, made)]

    return grouped(df, partition, order, all_rows, out)


def table_function(schema: str, body: Callable):
    """A user-defined table function: body(*arguments) gives tuples; for ``LATERAL`` joins and SQL once registered."""

    class Function:
        def eval(self, *args):
            yield from body(*args) or ()

    return F.udtf(Function, returnType=schema)
