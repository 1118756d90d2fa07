"""Stateful operators that Spark has no built-in for: reordering, and windows over the next milliseconds or last rows.

They run on transformWithStateInPandas; the session needs the RocksDB state store (see use_rocksdb). A key's
buffer is state: it is checkpointed, and lives outside Python between batches."""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..schema import IllegalSize, check_names
from .windows import TIME, timed


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _carried(df: DataFrame, as_numbers: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with its long columns as text, and which: on the way through pandas a long beside a null would become a float.
    Those that are never null (times, orders) stay numbers."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType) and f.name not in as_numbers]
    return df.withColumns({c: F.col(c).cast("string") for c in longs}), longs


def _whole(x: str | None) -> int | None:
    return None if x is None else int(x)


#: Rows by column: integers that are never null as int64, all else as objects with None for null.
Chunk = dict[str, np.ndarray]
#: Rows that are given out, or handed to a body, at once.
PART = 10_000
#: Rows of a buffer that are sorted at once, rows of a block of its state, and runs that are merged into one.
RUN, BLOCK, FAN = 100_000, 2_000, 64


def _chunk(columns: Iterable, rows: T.StructType) -> Chunk:
    """The columns of rows, in its order."""
    made = {}
    for f, column in zip(rows, columns):
        if not (isinstance(column, np.ndarray) and column.dtype == np.int64):
            held = np.empty(len(column), object)
            held[:] = column
            null = pd.isna(held)
            if isinstance(f.dataType, T.IntegralType):  # pandas has floats beside a null
                held[~null] = [int(x) for x in held[~null]]
            held[null] = None
            column = held
        made[f.name] = column
    return made


def _chunk_of(frame: pd.DataFrame, rows: T.StructType) -> Chunk:
    return _chunk([frame[f.name].to_numpy(None if frame[f.name].dtype == np.int64 else object) for f in rows], rows)


def _joined(chunks: Sequence[Chunk]) -> Chunk:
    return chunks[0] if len(chunks) == 1 else {c: np.concatenate([x[c] for x in chunks]) for c in chunks[0]}


def _size(chunk: Chunk) -> int:
    return len(next(iter(chunk.values())))


def _at(chunk: Chunk, places: slice | np.ndarray) -> Chunk:
    return {c: a[places] for c, a in chunk.items()}


def _tuples(chunk: Chunk) -> list[tuple]:
    return list(zip(*[a.tolist() for a in chunk.values()]))


class Spans:
    """A body for many windows at once: make(key, rows, begins, ends), where window i is rows[begins[i]:ends[i]], gives a
    column of values, one a window, for each new column."""

    def __init__(self, make: Callable[[tuple, pd.DataFrame, np.ndarray, np.ndarray], Sequence]):
        self.make = make


def sums(values: pd.Series, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For Spans: exact sums of a window's integers, None where it has none."""
    there = values.notna().to_numpy()
    upto = np.concatenate([np.zeros(1, object), np.cumsum(np.where(there, values.to_numpy(object), 0).astype(object))])
    some = np.concatenate([[0], np.cumsum(there)])
    return np.where(some[ends] > some[begins], upto[ends] - upto[begins], None)


def _applied(body: Callable | Spans, key: tuple, chunk: Chunk, begins: np.ndarray, ends: np.ndarray, longs: Sequence[str], new: Sequence[T.StructField]) -> dict:
    """The new columns: what body makes of each window."""
    columns = {c: np.array([_whole(x) for x in a] or [], object) if c in longs else a.tolist() if a.dtype == object else a for c, a in chunk.items()}
    rows = pd.DataFrame(columns)
    if isinstance(body, Spans):
        made = list(body.make(key, rows, begins, ends))
        if len(made) != len(new) or any(len(x) != len(begins) for x in made):
            raise IllegalSize(f"{len(made)} columns of {[len(x) for x in made]} values for {len(new)} of {len(begins)}")
        return dict(zip((f.name for f in new), made))
    each = [body(key, rows.iloc[i:j].reset_index(drop=True)) for i, j in zip(begins.tolist(), ends.tolist())]
    for x in each:
        if len(x) != len(new):
            raise IllegalSize(f"{len(x)} values for {len(new)} columns")
    return {f.name: [x[k] for x in each] for k, f in enumerate(new)}


def _framed(columns: dict, out: T.StructType) -> pd.DataFrame:
    def one(f: T.StructField):
        x = columns[f.name]
        if isinstance(f.dataType, T.IntegralType):
            return x if isinstance(x, np.ndarray) and x.dtype == np.int64 else pd.array(x, "Int64")
        return pd.Series(x, dtype=object)

    return pd.DataFrame({f.name: one(f) for f in out})


def _in_blocks(parts: Iterable[Chunk]) -> Iterator[Chunk]:
    """The same rows, BLOCK at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += _size(part)
        if n >= BLOCK:
            rows = _joined(held)
            whole = n - n % BLOCK
            yield from (_at(rows, slice(i, i + BLOCK)) for i in range(0, whole, BLOCK))
            held, n = [_at(rows, slice(whole, n))], n - whole
    if n:
        yield _joined(held)


class _Buffer(StatefulProcessor):
    """Holds rows of a key until their time comes.

    In state they are runs, each in order of time and in blocks, so that neither what comes in nor what goes out is ever
    in memory at once: a batch's rows are sorted RUN at a time, and runs are merged with one block of each in memory.
    Small runs are joined as they come, and FAN large ones are merged into one."""

    def __init__(self, rows: T.StructType, out: T.StructType, time: str, wait: int, idle: int | None):
        self.rows, self.out, self.time, self.wait, self.idle = rows, out, time, wait, idle

    def init(self, handle) -> None:
        self.handle = handle
        place = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType())])
        self.state = handle.getMapState("rows", place, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.rows]))
        self.index = handle.getValueState("runs", T.StructType([T.StructField("json", T.StringType())]))

    def close(self) -> None:
        pass

    def _sorted(self, chunks: Sequence[Chunk]) -> Chunk:
        rows = _joined(chunks)
        return _at(rows, np.argsort(rows[self.time], kind="stable"))

    def _timed(self, chunk: Chunk) -> Chunk:
        return chunk | {self.time: chunk[self.time].astype(np.int64)}

    def _block(self, run: dict, k: int) -> Chunk:
        return self._timed(_chunk(self.state.getValue((run["id"], run["first"] + k)), self.rows))

    def _put(self, run: dict, k: int, rows: Chunk) -> None:
        self.state.updateValue((run["id"], run["first"] + k), tuple(a.tolist() for a in rows.values()))

    def _written(self, index: dict, parts: Iterable[Chunk], level: int) -> dict:
        """A new run, of parts in order of time."""
        run = {"id": index["next"], "level": level, "first": 0, "low": None, "lasts": [], "counts": []}
        index["next"] += 1
        for block in _in_blocks(parts):
            self._put(run, len(run["lasts"]), block)
            if run["low"] is None:
                run["low"] = int(block[self.time][0])
            run["lasts"].append(int(block[self.time][-1]))
            run["counts"].append(_size(block))
        return run

    def _removed(self, run: dict) -> None:
        for k in range(len(run["lasts"])):
            self.state.removeKey((run["id"], run["first"] + k))

    def _add(self, index: dict, new: Chunk) -> None:
        runs = index["runs"]
        while runs and sum(runs[-1]["counts"]) <= min(_size(new), RUN - _size(new)):
            run = runs.pop()
            new = self._sorted([*[self._block(run, k) for k in range(len(run["lasts"]))], new])
            self._removed(run)
        runs.append(self._written(index, [new], 0))
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= FAN:
            merged = self._written(index, (part for part, _ in self._merged(same, None)), level + 1)
            for run in same:
                self._removed(run)
            index["runs"] = runs = [*[r for r in runs if r["level"] > level], merged]
            level += 1

    def _merged(self, runs: Sequence[dict], upto: int | None) -> Iterator[tuple[Chunk, int | None]]:
        """Rows of runs up to this time (None: all) in its order. With each part the time before which all have come."""
        left = [(run, [0], []) for run in runs if upto is None or run["low"] <= upto]
        while left:
            for run, k, held in left:
                if not held and k[0] < len(run["lasts"]):
                    held.append(self._block(run, k[0]))
                    k[0] += 1
            left = [x for x in left if x[2]]
            cut = min((int(held[0][self.time][-1]) for run, k, held in left if k[0] < len(run["lasts"])), default=None)
            until = min((x for x in (cut, upto) if x is not None), default=None)
            parts = []
            for _, _, held in left:
                size = _size(held[0])
                n = size if until is None else int(np.searchsorted(held[0][self.time], until, "right"))
                if n:
                    parts.append(_at(held[0], slice(0, n)))
                    held[:] = [_at(held[0], slice(n, size))] if n < size else []
            if not parts:  # what is left is later
                return
            yield self._sorted(parts) if len(parts) > 1 else parts[0], until

    def _gone(self, index: dict, upto: int | None) -> None:
        """Rows up to this time leave the state."""
        kept = []
        for run in index["runs"]:
            gone = len(run["lasts"]) if upto is None else bisect_right(run["lasts"], upto)
            for k in range(gone):
                self.state.removeKey((run["id"], run["first"] + k))
            run |= {"first": run["first"] + gone, "lasts": run["lasts"][gone:], "counts": run["counts"][gone:]}
            if run["lasts"] and (gone or run["low"] <= upto):
                block = self._block(run, 0)
                n = int(np.searchsorted(block[self.time], upto, "right"))
                if n:
                    block = _at(block, slice(n, _size(block)))
                    self._put(run, 0, block)
                    run["counts"][0] = _size(block)
                run["low"] = int(block[self.time][0])
            if run["lasts"]:
                kept.append(run)
        index["runs"] = kept

    def given(self, key: tuple, runs: Sequence[dict], until: int | None) -> Iterator[pd.DataFrame]:
        """What comes out for the rows whose wait is over at this time, None for all."""
        for part, _ in self._merged(runs, None if until is None else until - self.wait):
            yield _framed(part, self.out)

    def _step(self, key: tuple, index: dict, until: int | None, now: int) -> Iterator[pd.DataFrame]:
        due = None if until is None else until - self.wait
        if index["runs"] and (due is None or min(r["low"] for r in index["runs"]) <= due):
            yield from self.given(key, index["runs"], until)
            self._gone(index, due)
        low = min((r["low"] for r in index["runs"]), default=None)
        timer = None if low is None else now + self.idle if self.idle is not None else low + self.wait
        if timer != index["timer"]:
            if index["timer"] is not None:
                self.handle.deleteTimer(index["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            index["timer"] = timer
        if index["runs"]:
            self.index.update((json.dumps(index),))
        else:
            self.index.clear()

    def _indexed(self) -> dict:
        held = self.index.get()
        return json.loads(held[0]) if held else {"next": 0, "timer": None, "runs": []}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        index, held, n = self._indexed(), [], 0
        for part in rows:
            held.append(self._timed(_chunk_of(part, self.rows)))
            n += len(part)
            if n >= RUN:
                self._add(index, self._sorted(held))
                held, n = [], 0
        if held:
            self._add(index, self._sorted(held))
        if self.idle is not None:  # the key's own latest time moves it on; when nothing comes, the timer does
            yield from self._step(key, index, max(r["lasts"][-1] for r in index["runs"]), timerValues.getCurrentProcessingTimeInMs())
        else:
            mark = timerValues.getCurrentWatermarkInMs()
            yield from self._step(key, index, mark if mark > 0 else -(1 << 62), 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = None if self.idle is not None else timerValues.getCurrentWatermarkInMs()
        yield from self._step(key, self._indexed(), until, timerValues.getCurrentProcessingTimeInMs())


class _Ahead(_Buffer):
    """A row is given out, with what body makes of it and what follows, when all that may follow it is there."""

    def __init__(self, *args, body: Callable | Spans, longs: list[str], keys: Sequence[str]):
        super().__init__(*args)
        self.body, self.longs, self.key_longs = body, longs, [k in longs for k in keys]

    def given(self, key: tuple, runs: Sequence[dict], until: int | None) -> Iterator[pd.DataFrame]:
        key = tuple(_whole(x) if own else x for x, own in zip(key, self.key_longs))
        held, old, new = [], 0, 0  # rows whose window isn't all there, and those that came since
        for part, come in chain(self._merged(runs, until), [(None, until)]):
            if part is not None:
                held.append(part)
                new += _size(part)
                if new < max(old, PART):
                    continue
            if held:
                rows = _joined(held)
                times = rows[self.time]
                n = len(times) if part is None and come is None else 0 if come is None else int(np.searchsorted(times, come - self.wait, "right"))
                for i in range(0, n, PART):
                    own = slice(i, min(n, i + PART))
                    begins, ends = np.searchsorted(times, times[own]), np.searchsorted(times, times[own] + self.wait)
                    low, high = int(begins[0]), int(ends[-1])
                    made = _applied(self.body, key, _at(rows, slice(low, high)), begins - low, ends - low, self.longs, self.out.fields[len(self.rows) :])
                    yield _framed(_at(rows, own) | made, self.out)
                held, old, new = [_at(rows, slice(n, len(times)))], len(times) - n, 0


def _run(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: T.StructType, mode: str, longs: Sequence[str]) -> DataFrame:
    made = df.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", mode)
    return made.withColumns({c: F.col(c).cast("long") for c in longs})


def _mode(idle: int | None) -> str:
    return "EventTime" if idle is None else "ProcessingTime"


def reorder(df: DataFrame, time: str, delay: str = "1 second", shards: int = 8, idle_ms: int | None = None, delay_ms: int = 1000) -> DataFrame:
    """Rows again, held back until the watermark (delay) has passed their time, so that each shard's come in order of time.

    With idle_ms a shard's own latest time less delay_ms counts instead, and all it holds comes out after idle_ms without rows."""
    df, longs = _carried(df.where(F.col(time).isNotNull()), [time])
    rows = df.schema
    source = (timed(df, time, delay) if idle_ms is None else df).withColumn("_shard", F.pmod(F.xxhash64(*df.columns), F.lit(shards)))
    return _run(source, ["_shard"], _Buffer(rows, rows, time, 0 if idle_ms is None else delay_ms, idle_ms), rows, _mode(idle_ms), longs)


def over_duration(df: DataFrame, keys: Sequence[str], time: str, size: int, body: Callable[[tuple, pd.DataFrame], tuple] | Spans, schema: str, delay: str = "1 second", idle_ms: int | None = None) -> DataFrame:
    """Each row with body(key, rows) over its key's rows from its time up to, but without, size later; once these are all there."""
    new = T.StructType.fromDDL(schema)
    check_names([*df.columns, *new.fieldNames()])
    df, longs = _carried(df.where(F.col(time).isNotNull()), [time])
    out = T.StructType([*df.schema.fields, *new.fields])
    source = timed(df, time, delay) if idle_ms is None else df
    return _run(source, keys, _Ahead(df.schema, out, time, size, idle_ms, body=body, longs=longs, keys=keys), out, _mode(idle_ms), longs)


class _Last(StatefulProcessor):
    """Keeps the last n rows of a key in order; each new row is given out at once."""

    def __init__(self, rows: T.StructType, out: T.StructType, order: list[str], n: int, body: Callable | Spans, longs: list[str], keys: Sequence[str]):
        self.rows, self.out, self.order, self.n, self.body = rows, out, order, n, body
        self.longs, self.key_longs = longs, [k in longs for k in keys]

    def init(self, handle) -> None:
        self.state = handle.getListState("rows", self.rows)

    def close(self) -> None:
        pass

    def _sorted(self, rows: Chunk) -> Chunk:
        by = [rows[c] for c in self.order]
        if all(a.dtype == np.int64 for a in by):
            return _at(rows, np.lexsort(by[::-1]))
        by = list(zip(*[a.tolist() for a in by]))
        return _at(rows, np.array(sorted(range(len(by)), key=by.__getitem__)))

    def _given(self, key: tuple, new: Chunk, rows: Chunk, begins: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        return _framed(new | _applied(self.body, key, rows, begins, ends, self.longs, self.out.fields[len(self.rows) :]), self.out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        key = tuple(_whole(x) if own else x for x, own in zip(key, self.key_longs))
        place = [self.rows.fieldNames().index(c) for c in self.order]
        by = lambda r: tuple(r[p] for p in place)
        held = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        new = self._sorted(_joined([_chunk_of(part, self.rows) for part in rows]))
        size, done = _size(new), 0
        late = lambda: held and done < size and by([a[done] for a in new.values()]) < by(held[-1])
        while late():  # rows that come before one that is held: windows aren't runs of rows, so each is copied
            first, windows, ends = done, [], []
            while late() and done - first < max(1, PART // self.n):
                insort(held, tuple(a[done] if a.dtype == object else int(a[done]) for a in new.values()), key=by)
                held = held[-self.n :]
                windows += held
                ends.append(len(windows))
                done += 1
            yield self._given(key, _at(new, slice(first, done)), self._of(windows), np.array([0, *ends[:-1]]), np.array(ends))
        new = _at(new, slice(done, size))
        both = _joined([self._of(held), new]) if held else new
        size, before = _size(both), len(held)
        for i in range(before, size, PART):
            ends = np.arange(i, min(size, i + PART)) + 1
            begins = np.maximum(ends - self.n, 0)
            low, high = int(begins[0]), int(ends[-1])
            yield self._given(key, _at(both, slice(i, high)), _at(both, slice(low, high)), begins - low, ends - low)
        self.state.put(_tuples(_at(both, slice(max(0, size - self.n), size))))

    def _of(self, rows: list[tuple]) -> Chunk:
        chunk = _chunk(zip(*rows), self.rows)
        return chunk | {c: chunk[c].astype(np.int64) for c in self.order if isinstance(self.rows[c].dataType, T.IntegralType)}


def over_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, body: Callable[[tuple, pd.DataFrame], tuple] | Spans, schema: str) -> DataFrame:
    """Each row with body(key, rows) over the last n rows of its key in this order, itself included. Order columns are never null.

    body is called for each row; as Spans, for up to 10,000 rows of a key at once."""
    if n <= 0:
        raise ValueError("n must be positive")
    new = T.StructType.fromDDL(schema)
    check_names([*df.columns, *new.fieldNames()])
    df, longs = _carried(df, order)
    out = T.StructType([*df.schema.fields, *new.fields])
    return _run(df, keys, _Last(df.schema, out, list(order), n, body, longs, keys), out, "None", longs)


def state_of(spark: SparkSession, checkpoint: str, variable: str = "rows") -> DataFrame:
    """The rows that a stopped query's state holds, by key."""
    held = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    if "user_map_value" not in held.columns:
        return held
    columns = [F.col(f"user_map_value.{c}") for c in held.schema["user_map_value"].dataType.fieldNames()]
    return held.select("key", F.explode(F.arrays_zip(*columns)).alias("list_element"), "partition_id")


__all__ = ["Spans", "TIME", "over_duration", "over_size", "reorder", "state_of", "sums", "use_rocksdb"]
