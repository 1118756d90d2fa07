"""Stateful processors by themselves, on a state that is a dict: late rows, nulls, many rows of one key."""

import random
import time
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from millrace.plans import catalog
from millrace.sources.files import Insertable
from millrace.streaming import jobs, stateful


class Store:
    """The handle of one key."""

    def __init__(self):
        self.kept, self.timers, self.most = {}, set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept.get("rows", []))

    def put(self, rows):
        self.kept["rows"] = list(rows)


LONG = T.LongType()
ROWS = T.StructType().add("t", LONG).add("x", T.StringType())
OUT = T.StructType([*ROWS.fields]).add("n", LONG).add("s", LONG)
COUNT = stateful.Spans(lambda key, r, a, b: (b - a, stateful.sums(r.x, a, b)))


def last(n, body, batches):
    p = stateful._Last(ROWS, OUT, ["t"], n, body, ["x"], [])
    p.init(Store())
    out = []
    for b in batches:
        frames = [pd.DataFrame(b[i : i + 50], columns=["t", "x"]).astype({"x": object}) for i in range(0, len(b), 50)]
        out += [r for f in p.handleInputRows((), iter(frames), None) for r in f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)]
    return out, list(p.state.get())


def one_by_one(n, batches):
    held, out = [], []
    for b in batches:
        for row in sorted(b, key=lambda r: r[0]):
            insort(held, row, key=lambda r: r[0])
            held = held[-n:]
            there = [int(x) for _, x in held if x is not None]
            out.append((*row, len(held), sum(there) if there else None))
    return out, held


def test_windows_at_once_are_those_one_by_one():
    rnd = random.Random(4)
    big = lambda: rnd.choice([None, str((1 << 62) - rnd.randint(0, 9)), str(-(1 << 62)), str(rnd.randint(-9, 9))])
    for n in (1, 2, 7):
        batches = [[(rnd.randint(0, 400), big()) for _ in range(rnd.randint(1, 120))] for _ in range(6)]  # later batches hold earlier rows
        batches = [[r if r[1] is None or abs(int(r[1])) < 99 or n < 2 else (r[0], str(int(r[1]) // n)) for r in b] for b in batches]
        want = one_by_one(n, batches)
        assert last(n, COUNT, batches) == want
        each = lambda key, r: (len(r), None if r.x.isna().all() else sum(x for x in r.x if x is not None))
        assert last(n, each, batches) == want


def test_over_size_takes_microseconds_a_row():
    rows = [(i, str(i)) for i in range(60_000)]
    began = time.process_time()
    out, held = last(5, COUNT, [rows])
    assert time.process_time() - began < 6  # with a frame for each row it takes far longer
    assert out[-1] == (59_999, "59999", 5, 5 * 59_997) and held == rows[-5:]


class Handle:
    """The handle of one key, with map and value state, that counts the rows it hands over."""

    def __init__(self):
        self.blocks, self.value, self.timers = {}, None, set()

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def getValue(self, key):  # noqa: N802
        return self.blocks[key]

    def updateValue(self, key, value):  # noqa: N802
        self.blocks[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.blocks[key]

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Now:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 0


def frames(rows):
    return (pd.DataFrame(rows[i : i + 100], columns=["t", "x"]).astype({"x": object}) for i in range(0, len(rows), 100))


def plain(made):
    return [r for f in made for r in f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)]


def buffer(ahead, wait):
    out = OUT if ahead else ROWS
    p = stateful._Ahead(ROWS, out, "t", wait, None, body=COUNT, longs=["x"], keys=[]) if ahead else stateful._Buffer(ROWS, out, "t", wait, None)
    p.init(Handle())
    return p


def test_buffers_in_small_blocks_lose_nothing(monkeypatch):
    """Against all rows at once, with many runs, merges of runs, equal times, and windows longer than a part."""
    for name, n in (("RUN", 300), ("BLOCK", 7), ("FAN", 3), ("PART", 40)):
        monkeypatch.setattr(stateful, name, n)
    rnd = random.Random(5)
    for ahead, wait, spread in ((False, 0, 5000), (False, 0, 3), (True, 50, 5000), (True, 900, 5000), (True, 2, 3)):
        p, seen, got, mark = buffer(ahead, wait), [], [], 0
        for size in (2500, 1, 3, 0, 700, 40, 1, 0, 1500, 0):
            new = [(mark + rnd.randint(1, spread), rnd.choice([None, str(rnd.randint(-9, 9))])) for _ in range(size)]
            seen += new
            if new:
                got += plain(p.handleInputRows((), frames(new), Now(mark)))
            mark += spread // 4 + 1
            while p.handle.timers and min(p.handle.timers) <= mark:
                got += plain(p.handleExpiredTimer((), Now(mark), None))
        got += plain(p.handleExpiredTimer((), Now(1 << 40), None)) if p.handle.timers else []
        assert not p.handle.blocks and p.index.held is None and not p.handle.timers
        if ahead:
            want = []
            for t, x in seen:
                window = [int(y) for u, y in seen if t <= u < t + wait and y is not None]
                want.append((t, x, sum(t <= u < t + wait for u, _ in seen), sum(window) if window else None))
        else:
            want = seen
            assert [r[0] for r in got] == sorted(r[0] for r in got)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_a_buffer_is_never_whole_in_memory():
    """What is held in Python stays far below what the key holds."""
    p, n = buffer(False, 0), 1_000_000
    times = [(i * 7919) % n for i in range(n)]
    parts = (pd.DataFrame({"t": times[i : i + 10_000], "x": "1"}) for i in range(0, n, 10_000))
    assert not list(p.handleInputRows((), parts, Now(0)))
    sizes, last = [], -1
    for f in p.handleExpiredTimer((), Now(n), None):
        assert f.t.iloc[0] == last + 1 and f.t.is_monotonic_increasing
        last = f.t.iloc[-1]
        sizes.append(len(f))
    assert sum(sizes) == n and max(sizes) < n // 20 and not p.handle.blocks


def test_state_is_readable_and_the_watermark_itself_counts(spark, tmp_path):
    stateful.use_rocksdb(spark)
    end = 10_000_000
    source = Insertable(f"{tmp_path}/in", "k string, ts long")
    source.insert(("a", end - 1500), ("b", end - 1499), ("c", 5), ("c", 500), ("z", end))
    source = source.stream(spark, None)
    for df, left, size in ((stateful.reorder(source, "ts"), ["z"], 0), (stateful.over_duration(source, ["k"], "ts", 500, lambda key, r: (len(r),), "n long"), ["b", "z"], 500)):
        out, job = [], jobs.Job()
        job.each_batch(df, lambda b, k, out=out: out.extend(map(tuple, b.collect())), f"{tmp_path}/c{size}", bounded=True)
        assert job.join(120)
        assert sorted(r[0] for r in out) == (["a", "c", "c"] if size else ["a", "b", "c", "c"])
        assert sorted(r[2] for r in out if size) == ([1, 1, 2] if size else [])
        held = stateful.state_of(spark, f"{tmp_path}/c{size}").select("list_element.*").collect()
        assert sorted(r.k for r in held) == left and {r.ts for r in held} <= {end, end - 1499}


def test_over_duration_takes_microseconds_a_row():
    p, rows = buffer(True, 50), [(i, str(i)) for i in range(60_000)]
    began = time.process_time()
    assert not list(p.handleInputRows((), frames(rows), Now(0)))
    got = plain(p.handleExpiredTimer((), Now(60_049), None))
    assert time.process_time() - began < 6  # with a frame for each row it takes far longer
    assert len(got) == 60_000 and got[100] == (100, "100", 50, sum(range(100, 150))) and got[-1] == (59_999, "59999", 1, 59_999)


def test_the_queries_take_windows_at_once():
    """In both, what the body gives is a column for many rows."""
    assert isinstance(catalog._COUNT_AND_SUM, stateful.Spans)
    rows = pd.DataFrame({"event_id": pd.Series([(1 << 62), (1 << 62) - 1, None], dtype=object)})
    n, ids = catalog._COUNT_AND_SUM.make((), rows, np.array([0, 1, 2]), np.array([2, 3, 3]))
    assert list(n) == [2, 2, 1] and list(ids) == [(1 << 63) - 1, (1 << 62) - 1, None]
