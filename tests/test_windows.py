"""Event-time windows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import library as fn
from millrace.operators import windows as win

def counts():
    return {"n": fn.count_rows()}

SESSION = [("A", 3), ("A", 10), ("A", 10), ("A", 13), ("A", 23), ("B", 103)]
SLIDE = [("A", 3), ("A", 10), ("A", 10), ("A", 13), ("A", 23), ("A", 24), ("B", 103), ("B", 2), ("B", 301), ("B", 302), ("B", 303)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, data):
    return spark.createDataFrame(data, "k string, ts long")


def slow_hop(data, size, slide, first=None):
    w0 = min(t for _, t in data) // size * size if first is None else first
    out = {}
    for k, t in data:
        for j in range((max(t for _, t in data) - w0) // slide + 1):
            if w0 + j * slide <= t < w0 + j * slide + size:
                out[k, w0 + j * slide] = out.get((k, w0 + j * slide), 0) + 1
    return sorted((k, s, s + size, n) for (k, s), n in out.items())


def slow_session(data, gap):
    out = []
    for k in sorted({k for k, _ in data}):
        times = sorted(t for x, t in data if x == k)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] >= gap:
                out.append((k, run[0], run[-1] + 1, len(run)))
                run = []
            run.append(t)
        out.append((k, run[0], run[-1] + 1, len(run)))
    return sorted(out)


def test_session_fixture(spark):
    assert rows(win.session(table(spark, SESSION), ["k"], "ts", 10, counts())) == [("A", 3, 14, 4), ("A", 23, 24, 1), ("B", 103, 104, 1)]


def test_slide_fixture(spark):
    got = rows(win.hop(table(spark, SLIDE), ["k"], "ts", 10, 5, counts(), first=0))
    assert got == slow_hop(SLIDE, 10, 5, 0)
    assert {("A", 5, 15, 3), ("A", 15, 25, 2), ("B", 0, 10, 1), ("B", 300, 310, 3)} <= set(got)


@pytest.mark.parametrize("seed", range(3))
def test_against_model(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice("abc"), rnd.randint(1000, 1300)) for _ in range(120)]
    df = table(spark, data + [("a", None)])
    for size, slide in [(10, 10), (50, 20), (30, 7), (7, 7)]:
        assert rows(win.hop(df, ["k"], "ts", size, slide, counts())) == slow_hop(data, size, slide)
    assert rows(win.tumble(df, ["k"], "ts", 30, counts())) == slow_hop(data, 30, 30)
    for gap in (1, 2, 5, 40):
        assert rows(win.session(df, ["k"], "ts", gap, counts())) == slow_session(data, gap)
    ahead = sorted((k, t, sum(t <= u < t + 20 for x, u in data if x == k)) for k, t in data)
    assert rows(win.over_duration(df, ["k"], "ts", 20, counts())) == ahead
    body = lambda key, r, start, end: [(len(r), int(r.ts.min()) - start)] if len(r) > 1 else None
    made = rows(win.window_transform(df.where("ts is not null"), ["k"], "ts", 50, 20, body, "n long, first long"))
    assert [x[:4] for x in made] == [x for x in slow_hop(data, 50, 20) if x[3] > 1]


def test_over_size(spark):
    df = table(spark, [("a", t) for t in (1, 2, 3, 4, 5)] + [("b", 9)])
    got = win.over_size(df, ["k"], ["ts"], 3, {"s": F.sum("ts")})
    assert rows(got) == [("a", 1, 1), ("a", 2, 3), ("a", 3, 6), ("a", 4, 9), ("a", 5, 12), ("b", 9, 9)]


def test_sizes_are_checked(spark):
    df = table(spark, SESSION)
    for size, slide in [(0, 1), (10, 0), (5, 10)]:
        with pytest.raises(ValueError):
            win.hop(df, ["k"], "ts", size, slide, counts())
    with pytest.raises(ValueError):
        win.tumble(df, ["k"], "ts", 10, {})
    assert win.hop(df.limit(0), ["k"], "ts", 10, 5, counts()).count() == win.session(df.limit(0), ["k"], "ts", 10, counts()).count() == 0
