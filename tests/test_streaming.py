"""Streams give what bounded tables do, for all that the watermark has closed."""

import random

from pyspark.sql import functions as F

from millrace.functions import library as fn
from millrace.operators import windows as batch
from millrace.sources.files import Insertable
from millrace.streaming import jobs, stateful
from millrace.streaming import windows as stream

def counts():
    return {"n": fn.count_rows()}

END = 10_000_000


def run(df, tmp_path, name):
    """All rows that the query gives out on what there is."""
    out, job = [], jobs.Job()
    job.each_batch(df, lambda b, k: out.extend(map(tuple, b.collect())), f"{tmp_path}/check-{name}", bounded=True)
    assert job.join(120)
    return out, job.queries[0]


def feed(spark, tmp_path, seed=1, n=120):
    rnd = random.Random(seed)
    data = sorted(((rnd.choice("ab"), rnd.randint(1000, 9000)) for _ in range(n)), key=lambda x: x[1] + rnd.randint(0, 300))
    source = Insertable(f"{tmp_path}/in", "k string, ts long")
    for a in range(0, n, 40):
        source.insert(*data[a : a + 40])
    source.insert(("z", END))
    return data, source.stream(spark, None)


def test_windows(spark, tmp_path):
    data, df = feed(spark, tmp_path)
    table = spark.createDataFrame(data, "k string, ts long")
    closed = lambda rows: sorted(r for r in rows if r[0] != "z")
    got, _ = run(stream.hop(df, ["k"], "ts", 1000, 500, counts()), tmp_path, "hop")
    assert closed(got) == sorted(map(tuple, batch.hop(table, ["k"], "ts", 1000, 500, counts(), first=0).collect()))
    got, _ = run(stream.session(df, ["k"], "ts", 200, counts()), tmp_path, "session")
    assert closed(got) == sorted(map(tuple, batch.session(table, ["k"], "ts", 200, counts()).collect()))


def test_top_n_of_each_window(spark, tmp_path):
    data, df = feed(spark, tmp_path, 2)
    out, job = [], jobs.Job()
    body = lambda b, k: out.extend(map(tuple, stream.top_n_of_windows(b, 1, [F.desc("n"), F.asc("k")]).collect()))
    job.each_batch(stream.tumble(df, ["k"], "ts", 1000, counts()), body, f"{tmp_path}/c", bounded=True)
    assert job.join(120)
    held = {}
    for k, t in data:
        held.setdefault(t // 1000 * 1000, {}).setdefault(k, []).append(t)
    want = {w: max(sorted(c), key=lambda k: len(c[k])) for w, c in held.items()}
    assert {r[1]: r[0] for r in out if r[1] < END // 2} == want


def test_stateful(spark, tmp_path):
    stateful.use_rocksdb(spark)
    data, df = feed(spark, tmp_path, 3, 60)
    got, _ = run(stateful.reorder(df, "ts", shards=1), tmp_path, "reorder")
    times = [t for _, t in got]
    assert times == sorted(times) and sorted(got) == sorted(x for x in data)
    got, _ = run(stateful.over_duration(df, ["k"], "ts", 500, lambda key, r: (len(r),), "n long"), tmp_path, "ahead")
    assert sorted(got) == sorted((k, t, sum(t <= u < t + 500 for x, u in data if x == k)) for k, t in data)
    got, _ = run(stateful.over_size(df, ["k"], ["ts"], 3, lambda key, r: (int(r.ts.sum()),), "s long"), tmp_path, "last")
    want = []
    for k in "ab":
        own = sorted(t for x, t in data if x == k)
        want += [(k, t, sum(own[max(0, i - 2) : i + 1])) for i, t in enumerate(own)]
    assert sorted(r for r in got if r[0] != "z") == sorted(want)
    assert stateful.state_of(spark, f"{tmp_path}/check-last").count() > 0


def test_idle_keys_are_flushed(spark, tmp_path):
    stateful.use_rocksdb(spark)
    source = Insertable(f"{tmp_path}/in", "k string, ts long")
    source.insert(("a", 1000), ("a", 900), ("b", 5))
    out, job = [], jobs.Job()
    df = stateful.reorder(source.stream(spark), "ts", shards=1, idle_ms=500, delay_ms=1000)
    job.each_batch(df, lambda b, k: out.extend(map(tuple, b.collect())), f"{tmp_path}/c", every="300 milliseconds")
    job.join(25)
    job.stop()
    assert sorted(out, key=lambda r: r[1]) == [("b", 5), ("a", 900), ("a", 1000)]


def test_late_rows_are_counted(spark, tmp_path):
    metrics = jobs.Metrics().attach(spark)
    source = Insertable(f"{tmp_path}/in", "k string, ts long")
    out, job = [], jobs.Job()
    query = job.each_batch(stream.tumble(source.stream(spark), ["k"], "ts", 1000, counts()), lambda b, k: out.extend(map(tuple, b.collect())), f"{tmp_path}/c")
    for row in [("a", 5000), ("a", 90_000), ("a", 4000), ("a", 200_000)]:
        source.insert(row)
        query.processAllAvailable()
    late = jobs.late_rows(query)
    job.stop()
    assert late == 1 and sorted(out) == [("a", 5000, 6000, 1), ("a", 90_000, 91_000, 1)]
    assert any(b["rows"] for b in metrics.batches)
    spark.streams.removeListener(metrics)


def test_a_failure_stops_the_job(spark, tmp_path):
    source = Insertable(f"{tmp_path}/in", "k string, ts long")
    source.insert(("a", 1))
    job = jobs.Job()

    def fail(b, k):
        raise RuntimeError("as asked")

    other = job.each_batch(source.stream(spark), lambda b, k: None, f"{tmp_path}/c1")
    job.each_batch(source.stream(spark), fail, f"{tmp_path}/c2")
    try:
        job.join(60)
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "as asked" in str(e)
    assert not other.isActive
