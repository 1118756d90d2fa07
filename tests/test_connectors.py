"""Sources and sinks, without external services."""

import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.sinks import kafka as to_kafka
from millrace.sinks import tables as sinks
from millrace.sources import dimension, files, jdbc, kafka, logservice


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_topic_round_trip(spark):
    data = [("c1v1", 1, (1 << 63) - 1, 1.7976931348623157e308, 5), (None, 2, -(1 << 63), -1.7976931348623157e308, 1700000000000)]
    df = spark.createDataFrame(data, "v string, i int, b bigint, d double, __time__ bigint")
    sent = to_kafka.records(df, 4, ["i"]).withColumn("timestamp", F.current_timestamp())
    assert "\"v\"" not in sent.where("value like '%:2,%'").first().value
    back = kafka.parsed(sent, "v string, i int, b bigint, d double, absent string")
    assert rows(back.select("v", "i", "b", "d", "__time__")) == rows(df) and back.where("absent is not null").count() == 0
    assert back.where("__receive_time__ < __time__").count() == 0
    assert kafka.parsed(sent, "i int", 5, 6).count() == 1 and kafka.parsed(sent, "i int", 6, 7).count() == 0
    assert rows(kafka.raw(sent).select("__time__")) == [(1700000000000,), (5,)]
    assert rows(kafka.raw(sent, lambda key: F.length(key), lambda value: F.get_json_object(value.cast("string"), "$.none")).select("__time__", "value")) == [(8, None), (8, None)]
    assert {r.partition for r in to_kafka.records(df, 4).collect()} <= set(range(4))
    o = kafka.options("h:1", "t", 7)
    assert o["startingTimestamp"] == "7" and "endingTimestamp" not in o and kafka.options("h", "t")["startingOffsets"] == "earliest"


def test_database(spark):
    url = "jdbc:derby:memory:millrace;create=true"
    df = spark.createDataFrame([(k, f"n{k}", None if k % 2 else k) for k in range(20)], "ID long, NAME string, V int")
    sinks.jdbc(df, url, "t", replace=True, index_sql='CREATE INDEX ix ON t (id)')
    sinks.jdbc(df.limit(1).withColumn("ID", F.lit(99).cast("long")), url, "t")
    got = jdbc.table(spark, url, "t", column="ID", parts=3)
    assert got.count() == 21 and got.rdd.getNumPartitions() == 3 and got.where("v is null").count() == 10
    assert jdbc.query(spark, url, "SELECT id FROM t WHERE id > 17").count() == 3
    d = jdbc.dimension(spark, url, "SELECT id, name FROM t", ["ID"], refresh_s=0.0)
    assert d.rows(3).first().NAME == "n3"
    sinks.jdbc(df.limit(1).select(F.lit(3).cast("long").alias("ID"), F.lit("again").alias("NAME"), "V"), url, "t")
    assert d.rows(3).count() == 2


def test_dimension_snapshots(spark):
    loads, told = [], []

    def load():
        loads.append(1)
        if len(loads) == 2:
            raise OSError("away")
        return spark.createDataFrame([(1, f"v{len(loads)}"), (None, "none")], "id int, name string")

    d = dimension.Dimension(load, ["id"], refresh_s=0.05, retry_s=0.05, loaded=lambda t: told.append(1))
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(d.enrich(facts, ["k"])) == sorted([(1, 1, "v1"), (2, None, None), (None, None, "none")], key=str)
    time.sleep(0.06)
    assert d.rows(1).first().name == "v1" and isinstance(d.error, OSError)
    time.sleep(0.06)
    assert d.rows(1).first().name == "v3" and d.error is None and len(told) == 2
    bad = dimension.Dimension(lambda: 1 / 0, ["id"], retry_s=0.01)
    with pytest.raises(ZeroDivisionError):
        bad.wait_until_ready(2)


def test_greatest_partition(spark, tmp_path):
    spark.createDataFrame([(1, "20240101"), (2, "20240102"), (3, "20240102")], "a int, pt string").write.partitionBy("pt").parquet(f"{tmp_path}/w")
    assert rows(dimension.greatest_partition(files.table(spark, f"{tmp_path}/w", schema="a int, pt string"), "pt").select("a")) == [(2,), (3,)]


def test_hourly_partitions_expire(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", sinks.HOUR + 1), (3, "z", 9 * sinks.HOUR)], "c1 int, c2 string, c3 long")
    sinks.hourly(df, f"{tmp_path}/h", "c3")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 3
    sinks.hourly(df.where("c1 = 3"), f"{tmp_path}/h", "c3", keep_hours=5, now_ms=10 * sinks.HOUR)
    assert [r.c1 for r in spark.read.parquet(f"{tmp_path}/h").collect()] == [3, 3]


def test_http_load(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 2 else "a") for k in range(10)], "c1 int, c2 string")

    def send(url, body, headers):
        with open(f"{tmp_path}/{headers['label']}", "wb") as f:
            f.write(body)

    assert sinks.http_load(df.repartition(2), "http://x", "job", batch=3, send=send) == 10
    got = [x for f in tmp_path.iterdir() for x in json.loads(f.read_bytes())]
    assert sorted(x["c1"] for x in got) == list(range(10)) and {x["c2"] for x in got} == {None, "a"}


def test_log_groups(spark, tmp_path):
    logservice.register(spark)
    df = spark.createDataFrame([(1000, "a", 1), (2500, None, 2), (9000, "c", 3)], "__time__ long, s string, n int")
    sinks.log_groups(df, f"{tmp_path}/l", topic="t", source="h")
    schema = "__time__ bigint, __topic__ string, s string, n int, absent double"
    got = spark.read.format("millrace_logs").schema(schema).option("path", f"{tmp_path}/l").load()
    assert rows(got) == sorted([(1000, "t", "a", 1, None), (2000, "t", None, 2, None), (9000, "t", "c", 3, None)], key=str)
    part = spark.read.format("millrace_logs").schema(schema).option("path", f"{tmp_path}/l").option("from", 2000).option("to", 9000).load()
    assert [r.n for r in part.collect()] == [2]
    out = []
    q = spark.readStream.format("millrace_logs").schema(schema).option("path", f"{tmp_path}/l").load().writeStream.foreachBatch(lambda b, k: out.extend(r.n for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(out) == [1, 2, 3]


def test_insertable_checks_rows(tmp_path):
    with pytest.raises(ValueError):
        files.Insertable(f"{tmp_path}/i", "a int, b int").insert((1,))
