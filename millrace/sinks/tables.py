"""Sinks for micro-batches and bounded tables: databases, hourly partitions with retention, HTTP loads, logs, the console."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000


def jdbc(df: DataFrame, url: str, name: str, batch: int = 1000, replace: bool = False, index_sql: str | None = None, properties: Mapping[str, str] | None = None) -> None:
    """Appends rows; makes the table if there is none (texts get the database's long text type), and then runs index_sql.
    replace: drops it first."""
    options = {**(properties or {}), "url": url, "dbtable": name, "batchsize": str(batch)}
    df.write.format("jdbc").options(**options).mode("overwrite" if replace else "append").save()
    if index_sql:
        gateway = df.sparkSession.sparkContext._jvm
        given = gateway.java.util.Properties()
        for key, value in (properties or {}).items():
            given.setProperty(key, str(value))
        connection = gateway.java.sql.DriverManager.getConnection(url, given)
        try:
            connection.createStatement().execute(index_sql)
        finally:
            connection.close()


def hourly(df: DataFrame, path: str, time_col: str, keep_hours: int | None = None, now_ms: int | None = None) -> None:
    """Appends Parquet by the hour of a time in milliseconds (folder hour=...); hours before the last keep_hours are removed."""
    df.withColumn("hour", (F.floor(F.col(time_col) / HOUR) * HOUR).cast("long")).write.mode("append").partitionBy("hour").parquet(path)
    if keep_hours is not None:
        expire(df, path, (now_ms or int(time.time() * 1000)) - keep_hours * HOUR)


def expire(df: DataFrame, path: str, before_ms: int) -> list[int]:
    """Removes the folders of hours that ended by then; gives their starts."""
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("hour=") and name[5:].isdigit() and int(name[5:]) + HOUR <= before_ms:
            fs.delete(status.getPath(), True)
            gone.append(int(name[5:]))
    return sorted(gone)


def post(url: str, body: bytes, headers: Mapping[str, str]) -> None:
    request = urllib.request.Request(url, body, dict(headers), method="PUT")
    with urllib.request.urlopen(request, timeout=60) as answer:
        if answer.status >= 300:
            raise OSError(f"load failed: {answer.status}")


def http_load(df: DataFrame, url: str, label: str, batch: int = 40_000, headers: Mapping[str, str] | None = None, send: Callable[[str, bytes, Mapping[str, str]], None] = post) -> int:
    """Loads rows as JSON arrays of at most batch rows, from the executors. A label for each load (label, partition, number)
    lets the store drop what a task that ran again sends twice. Gives the number of rows sent."""
    from pyspark import TaskContext

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        part, number, held, sent = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> None:
            nonlocal number, sent
            if held:
                send(url, ("[" + ",".join(held) + "]").encode(), {"label": f"{label}-{part}-{number}", "format": "json", "strip_outer_array": "true", **(headers or {})})
                number, sent = number + 1, sent + len(held)
                held.clear()

        for b in batches:
            for j in b["j"]:
                held.append(j)
                if len(held) >= batch:
                    flush()
        flush()
        yield pd.DataFrame({"n": [sent]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def log_groups(df: DataFrame, path: str, topic: str = "", source: str = "") -> None:
    """Rows as log groups (see sources.logservice), one log a line; nulls are left out and __time__ goes to seconds."""
    at = F.floor(F.col("__time__") / 1000) if "__time__" in df.columns else F.lit(int(time.time()))
    contents = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns if c != "__time__"])
    log = F.struct(at.cast("long").alias("time"), contents.alias("contents"))
    df.select(F.to_json(F.struct(F.lit(topic).alias("topic"), F.lit(source).alias("source"), F.array(log).alias("logs"))).alias("value")).write.mode("append").text(path)


def console(df: DataFrame, rows: int = 100) -> None:
    print(json.dumps(df.columns))
    df.show(rows, truncate=False)
