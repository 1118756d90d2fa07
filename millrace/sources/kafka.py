"""Topics of JSON records. The record key is the event time: eight bytes, big-endian, epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def options(servers: str, topic: str, start_ms: int = 0, group: str | None = None) -> dict[str, str]:
    """Reader options: from a time on (0: from the earliest record; beyond the end: new ones only). No record is received
    before its time, so this loses none; one of the span asked for may be received after its end, so reads don't stop there."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "failOnDataLoss": "false"}
    if group:
        out["groupIdPrefix"] = group
    if start_ms:
        out |= {"startingTimestamp": str(start_ms), "startingOffsetsByTimestampStrategy": "latest"}
    else:
        out["startingOffsets"] = "earliest"
    return out


def event_time(key: Column | str = "key") -> Column:
    """The key's milliseconds; null for a key of another length."""
    return F.when(F.length(key) == 8, F.conv(F.hex(key), 16, -10).cast("long"))


def parsed(records: DataFrame, schema: str | T.StructType, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """records: key, value, timestamp. The declared fields (null where missing), __time__ and __receive_time__, for times in [start, end)."""
    rows = records.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), event_time().alias("__time__"), F.unix_millis("timestamp").alias("__receive_time__"))
    if start_ms is not None:
        rows = rows.where(F.col("__time__") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("__time__") < end_ms)
    return rows.select("v.*", "__time__", "__receive_time__")


def raw(records: DataFrame, time_of: Callable[[Column], Column] = event_time, value_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """__receive_time__, __time__ and the value: what time_of makes of the key and value_of of the value's bytes (by default text)."""
    value = F.col("value").cast("string") if value_of is None else value_of(F.col("value"))
    return records.select(F.unix_millis("timestamp").alias("__receive_time__"), time_of(F.col("key")).alias("__time__"), value.alias("value"))


def stream(spark: SparkSession, schema: str | T.StructType, end_ms: int | None = None, **where) -> DataFrame:
    """Records whose time is in [start_ms, end_ms). Needs the connector on the class path."""
    return parsed(spark.readStream.format("kafka").options(**options(**where)).load(), schema, where.get("start_ms") or None, end_ms)


def table(spark: SparkSession, schema: str | T.StructType, end_ms: int | None = None, **where) -> DataFrame:
    """As stream(), of the records that are there."""
    return parsed(spark.read.format("kafka").options(**options(**where)).load(), schema, where.get("start_ms") or None, end_ms)
