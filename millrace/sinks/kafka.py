"""Rows to topic records: JSON values without nulls, the event time as key, a partition by hash."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(df: DataFrame, partitions: int | None = None, hash_by: Sequence[str] = (), time_col: str = "__time__") -> DataFrame:
    """key, value, and with partitions also partition (random without hash_by)."""
    ms = F.col(time_col) if time_col in df.columns else F.lit(int(time.time() * 1000))
    key = F.unhex(F.lpad(F.hex(ms.cast("long")), 16, "0"))
    out = [key.alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != time_col])).alias("value")]
    if partitions:
        where = F.pmod(F.xxhash64(*hash_by), F.lit(partitions)) if hash_by else F.floor(F.rand() * partitions)
        out.append(where.cast("int").alias("partition"))
    return df.select(*out)


def write(df: DataFrame, servers: str, topic: str, **how) -> None:
    """Needs the connector on the class path."""
    records(df, **how).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_stream(df: DataFrame, servers: str, topic: str, checkpoint: str, **how):
    return records(df, **how).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
