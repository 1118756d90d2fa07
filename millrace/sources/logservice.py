"""Log groups as a data source: JSON lines of {topic, source, machine, category, logs: [{time, contents}]}.

Each log is a row: the declared columns from its contents (null where missing), and __time__ (milliseconds),
__topic__, __source__, __category__, __machine_uuid__ where they are declared. Registered as format
'millrace_logs', with options path, from and to (milliseconds, [from, to)); one file is one task."""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

META = {"__topic__": "topic", "__source__": "source", "__category__": "category", "__machine_uuid__": "machine"}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _rows(path: str, schema: T.StructType, low: int, high: int | None) -> Iterator[tuple]:
    casts = [(f.name, {"bigint": int, "int": int, "double": float}.get(f.dataType.simpleString(), str)) for f in schema]
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.strip():
                continue
            group = json.loads(line)
            for log in group.get("logs", ()):
                ms = int(log["time"]) * 1000
                if ms < low or high is not None and ms >= high:
                    continue
                values = {"__time__": ms, **{k: group.get(v) for k, v in META.items()}, **log.get("contents", {})}
                yield tuple(None if (v := values.get(name)) is None else cast(v) for name, cast in casts)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_logs"

    def schema(self) -> str:
        return "__time__ bigint, __topic__ string, __source__ string, __category__ string, __machine_uuid__ string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(schema, self.options)


class _Span:
    def __init__(self, schema: T.StructType, options: dict):
        self.rows_of, self.path = schema, options["path"]
        self.low, self.high = int(options.get("from", 0)), int(options["to"]) if options.get("to") else None

    def files(self) -> list[str]:
        return sorted(f for f in glob.glob(f"{self.path}/*") if not f.rsplit("/", 1)[1].startswith(("_", ".")))

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(partition.path, self.rows_of, self.low, self.high)


class _Reader(_Span, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files()]


class _Stream(_Span, DataSourceStreamReader):
    """Offsets count files in order of name: new ones must sort after those already there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(self.files())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(f) for f in self.files()[start["files"] : end["files"]]]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
