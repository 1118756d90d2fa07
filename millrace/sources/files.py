"""Bounded and unbounded tables of files, and a source that rows can be put into."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


class Insertable:
    """A stream that is fed by insert(): for tests and for small producers. path must be shared by all executors."""

    def __init__(self, path: str, schema: T.StructType | str):
        self.path, self.schema = path, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        os.makedirs(path, exist_ok=True)

    def insert(self, *rows: Sequence) -> None:
        """The rows of one call are one file, and come in one batch."""
        names = self.schema.fieldNames()
        if any(len(r) != len(names) for r in rows):
            raise ValueError(f"rows need {len(names)} values")
        name = f"{self.path}/{uuid.uuid4().hex}.json"
        with open(f"{self.path}/.tmp-{os.path.basename(name)}", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
        os.rename(f.name, name)

    def stream(self, spark: SparkSession, files_per_batch: int | None = 1) -> DataFrame:
        return stream(spark, self.path, self.schema, "json", files_per_batch)
