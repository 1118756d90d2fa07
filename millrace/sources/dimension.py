"""Dimension tables that are loaded again after a time, each use of which sees one snapshot."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as rel


class Dimension:
    """load gives the table. A snapshot older than refresh_s is replaced when it is next asked for; if that fails it is
    tried again retry_s later, and the last good snapshot serves meanwhile."""

    def __init__(self, load: Callable[[], DataFrame], keys: Sequence[str], refresh_s: float = 600, retry_s: float = 10, loaded: Callable[[DataFrame], None] | None = None, cache: bool = False):
        if not keys:
            raise ValueError("a dimension needs a key")
        self.load, self.keys, self.refresh_s, self.retry_s, self.loaded, self.cache = load, list(keys), refresh_s, retry_s, loaded, cache
        self._lock, self._now, self._due, self.error = threading.Lock(), None, 0.0, None

    def snapshot(self) -> DataFrame:
        """Take one for each micro-batch."""
        with self._lock:
            if time.monotonic() >= self._due:
                try:
                    new = self.load()
                    if self.cache:
                        new = new.cache()
                        new.count()
                    old, self._now, self.error = self._now, new, None
                    self._due = time.monotonic() + self.refresh_s
                    if old is not None and self.cache:
                        old.unpersist()
                    if self.loaded:
                        self.loaded(new)
                except Exception as e:
                    self.error, self._due = e, time.monotonic() + self.retry_s
                    if self._now is None:
                        self._due = 0.0
                        raise
            return self._now

    def wait_until_ready(self, attempts: int = 10) -> DataFrame:
        for k in range(attempts):
            try:
                return self.snapshot()
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(self.retry_s)

    def rows(self, *key) -> DataFrame:
        """The rows of one key; null finds null."""
        out = self.snapshot()
        for c, v in zip(self.keys, key, strict=True):
            out = out.where(F.col(c).eqNullSafe(F.lit(v)))
        return out

    def enrich(self, df: DataFrame, columns: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
        """Left join of df, null-safely, on these columns for the keys. Spark broadcasts the snapshot if it is below
        spark.sql.autoBroadcastJoinThreshold, and shuffles both sides otherwise."""
        return rel.left_join(df, self.snapshot(), list(zip(columns, self.keys, strict=True)), right_names=names)


def greatest_partition(df: DataFrame, column: str) -> DataFrame:
    """The rows of the greatest value of a partition column. Where it is one of the files' folders, only those are read."""
    most = df.agg(F.max(column).alias("_most"))
    return df.join(F.broadcast(most), F.col(column) == F.col("_most"), "left_semi")  # one row
