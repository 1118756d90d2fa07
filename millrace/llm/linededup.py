"""Line dedup by site-relative frequency; DataFrame functions only.

A line is boilerplate of a host if at least ``least`` of the host's pages hold it and they are more
than ``ratio`` of the host's pages. Lines are compared without the blanks at their ends, by two
64-bit hashes; blank lines never count. A page counts once however often it repeats a line. A host's
boilerplate is at most (mean distinct lines of its pages) / ratio lines, so its list is small; the table
of all hosts' lists is written first, so that the planner knows its size and broadcasts it only below
spark.sql.autoBroadcastJoinThreshold (beyond it, a shuffled join that AQE splits where skewed).

Nulls: a null text stays null, and its row counts as a page; a null host is a host of its own. Repeated
rows count as pages each. A text whose lines all go becomes empty. An empty table stays empty. Columns
keep their names and order; helper columns start with _ld_ and can't clash with those of the table
unless they do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLANKS = " \t\r"


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def key_of(line: Column) -> Column:
    """128 bits that stand for a bare line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = 0.05, least: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """_ld_host, _ld_bad: each host's boilerplate lines, as keys."""
    if not 0 <= ratio < 1 or least < 1:
        raise ValueError("ratio must be in [0, 1) and least positive")
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), bare))
    seen = pages.select("host", F.explode(lines).alias("line")).where("line <> ''")
    counts = seen.select("host", key_of(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    bad = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return bad.groupBy(F.col("host").alias("_ld_host")).agg(F.collect_list("key").alias("_ld_bad"))


def without_boilerplate(docs: DataFrame, ratio: float = 0.05, least: int = 5, host_col: str = "source", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with the boilerplate lines cut out of their texts; with counts, also _ld_lines and _ld_dropped."""
    bad = written(boilerplate(docs, ratio, least, host_col, text_col), "boilerplate")
    rows = docs.join(bad, docs[host_col].eqNullSafe(bad["_ld_host"]), "left")
    lines = F.split(F.col(text_col), "\n")
    good = F.filter(lines, lambda x: ~F.array_contains(F.col("_ld_bad"), key_of(bare(x))))
    kept = F.when(F.col("_ld_bad").isNull(), lines).otherwise(good)
    text = F.when(F.col("_ld_bad").isNull(), F.col(text_col)).otherwise(F.array_join(good, "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        size = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        out += [size.alias("_ld_lines"), (size - F.coalesce(F.size(kept), F.lit(0))).cast("long").alias("_ld_dropped")]
    return rows.select(out)
