"""Relational operators, callbacks and functions on hand-made rows (FIXTURES.md) and their edge cases."""

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import library as fn
from millrace.operators import callbacks as cb
from millrace.operators import relational as rel

LEFT = [(1, "ss"), (-1, None), (None, "dd"), (1, "cc")]
RIGHT = [(1, "ss"), (None, "ff"), (1, None), (2, "ee")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def left(spark):
    return spark.createDataFrame(LEFT, "c1 int, c2 string")


@pytest.fixture()
def right(spark):
    return spark.createDataFrame(RIGHT, "c1 int, c2 string")


def test_group_concat_and_null_group(spark):
    df = spark.createDataFrame([(1, "ss", 0), (-1, None, 1), (None, "dd", 2), (1, None, 3)], "c1 int, c2 string, p int")
    got = rel.group_by(df, ["c1"], {"n": fn.count_rows(), "t": fn.group_concat("c2", "p")}).withColumn("s", fn.substr("t", 0, 2))
    assert rows(got) == rows(spark.createDataFrame([(1, 2, "ss,null", "ss"), (-1, 1, "null", "nu"), (None, 1, "dd", "dd")], "a int, b long, c string, d string"))
    assert rows(rel.group_by(df.limit(0), ["c1"], {"n": fn.count_rows()})) == []


def test_over(left):
    want = [(-1, None, 1), (1, "cc", 1), (1, "ss", 2), (None, "dd", 1)]
    assert rows(rel.over(left, ["c1"], ["c2"], {"r": fn.row_rank()})) == sorted(want, key=str)
    assert rows(cb.over_with(left, ["c1"], ["c2"], lambda k, r: [(i + 1,) for i in range(len(r))], "r int")) == sorted(want, key=str)
    assert rows(cb.over_with(left, ["c1"], ["c2"], lambda k, r: None if k[0] == 1 else [(0,)] * len(r), "r int")) == [(-1, None, 0), (None, "dd", 0)]
    with pytest.raises(Exception, match="tuples"):
        cb.over_with(left, ["c1"], ["c2"], lambda k, r: [], "r int").collect()


def test_joins_match_nulls(left, right):
    names = {"right_names": {"c1": "t2_c1", "c2": "t2_c2"}}
    assert rel.left_join(left, right, [("c1", "c1")], **names).count() == 6
    assert rel.inner_join(left, right, [("c1", "c1")], **names).count() == 5
    full = rel.outer_join(left, right, [("c1", "c1")], **names)
    assert full.count() == 7 and full.columns == ["c1", "c2", "t2_c1", "t2_c2"]
    assert rel.inner_join(left, right, [("c1", "c1")], **names).where("c2 = 'dd' and t2_c2 = 'ff'").count() == 1
    assert rel.join(left, right, [("c1", "c1")], "left_anti").count() == 1
    with pytest.raises(schema.ColumnNameConflict):
        rel.inner_join(left, right, [("c1", "c1")])
    with pytest.raises(ValueError):
        rel.join(left, right, [])


def test_range_and_asof(spark):
    p = spark.createDataFrame([(k, k * 7 % 50) for k in range(30)], "p long, t long")
    s = spark.createDataFrame([(1, 0, 10), (2, 5, 37), (3, 20, 20), (4, 49, 80)], "s long, lo long, hi long")
    want = sorted((k, i) for k in range(30) for i, lo, hi in [(1, 0, 10), (2, 5, 37), (3, 20, 20), (4, 49, 80)] if lo <= k * 7 % 50 < hi)
    for width in (1, 7, 100):
        assert sorted(map(tuple, rel.range_join(p, s, "t", "lo", "hi", width).select("p", "s").collect())) == want
    quotes = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("b", 3, 30)], "k string, qt long, v long")
    trades = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("c", 9), ("b", 3)], "k string, t long")
    assert rows(rel.asof_join(trades, quotes, ["k"], "t", "qt", ["v"])) == sorted([("a", 0, None), ("a", 1, 10), ("a", 4, 10), ("a", 9, 50), ("c", 9, None), ("b", 3, 30)], key=str)


def test_select_drops_null_and_empty(spark, left):
    assert rel.select_struct(left, F.when(F.col("c1") > 0, F.struct(F.lit(1).alias("x")))).count() == 2
    many = F.when(F.col("c1") == 1, F.array(F.struct(F.lit(1).alias("x")), F.struct(F.lit(2).alias("x")))).when(F.col("c1") == -1, F.array().cast("array<struct<x:int>>"))
    assert rel.expand(left, many, keep_all=True).count() == 4
    assert rel.expand(left, many, unless_null=F.nullif(F.col("c2"), F.lit("ss"))).count() == 2
    assert rows(cb.map_rows(left, lambda r: None if r["c1"] is None else (r["c1"] * 2,), "d int")) == [(-2,), (2,), (2,)]
    assert cb.flat_map_rows(left, lambda r: [(r["c1"], k) for k in range(r["c1"] or 0)], "a int, b int", keep_all=True).columns == ["c1", "c2", "a", "b"]
    with pytest.raises(schema.ColumnNameConflict):
        rel.select(left, {"c1": F.lit(1)}, keep_all=True)


def test_groups_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        big = 1 << 60
        df = spark.createDataFrame([(None if k % 5 == 0 else big + k % 3, k) for k in range(200)], "k long, v long")
        got = cb.aggregate_with(df, ["k"], lambda key, r: (int(r.v.sum()), len(r)), "s long, n long", order=["v"])
        want = df.groupBy("k").agg(F.sum("v"), F.count("*"))
        assert rows(got) == rows(want)
        assert cb.aggregate_with(df, ["k"], lambda key, r: None, "s long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sets_projection_and_rest(spark, left, right):
    assert rel.union_all([left, right, left]).count() == 12 and rel.union_all([]) is None
    assert rel.append(left, right).columns == ["c1", "c2"]
    assert rel.project_negative(left, "c1", "absent").columns == ["c2"] and rel.project(left, "c2").columns == ["c2"]
    assert rel.empty_like(left).count() == 0 and rel.rows_to_table(spark, [], "a int") is None
    assert rel.rows_to_table(spark, [(1,)], "a int").count() == 1
    assert rel.add_columns(left, {"z": F.lit(1)}).columns == ["c1", "c2", "z"]
    with pytest.raises(ValueError):
        rel.indexed(left)
    s = schema.SchemaBuilder().column("a", "INT").column("b", "VARBYTE").build()
    assert s.simpleString() == "struct<a:int,b:string>"
    with pytest.raises(ValueError):
        schema.SchemaBuilder().column("a", "FLOAT")


def test_aggregates_without_values(spark):
    df = spark.createDataFrame([("a", None), ("a", 3), ("b", None)], "k string, v int")
    got = rel.group_by(df, ["k"], {"i": fn.sum_int("v"), "l": fn.sum_long("v"), "m": fn.max_of("v"), "a": fn.avg_all_rows("v")})
    assert rows(got) == [("a", 3, 3.0, 3, 1.5), ("b", 0, 0.0, None, 0.0)]


def test_top_n_ties(spark):
    df = spark.createDataFrame([(0, 5, "x"), (1, 7, "x"), (2, 5, "x"), (3, 7, "x"), (4, 1, "x")], "p int, v int, g string")
    got = fn.top_n(df, ["g"], "v", 3, "p").orderBy("rank").collect()
    assert [r.p for r in got] == [3, 1, 0]
    assert fn.top_n(df, ["g"], "v", 99, "p").count() == 5


def test_scalars(spark):
    one = spark.range(1)
    zone = one.select(fn.parse_date_with_zone(F.lit("2021-08-19 23:10:20 EDT")).alias("a"), fn.format_date(F.lit(1629429020000)).alias("b"), fn.parse_date(F.lit("bad")).alias("c")).first()
    assert tuple(zone) == (1629429020000, "2021-08-20 03:10:20", None)
    got = one.select(fn.trim(F.lit("xxaxbx"), "x"), fn.ltrim(F.lit("xxa"), "x"), fn.rtrim(F.lit("axx"), "x"), fn.substr(F.lit("abc"), 5), fn.substr(F.lit(None), 0, 1), fn.to_integer(F.lit("z")), fn.to_double(F.lit("1.5")), fn.to_str(F.lit(7)))
    assert tuple(got.first()) == ("axb", "a", "a", "", None, None, 1.5, "7")
    with pytest.raises(ValueError):
        fn.substr(F.lit("a"), 3, 2)


def test_murmur(spark):
    # Published vectors of the 32-bit x86 variant; for ASCII the signed tail makes no difference.
    assert fn._murmur(b"", 0) == 0 and fn._murmur(b"", 1) == 0x514E28B7
    assert fn._murmur(b"test", 0) == 0xBA6BD213 - (1 << 32) and fn._murmur(b"Hello, world!", 0) == 0xC0363E43 - (1 << 32)
    df = spark.createDataFrame([("a",), (None,), ("é",)], "s string").select(fn.murmur3_hash32("s").alias("h"))
    assert [r.h for r in df.collect()] == [fn._murmur(b"a"), None, fn._murmur("é".encode())]


def test_plans_are_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(f"{tmp_path}/p")
    df = rel.project(rel.filter_rows(spark.read.parquet(f"{tmp_path}/p"), F.col("b") > 50), "b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,50)" in plan and "ReadSchema: struct<b:bigint>" in plan
