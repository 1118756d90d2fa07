"""One query for each operator, on the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import library as fn
from ..operators import callbacks as cb
from ..operators import relational as rel
from ..operators import windows as win
from ..schema import to_ms
from ..sinks import kafka as kafka_sink
from ..sources import dimension
from ..sources import kafka as kafka_source
from ..streaming import jobs, stateful
from ..streaming import windows as swin
from . import places

HOUR = 3_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The event stream with its time in milliseconds, as the SQL side sees it.
EV = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms FROM events)"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("ms", to_ms(F.col("ts")))


# Relational operators


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_rows(spark, d):
    return rel.filter_rows(t(spark, d, "lineitem"), (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, value FROM events WHERE value > 50")
def filter_callback(spark, d):
    return cb.filter_with(t(spark, d, "events").select("event_id", "value"), lambda b: b["value"] > 50)


@query("SELECT o_orderkey, o_totalprice * 2 AS gross, upper(o_orderstatus) AS status FROM orders")
def select_expr(spark, d):
    return rel.select(t(spark, d, "orders"), {"o_orderkey": F.col("o_orderkey"), "gross": F.col("o_totalprice") * 2, "status": F.upper("o_orderstatus")})


@query("SELECT n_nationkey, n_name, n_regionkey, n_regionkey * 10 AS code FROM nation")
def select_keep_all(spark, d):
    return rel.select(t(spark, d, "nation"), {"code": F.col("n_regionkey") * 10}, keep_all=True)


@query("SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'")
def select_drop_null(spark, d):
    made = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")))
    return rel.select_struct(t(spark, d, "orders"), made)


@query("SELECT p_partkey, s.* FROM part, (VALUES ('half', 0.5), ('full', 1.0)) AS s(kind, share) WHERE p_size >= 25")
def lateral_inline(spark, d):
    kinds = F.when(F.col("p_size") >= 25, F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("share")) for k, s in (("half", 0.5), ("full", 1.0))]))
    return rel.expand(t(spark, d, "part"), kinds, {"p_partkey": F.col("p_partkey")}).select("p_partkey", "kind", F.col("share").cast("decimal(2,1)").alias("share"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def group_agg(spark, d):
    return rel.group_by(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": fn.count_rows(), "qty": F.round(fn.sum_double("l_quantity"), 2), "revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)})


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(spark, d):
    return rel.group_by(t(spark, d, "orders"), ["o_custkey"], {"n": fn.count_rows(), "most": fn.max_of("o_totalprice")}, having="n > 12")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS k, count(*) AS n FROM nation GROUP BY 1")
def group_null_key(spark, d):
    k = rel.select(t(spark, d, "nation"), {"k": F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey"))})
    return rel.group_by(k, ["k"], {"n": fn.count_rows()})


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, min(l_quantity) AS low FROM lineitem")
def group_global(spark, d):
    return rel.group_by(t(spark, d, "lineitem"), [], {"n": fn.count_rows(), "keys": F.sum("l_orderkey"), "low": fn.min_of("l_quantity")})


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rn FROM orders")
def over_rownum(spark, d):
    return rel.over(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"], {"rn": fn.row_rank()}).select("o_orderkey", "o_custkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT event_id, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, lag(event_id) OVER w2 AS before, lead(event_id) OVER w2 AS after, round(sum(value) OVER w2, 2) AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id NULLS FIRST), w2 AS (PARTITION BY event_type ORDER BY user_id NULLS FIRST, event_id)")
def over_ranks(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    a = rel.over(e, ["event_type"], ["user_id"], {"r": F.rank(), "dr": F.dense_rank()})
    b = rel.over(a, ["event_type"], ["user_id", "event_id"], {"before": F.lag("event_id"), "after": F.lead("event_id"), "running": F.sum("value")})
    return b.select("event_id", F.col("r").cast("long").alias("r"), F.col("dr").cast("long").alias("dr"), "before", "after", F.round("running", 2).alias("running"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return rel.inner_join(t(spark, d, "orders"), t(spark, d, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT event_id, user_id, c_custkey, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def join_left(spark, d):
    return rel.left_join(t(spark, d, "events"), t(spark, d, "customer"), [("user_id", "c_custkey")]).select("event_id", "user_id", "c_custkey", "c_name")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON c_custkey = s_suppkey")
def join_full(spark, d):
    return rel.outer_join(t(spark, d, "customer").where("c_custkey % 2 = 0"), t(spark, d, "supplier").where("s_suppkey % 3 = 0"), [("c_custkey", "s_suppkey")]).select("c_custkey", "s_suppkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    r = rel.rename(b, {c: f"r_{c}" for c in b.columns})
    return rel.theta_join(a, r, (F.col("n_regionkey") == F.col("r_n_regionkey")) & (F.col("n_nationkey") < F.col("r_n_nationkey"))).select(F.col("n_name").alias("a"), F.col("r_n_name").alias("b"))


@query("WITH x AS (SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS k FROM nation), y AS (SELECT r_name, CASE WHEN r_regionkey <> 3 THEN r_regionkey END AS k FROM region) SELECT n_nationkey, r_name FROM x JOIN y ON x.k IS NOT DISTINCT FROM y.k")
def join_null_safe(spark, d):
    x = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("k"))
    y = t(spark, d, "region").select("r_name", F.when(F.col("r_regionkey") != 3, F.col("r_regionkey")).alias("k"))
    return rel.join(x, y, [("k", "k")], right_names={"k": "k2"}).select("n_nationkey", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    return rel.join(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return rel.join(t(spark, d, "customer"), t(spark, d, "orders"), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey", "c_name")


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    return rel.join(t(spark, d, "supplier"), t(spark, d, "nation"), [("s_nationkey", "n_nationkey")], "right").select("n_name", "s_suppkey")


@query(f"WITH s AS (SELECT user_id AS u, event_id AS span, ms AS low, ms + 600000 AS high FROM {EV} WHERE event_type = 'click') SELECT event_id, span FROM {EV} e JOIN s ON e.user_id = u AND e.ms >= low AND e.ms < high WHERE event_type = 'purchase'")
def join_range(spark, d):
    e = events(spark, d)
    spans = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("span"), F.col("ms").alias("low"), (F.col("ms") + 600_000).alias("high"))
    return rel.range_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ms"), spans, "ms", "low", "high", 600_000, [("user_id", "u")]).select("event_id", "span")


@query(f"WITH c AS (SELECT user_id, ms, max(value) AS v FROM {EV} WHERE event_type = 'click' GROUP BY ALL), p AS (SELECT event_id, user_id, ms FROM {EV} WHERE event_type = 'purchase') SELECT event_id, v FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ms >= c.ms")
def join_asof(spark, d):
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.max("value").alias("v"))
    return rel.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ms"), clicks, ["user_id"], "ms", "ms", ["v"]).select("event_id", "v")


@query(f"WITH c AS (SELECT user_id, ms, max(value) AS v FROM {EV} WHERE event_type = 'click' AND event_id % 3 <> 0 GROUP BY ALL), p AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN ms END AS ms FROM {EV} WHERE event_type = 'purchase') SELECT event_id, v FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ms >= c.ms")
def join_asof_null(spark, d):
    """Rows without a time on both sides."""
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").withColumn("ms", F.when(F.col("event_id") % 3 != 0, F.col("ms"))).groupBy("user_id", "ms").agg(F.max("value").alias("v"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("ms")).alias("ms"))
    return rel.asof_join(buys, clicks, ["user_id"], "ms", "ms", ["v"]).select("event_id", "v")


@query("SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderstatus = 'F'")
def join_self(spark, d):
    """Two selections of one table."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    a, b = o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus = 'F'")
    return rel.inner_join(a, b, [("o_custkey", "o_custkey")], left_names={"o_orderkey": "first"}, right_names={"o_orderkey": "second", "o_custkey": "c", "o_orderpriority": "p", "o_orderstatus": "s"}).select("first", "second")


@query("SELECT r_regionkey, r_name FROM region")
def project(spark, d):
    return rel.project(t(spark, d, "region"), "r_regionkey", "r_name")


@query("SELECT s_suppkey, s_name FROM supplier")
def project_negative(spark, d):
    return rel.project_negative(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", "not_there")


@query("SELECT r_regionkey, r_name, length(r_name) AS size, r_regionkey + 1 AS next FROM region")
def add_columns(spark, d):
    return rel.add_columns(t(spark, d, "region"), {"size": F.length("r_name").cast("long"), "next": F.col("r_regionkey") + 1})


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_all(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return rel.union_all([n, t(spark, d, "region").select("r_regionkey", "r_name"), n])


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def append(spark, d):
    return rel.append(t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), t(spark, d, "region").select("r_regionkey", "r_name"))


@query("SELECT n_nationkey, k.name FROM nation JOIN (VALUES (0, 'zero'), (1, NULL), (3, 'three')) AS k(key, name) ON n_nationkey = k.key")
def rows_to_table(spark, d):
    made = rel.rows_to_table(spark, [(0, "zero"), (1, None), (3, "three")], "key int, name string")
    return rel.inner_join(t(spark, d, "nation"), made, [("n_nationkey", "key")]).select("n_nationkey", "name")


@query("SELECT * FROM supplier WHERE false")
def empty_like(spark, d):
    return rel.empty_like(t(spark, d, "supplier"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return rel.union_distinct(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"))


@query("(SELECT o_custkey AS k FROM orders) INTERSECT (SELECT user_id FROM events)")
def intersect(spark, d):
    return rel.intersect(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "events").select("user_id"))


@query("(SELECT c_nationkey AS k FROM customer) EXCEPT ALL (SELECT s_nationkey FROM supplier)")
def except_all(spark, d):
    return rel.except_all(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(spark, d):
    return rel.sort(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", limit=25)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def group_cube(spark, d):
    return t(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(fn.count_rows().alias("n"))


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def shuffle_by_key(spark, d):
    """Both aggregates run on the one layout that indexed() makes."""
    return rel.group_by(rel.indexed(t(spark, d, "orders"), "o_custkey"), ["o_custkey"], {"n": fn.count_rows(), "kinds": F.count_distinct("o_orderpriority")})


@query("SELECT event_id, user_id FROM events")
def shuffle_rebalance(spark, d):
    return rel.rebalanced(t(spark, d, "events").select("event_id", "user_id"))


# Functions


@query("SELECT user_id, string_agg(coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'null'), ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def group_concat(spark, d):
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return rel.group_by(t(spark, d, "events"), ["user_id"], {"types": fn.group_concat(kind, "event_id")})


@query("SELECT o_custkey, coalesce(CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT), 0) AS i, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS DOUBLE) END), 0.0) AS l, round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0.0), 2) AS f FROM orders GROUP BY o_custkey")
def sum_default0(spark, d):
    p = F.col("o_orderstatus") == "P"
    return rel.group_by(t(spark, d, "orders"), ["o_custkey"], {"i": fn.sum_int(F.when(p, 1)), "l": fn.sum_long(F.when(p, F.col("o_orderkey"))), "f": F.round(fn.sum_double(F.when(p, F.col("o_totalprice"))), 2)})


@query("SELECT c_nationkey, max(c_acctbal) AS most, min(c_acctbal) AS least, max(c_name) AS name, count(*) AS n FROM customer GROUP BY c_nationkey")
def agg_max(spark, d):
    return rel.group_by(t(spark, d, "customer"), ["c_nationkey"], {"most": fn.max_of("c_acctbal"), "least": fn.min_of("c_acctbal"), "name": fn.max_of("c_name"), "n": fn.count_rows()})


@query("SELECT event_type, round(coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN value END), 0) / count(*), 6) AS a FROM events GROUP BY event_type")
def avg_all_rows(spark, d):
    return rel.group_by(t(spark, d, "events"), ["event_type"], {"a": F.round(fn.avg_all_rows(F.when(F.col("event_id") % 4 != 0, F.col("value"))), 6)})


@query("WITH c AS (SELECT o_orderpriority, o_orderkey, floor(o_totalprice / 10000) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 10000) DESC, o_orderkey) AS rn FROM orders) SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY v DESC, o_orderkey DESC) AS BIGINT) AS rank FROM c WHERE rn <= 10")
def topn(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.floor(F.col("o_totalprice") / 10000).alias("v"))
    return fn.top_n(o, ["o_orderpriority"], "v", 10, "o_orderkey").select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, try_cast(o_orderpriority AS BIGINT) AS bad, CAST(o_orderkey AS DOUBLE) AS f, CAST(CAST(o_orderkey AS DECIMAL(38,2)) AS VARCHAR) AS dec FROM orders")
def casts(spark, d):
    return t(spark, d, "orders").select("o_orderkey", fn.to_integer(F.floor("o_totalprice")).alias("i"), fn.to_str("o_orderkey").alias("s"), fn.to_long("o_orderpriority").alias("bad"), fn.to_double("o_orderkey").alias("f"), fn.to_str(fn.to_big_decimal("o_orderkey", 2)).alias("dec"))


@query("SELECT p_partkey, substr(p_name, 3) AS tail, substr(p_name, 1, 4) AS head, substr(p_brand, 7, 2) AS code FROM part")
def substr0(spark, d):
    return t(spark, d, "part").select("p_partkey", fn.substr("p_name", 2).alias("tail"), fn.substr("p_name", 0, 4).alias("head"), fn.substr("p_brand", 6, 8).alias("code"))


@query("SELECT n_nationkey, ltrim(n_name, 'N') AS l, rtrim(n_name, 'A') AS r, trim(n_name, 'A') AS b FROM nation")
def trim_char(spark, d):
    return t(spark, d, "nation").select("n_nationkey", fn.ltrim("n_name", "N").alias("l"), fn.rtrim("n_name", "A").alias("r"), fn.trim("n_name", "A").alias("b"))


@query(f"SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS text, ms // 1000 * 1000 AS back FROM {EV}")
def date_fmt(spark, d):
    e = events(spark, d).withColumn("text", fn.format_date("ms"))
    return e.select("event_id", "text", fn.parse_date("text").alias("back"))


_TURN = "xor({0}, {0} >> {1})"
_TIMES = "CAST(CAST({0} AS HUGEINT) * {1} % 4294967296 AS BIGINT)"
#: MurmurHash3 of ASCII strings, block by block.
_MURMUR = f"""WITH c AS (SELECT c_custkey, length(c_name) AS n, list_transform(range(1, length(c_name) + 1), lambda i: CAST(ord(substr(c_name, CAST(i AS INTEGER), 1)) AS BIGINT)) AS b FROM customer),
k AS (SELECT *, list_transform(range(0, n, 4), lambda i: b[i + 1] + coalesce(b[i + 2], 0) * 256 + coalesce(b[i + 3], 0) * 65536 + coalesce(b[i + 4], 0) * 16777216) AS k FROM c),
m AS (SELECT *, list_transform(list_transform(list_transform(k, lambda x: {_TIMES.format('x', 3432918353)}), lambda x: ((x << 15) % 4294967296) | (x >> 17)), lambda x: {_TIMES.format('x', 461845907)}) AS m FROM k),
h AS (SELECT *, list_reduce(list_concat([CAST(104729 AS BIGINT)], m[: n // 4]), lambda h, x: ((((xor(h, x) << 13) % 4294967296) | (xor(h, x) >> 19)) * 5 + 3864292196) % 4294967296) AS h FROM m),
u AS (SELECT c_custkey, xor(CASE WHEN n % 4 > 0 THEN xor(h, m[n // 4 + 1]) ELSE h END, n) AS h FROM h),
v AS (SELECT c_custkey, {_TIMES.format(_TURN.format('h', 16), 2246822507)} AS h FROM u), w AS (SELECT c_custkey, {_TIMES.format(_TURN.format('h', 13), 3266489909)} AS h FROM v)
SELECT c_custkey, CAST(CASE WHEN {_TURN.format('h', 16)} >= 2147483648 THEN {_TURN.format('h', 16)} - 4294967296 ELSE {_TURN.format('h', 16)} END AS INTEGER) AS h FROM w"""


@query(_MURMUR)
def murmur_hash(spark, d):
    return t(spark, d, "customer").select("c_custkey", fn.murmur3_hash32("c_name").alias("h"))


# Callbacks


@query("SELECT event_id, user_id % 7 AS bucket, event_type || '!' AS label FROM events WHERE value >= 10")
def udf_struct(spark, d):
    return cb.map_rows(t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), lambda r: (r["event_id"], r["user_id"] % 7, r["event_type"] + "!") if r["value"] is not None and r["value"] >= 10 else None, "event_id long, bucket long, label string")


_BIG = "CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 9223372036854775807 - n_nationkey ELSE -9223372036854775807 - 1 + n_nationkey END"


def _extremes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    big = F.when(k % 3 == 1, F.lit((1 << 63) - 1) - k).when(k % 3 == 2, F.lit(-(1 << 63)) + k)
    return t(spark, d, "nation").select("n_nationkey", big.cast("long").alias("big"))


@query(f"SELECT n_nationkey, CAST({_BIG} AS VARCHAR) AS big, CAST(-(({_BIG}) // 2) AS VARCHAR) AS half FROM nation")
def udf_exact_integers(spark, d):
    """Integers at both ends of their range, with nulls beside them."""
    half = lambda r: (None if r["big"] is None else -(abs(r["big"]) // 2 * (1 if r["big"] > 0 else -1)),)
    return cb.map_rows(_extremes(spark, d), half, "half long", keep_all=True).select("n_nationkey", F.col("big").cast("string").alias("big"), F.col("half").cast("string").alias("half"))


@query(f"SELECT n_nationkey, CAST({_BIG} AS VARCHAR) AS big FROM nation WHERE {_BIG} > 9223372036854775800 OR {_BIG} < -9223372036854775800")
def filter_exact_integers(spark, d):
    return cb.filter_with(_extremes(spark, d), lambda b: (b["big"] > 9223372036854775800) | (b["big"] < -9223372036854775800)).select("n_nationkey", F.col("big").cast("string").alias("big"))


@query("SELECT n_name, k.k AS part, CAST(length(n_name) AS BIGINT) * k.k AS size FROM nation, (VALUES (1), (2)) AS k(k)")
def udtf_rows(spark, d):
    return cb.flat_map_rows(t(spark, d, "nation").select("n_name"), lambda r: [(k, len(r["n_name"]) * k) for k in (1, 2)], "part int, size long", keep_all=True)


@query("SELECT r_name, substr(r_name, CAST(i AS INTEGER), 1) AS letter, i AS place FROM region, generate_series(1, 30) AS g(i) WHERE i <= length(r_name)")
def udtf_expand(spark, d):
    letters = cb.table_function("letter string, place bigint", lambda s: [(c, k + 1) for k, c in enumerate(s)])
    spark.udtf.register("millrace_letters", letters)
    t(spark, d, "region").createOrReplaceTempView("millrace_region")
    return spark.sql("SELECT r_name, letter, place FROM millrace_region, LATERAL millrace_letters(r_name)")


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS spread, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 3")
def udaf_pandas(spark, d):
    def body(key: tuple, rows: pd.DataFrame) -> tuple | None:
        return (round(rows.c_acctbal.max() - rows.c_acctbal.min(), 2), len(rows)) if len(rows) > 3 else None

    return cb.aggregate_with(t(spark, d, "customer").select("c_nationkey", "c_acctbal"), ["c_nationkey"], body, "spread double, n long")


@query("SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS rank FROM supplier")
def udwf_pandas(spark, d):
    return cb.over_with(t(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"], lambda key, rows: [(k + 1,) for k in range(len(rows))], "rank long")


# Windows


@query(f"SELECT event_type, ms // {HOUR} * {HOUR} AS window_start, ms // {HOUR} * {HOUR} + {HOUR} AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM {EV} GROUP BY ALL")
def tumble(spark, d):
    return win.tumble(events(spark, d), ["event_type"], "ms", HOUR, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)})


def _hops(slide: int, size: int) -> str:
    return f"(SELECT e.*, w0 + ((ms - w0) // {slide} - k) * {slide} AS ws FROM {EV} e, (SELECT min(ms) // {size} * {size} AS w0 FROM {EV}), generate_series(0, {-(-size // slide) - 1}) AS g(k) WHERE w0 + ((ms - w0) // {slide} - k) * {slide} >= w0 AND ms - (w0 + ((ms - w0) // {slide} - k) * {slide}) < {size})"


@query(f"SELECT user_id, ws AS window_start, ws + {HOUR} AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM {_hops(HOUR // 2, HOUR)} GROUP BY ALL")
def hop(spark, d):
    return win.hop(events(spark, d), ["user_id"], "ms", HOUR, HOUR // 2, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)})


@query(f"SELECT event_type, ws AS window_start, ws + {HOUR} AS window_end, count(*) AS n FROM {_hops(1_500_000, HOUR)} GROUP BY ALL")
def hop_uneven(spark, d):
    return win.hop(events(spark, d), ["event_type"], "ms", HOUR, 1_500_000, {"n": fn.count_rows()})


@query(f"WITH b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, ms, value, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < {HOUR // 2} THEN 0 ELSE 1 END AS f FROM {EV})) SELECT user_id, min(ms) AS window_start, max(ms) + 1 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY user_id, s")
def session(spark, d):
    return win.session(events(spark, d), ["user_id"], "ms", HOUR // 2, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)})


@query(f"SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 2) AS most FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND {HOUR - 1} FOLLOWING)")
def over_duration(spark, d):
    return win.over_duration(events(spark, d), ["user_id"], "ms", HOUR, {"n": fn.count_rows(), "most": F.max("value")}).select("event_id", "n", F.round("most", 2).alias("most"))


@query(f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def over_size(spark, d):
    return win.over_size(events(spark, d), ["user_id"], ["ms", "event_id"], 5, {"n": fn.count_rows(), "total": F.sum("value")}).select("event_id", "n", F.round("total", 2).alias("total"))


@query(f"WITH g AS (SELECT event_type, ms // {HOUR} * {HOUR} AS ws, arg_min(event_id, CAST(ms AS HUGEINT) * 10000000 + event_id) AS first, arg_max(event_id, CAST(ms AS HUGEINT) * 10000000 + event_id) AS last, count(*) AS n FROM {EV} GROUP BY ALL) SELECT event_type, ws AS window_start, ws + {HOUR} AS window_end, 'first' AS place, first AS event_id FROM g WHERE n > 1 UNION ALL SELECT event_type, ws, ws + {HOUR}, 'last', last FROM g WHERE n > 1")
def time_window_transform(spark, d):
    def body(key: tuple, rows: pd.DataFrame, start: int, end: int) -> list[tuple] | None:
        if len(rows) < 2:
            return None
        rows = rows.sort_values(["ms", "event_id"])
        return [("first", int(rows.event_id.iloc[0])), ("last", int(rows.event_id.iloc[-1]))]

    return win.window_transform(events(spark, d).select("event_type", "ms", "event_id"), ["event_type"], "ms", HOUR, HOUR, body, "place string, event_id long")


_TOP = f"""WITH h AS (SELECT user_id, ws, count(*) AS n, round(sum(value), 2) AS total FROM {_hops(HOUR // 2, HOUR)} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY total DESC, user_id) AS rank FROM h)
SELECT ws AS window_start, CAST(rank AS BIGINT) AS rank, user_id, n, total, c_name, c_mktsegment FROM r LEFT JOIN customer ON user_id IS NOT DISTINCT FROM c_custkey WHERE rank <= 3"""


@query(_TOP)
def hop_topn_enriched(spark, d):
    """Flagship: the dimension is joined after ranking, to three rows a window instead of all events."""
    sums = win.hop(events(spark, d).select("user_id", "ms", "value"), ["user_id"], "ms", HOUR, HOUR // 2, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)})
    order = Window.partitionBy("window_start").orderBy(F.desc("total"), "user_id")
    top = sums.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")
    return rel.left_join(top, t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), [("user_id", "c_custkey")]).select("window_start", "rank", "user_id", "n", "total", "c_name", "c_mktsegment")


# Sources and sinks


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dim_join(spark, d):
    customers = dimension.Dimension(lambda: t(spark, d, "customer"), keys=["c_custkey"], refresh_s=3600)
    nations = dimension.Dimension(lambda: t(spark, d, "nation"), keys=["n_nationkey"], refresh_s=3600)
    a = customers.enrich(t(spark, d, "orders"), ["o_custkey"])
    return nations.enrich(a, ["c_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query(f"SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN event_type END AS event_type, value, ms AS __time__ FROM {EV}")
def json_roundtrip(spark, d):
    """Rows to records of a topic (nulls left out) and back."""
    rows = events(spark, d).select("event_id", "user_id", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("event_type"), "value", F.col("ms").alias("__time__"))
    sent = kafka_sink.records(rows, partitions=8, hash_by=["user_id"]).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    return kafka_source.parsed(sent, "event_id long, user_id long, event_type string, value double").drop("__receive_time__")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE date_trunc('month', l_shipdate) = (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem)")
def partition_max(spark, d):
    rows = t(spark, d, "lineitem").withColumn("pt", F.date_format("l_shipdate", "yyyyMM"))
    return dimension.greatest_partition(rows, "pt").select("l_orderkey", "l_linenumber")


# Streams: the events table as an unbounded one, read to its end. Only what the watermark has closed comes out.


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(t(spark, d, "events").schema)
    source = reader.parquet(path) if places.is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return source.withColumn("ms", to_ms(F.col("ts")))


def drained(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """What the stream gives out up to now, as a table."""
    path, job = places.fresh(spark, what), jobs.Job()
    job.to_table(df, path, f"{path}-checkpoint")
    job.join()
    return spark.read.schema(df.schema).parquet(path)


_MARK = f"(SELECT max(ms) - 1000 AS mark FROM {EV})"


@query(f"SELECT event_type, ws AS window_start, ws + {HOUR} AS window_end, n, total FROM (SELECT event_type, ms // {HOUR} * {HOUR} AS ws, count(*) AS n, round(sum(value), 2) AS total FROM {EV} GROUP BY ALL), {_MARK} WHERE ws + {HOUR} <= mark")
def stream_tumble(spark, d):
    return drained(spark, swin.tumble(event_stream(spark, d), ["event_type"], "ms", HOUR, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)}), "stream-tumble")


@query(f"WITH b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < {HOUR // 2} THEN 0 ELSE 1 END AS f FROM {EV})), g AS (SELECT user_id, min(ms) AS window_start, max(ms) + 1 AS window_end, count(*) AS n FROM b GROUP BY user_id, s) SELECT g.* FROM g, {_MARK} WHERE window_end - 1 + {HOUR // 2 - 1} <= mark")
def stream_session(spark, d):
    return drained(spark, swin.session(event_stream(spark, d), ["user_id"], "ms", HOUR // 2, {"n": fn.count_rows()}), "stream-session")


@query(f"""WITH h AS (SELECT user_id, (ms // {HOUR // 2} - k) * {HOUR // 2} AS ws, count(*) AS n, round(sum(value), 2) AS total FROM {EV}, generate_series(0, 1) AS g(k) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY total DESC, user_id) AS rank FROM h)
SELECT ws AS window_start, CAST(rank AS BIGINT) AS rank, user_id, n, total, c_name FROM r JOIN {_MARK} ON ws + {HOUR} <= mark LEFT JOIN customer ON user_id IS NOT DISTINCT FROM c_custkey WHERE rank <= 3""")
def stream_hop_topn(spark, d):
    """The flagship on a stream: each batch ranks the windows that it closes, and joins one snapshot of the dimension."""
    hops = swin.hop(event_stream(spark, d), ["user_id"], "ms", HOUR, HOUR // 2, {"n": fn.count_rows(), "total": F.round(F.sum("value"), 2)})
    customers = dimension.Dimension(lambda: t(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    path, job = places.fresh(spark, "stream-topn"), jobs.Job()

    def write(batch: DataFrame, number: int) -> None:
        top = swin.top_n_of_windows(batch, 3, [F.desc("total"), F.asc("user_id")])
        customers.enrich(top, ["user_id"]).drop("c_custkey").write.mode("overwrite").parquet(f"{path}/batch={number}")

    job.each_batch(hops, write, f"{path}-checkpoint", bounded=True)
    job.join()
    return spark.read.schema("user_id long, window_start long, window_end long, n long, total double, rank long, c_name string, batch long").parquet(path).select("window_start", "rank", "user_id", "n", "total", "c_name")


@query(f"SELECT event_id, ms, CAST(big AS VARCHAR) AS big FROM (SELECT event_id, ms, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 9223372036854775807 - event_id ELSE -9223372036854775807 - 1 + event_id END AS big FROM {EV}), {_MARK} WHERE ms <= mark")
def stream_reorder(spark, d):
    """Rows held until the watermark has passed them, with integers at both ends of their range beside nulls."""
    stateful.use_rocksdb(spark)
    k = F.col("event_id")
    big = F.when(k % 3 == 1, F.lit((1 << 63) - 1) - k).when(k % 3 == 2, F.lit(-(1 << 63)) + k)
    rows = event_stream(spark, d).select("event_id", "ms", big.cast("long").alias("big"))
    return drained(spark, stateful.reorder(rows, "ms"), "stream-reorder").select("event_id", "ms", F.col("big").cast("string").alias("big"))


_COUNT_AND_SUM = stateful.Spans(lambda key, rows, begins, ends: (ends - begins, stateful.sums(rows.event_id, begins, ends)))


@query(f"SELECT event_id, n, ids FROM (SELECT event_id, ms, count(*) OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS ids FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND {HOUR - 1} FOLLOWING)), {_MARK} WHERE ms + {HOUR} <= mark")
def stream_over_duration(spark, d):
    """Each row with those of the hour that it begins, once the watermark has passed that."""
    stateful.use_rocksdb(spark)
    rows = event_stream(spark, d).select("user_id", "ms", "event_id")
    out = stateful.over_duration(rows, ["user_id"], "ms", HOUR, _COUNT_AND_SUM, "n long, ids long")
    return drained(spark, out, "stream-over-duration").select("event_id", "n", "ids")


@query(f"SELECT event_id, count(*) OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS ids FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def stream_over_size(spark, d):
    stateful.use_rocksdb(spark)
    rows = event_stream(spark, d).select("user_id", "ms", "event_id")
    out = stateful.over_size(rows, ["user_id"], ["ms", "event_id"], 5, _COUNT_AND_SUM, "n long, ids long")
    return drained(spark, out, "stream-over-size").select("event_id", "n", "ids")
