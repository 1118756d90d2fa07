"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A budget of tokens goes down a tree (say domain, language, source), at each node to the children in
proportion to their weights. A child can't take more than it holds (its tokens times the epochs
allowed): what it leaves goes to its siblings, and only what they can't take either is missing at the
node itself, whose own siblings then take it. With a child's need capped by what it holds that is
one water level a node, found from the top by window sums over the node's children (not over rows).

A leaf's share is whole epochs of its rows and then a prefix of one more, in the order of a hash of
seed, epoch and id. The cut is found from sums over hash buckets, and then row by row only in the
bucket in which it falls; rows are selected by comparing with it, so texts aren't shuffled and a leaf
with a third of all rows isn't one task's work.

Tokens are runs of other than blank, tab and line ends. Nulls: a null text has no tokens; a null
language or source is a node of its own; a null id is hashed as 'null'. Rows with the same id and leaf
share one place in the order and are in or out together. Rows without tokens cost nothing. A weight
that isn't given is 1; a node with weight 0 gets nothing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that a hash bucket should hold at most, and hex digits of the hash that name a bucket at most.
BUCKET_ROWS, DIGITS = 4096, 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\r\n]+")), F.lit(0)).cast("long")


def weight(value: Column, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in given.items():
        out = F.when(value.eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def shares(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Adds share, of the parent's budget, to children with cap, w and budget."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = of.orderBy("_full", F.col(node).asc_nulls_first())
    able = children.where("w > 0").withColumn("_full", F.col("cap") / F.col("w"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = able.withColumn("_level", (F.col("budget") - before) / beyond)
    level = level.withColumn("_at", F.max(F.when(F.col("_level") < F.col("_full"), F.col("_level"))).over(of))
    share = F.when(F.col("_level") < F.col("_full"), F.col("w") * F.col("_at")).otherwise(F.col("cap"))
    return level.withColumn("share", share.cast("double")).drop("_full", "_level", "_at")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], fraction: float, epochs: int) -> DataFrame:
    """leaves: the level columns, tokens, rows. Adds target, the tokens that a leaf gets."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    nodes = total.select(F.least(F.col("all") * F.lit(float(fraction)), F.col("all") * F.lit(float(epochs))).alias("share"))
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        own = leaves.groupBy(*parent, level).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        own = own.withColumn("cap", F.col("tokens") * F.lit(float(epochs))).withColumn("w", weight(F.col(level), weights.get(level, {})))
        up = nodes.select(*[F.col(c).alias(f"_{c}") for c in parent], F.col("share").alias("budget"))
        same = F.lit(True)
        for c in parent:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        # The root's budget is one row.
        joined = own.join(up if parent else F.broadcast(up), same).drop(*[f"_{c}" for c in parent])
        nodes = shares(joined, parent, level).select(*parent, level, "tokens", "rows", "share")
    return nodes.withColumn("target", F.floor(F.round("share", 4)).cast("long")).drop("share")


def copies(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], fraction: float = 0.6, epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with, for each level, its value in column _mx_<level>, and _mx_copies: how often the row is in the mixture (0: not)."""
    if fraction < 0 or epochs < 1:
        raise ValueError("fraction must not be negative, and epochs at least 1")
    names = list(levels)
    slim = written(docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("tokens"), *[levels[k].alias(k) for k in names]), "mixing-rows")
    leaves = slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = budgets(written(leaves, "leaves"), names, weights, fraction, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("target") / F.col("tokens")), F.lit(epochs))).otherwise(0).cast("long")
    digits = F.least(F.greatest(F.ceil(F.log(16.0, F.col("rows") / BUCKET_ROWS)), F.lit(0)), F.lit(DIGITS)).cast("int")
    leaves = leaves.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < epochs, F.col("target") - F.col("whole") * F.col("tokens")).otherwise(-1)).withColumn("digits", digits)
    leaves = written(leaves.select(*[F.col(k).alias(f"_mx_{k}") for k in names], F.col("whole").alias("_mx_whole"), F.col("rest").alias("_mx_rest"), F.col("digits").alias("_mx_digits")), "leaf-budgets")

    def placed(rows: DataFrame, values: dict[str, Column], id_: Column, table: DataFrame, how: str = "inner") -> DataFrame:
        same = F.lit(True)
        for k in names:
            same = same & values[k].eqNullSafe(table[f"_mx_{k}"])
        joined = rows.join(table, same, how)
        hash_ = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mx_whole").cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))
        return joined.withColumn("_mx_hash", hash_).withColumn("_mx_bucket", F.expr("substr(_mx_hash, 1, _mx_digits)"))

    leaf = [f"_mx_{k}" for k in names]
    rows = placed(slim, {k: slim[k] for k in names}, slim["id"], leaves).select(*leaf, "_mx_hash", "_mx_bucket", "_mx_rest", "id", "tokens")
    sums = rows.groupBy(*leaf, "_mx_bucket").agg(F.sum("tokens").alias("held"), F.max("_mx_rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy(*leaf).orderBy("_mx_bucket")) - F.col("held"))
    edge = sums.where("before <= rest and rest < before + held").select(*leaf, F.col("_mx_bucket").alias("_mx_edge"), (F.col("rest") - F.col("before")).alias("_mx_left"))
    edge = written(edge, "edges-of-leaves")
    same = F.col("_mx_bucket") == edge["_mx_edge"]
    for k in leaf:
        same = same & rows[k].eqNullSafe(edge[k])
    near = rows.join(edge, same).select(*[rows[k] for k in leaf], "_mx_hash", "id", "tokens", "_mx_left")
    place = F.struct(F.col("_mx_hash").alias("h"), F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("i"))
    near = near.withColumn("place", place).withColumn("sum", F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("place")))
    cuts = near.where("sum <= _mx_left").groupBy(*leaf).agg(F.max("place").alias("_mx_cut"))
    own = leaves
    for more, columns in ((edge, ["_mx_edge"]), (cuts, ["_mx_cut"])):
        more = more.select(*[F.col(k).alias(f"{k}_") for k in leaf], *columns)
        same = F.lit(True)
        for k in leaf:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        own = own.join(more, same, "left").drop(*[f"{k}_" for k in leaf])
    own = written(own, "leaf-cuts")
    out = placed(docs, levels, F.col(id_col), own, "left")
    here = F.struct(F.col("_mx_hash").alias("h"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"))
    inside = F.col("_mx_edge").isNull() | (F.col("_mx_bucket") < F.col("_mx_edge")) | ((F.col("_mx_bucket") == F.col("_mx_edge")) & F.coalesce(here <= F.col("_mx_cut"), F.lit(False)))
    n = F.col("_mx_whole") + F.when((F.col("_mx_rest") >= 0) & inside, 1).otherwise(0)
    return out.withColumn("_mx_copies", F.coalesce(n, F.lit(0)).cast("long")).select(*docs.columns, *[levels[k].alias(f"_mx_{k}") for k in names], "_mx_copies")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], **how) -> DataFrame:
    """The mixture: docs' columns, each row as often as it is in it."""
    chosen = copies(docs, levels, weights, **how).where("_mx_copies > 0")
    return chosen.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mx_copies"))).alias("_mx_epoch")).drop("_mx_epoch")
