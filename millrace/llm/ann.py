"""Approximate nearest neighbours: score-aware quantisation, four-bit table scans, exact reranking.

The nearest vector by Euclidean distance is the one of greatest q.x - |x|²/2, an inner product. Each
vector is cut into pairs of dimensions, each coded as one of 16 centres; centres and codes minimise the
anisotropic loss, in which the part of the residual that is parallel to the vector (the part that moves
large inner products) weighs eta times as much as the rest. Two codes share a byte, so a scan adds one
value of a 256-entry table for every four dimensions; |x|²/2 is kept as it is. The best by that score
in each block are ranked again by their exact distance in double precision.

Centres are fitted on at most SAMPLE rows (the first by a hash of their id); every row is indexed, and
every query is scanned against every block, so no bucket can be hot. Blocks and query blocks have fixed
sizes; each meeting of two is one row of work.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows with a null id. Rows that share an id are all candidates (not for their own
id); as a query such an id stands for its smallest vector. Equal distances are ranked by smaller id. An
empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Rows that centres are fitted on at most; rows of a block and of a query block; candidates of a block that are reranked.
SAMPLE, BLOCK, QUERIES, RERANK = 10_000, 4096, 512, 100
#: A residual counts where a score is at least this share of the greatest possible (sets eta).
SHARE = 0.2


@dataclass
class Quantiser:
    mean: np.ndarray
    centres: np.ndarray  # (pairs of dimensions, 16, 2)
    eta: float

    def _cut(self, x: np.ndarray) -> np.ndarray:
        """(rows, pairs, 2), with a zero for an odd last dimension."""
        x = x - self.mean
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs): the nearest centres, then in turn the one of least anisotropic loss."""
        parts = self._cut(x)
        length = np.sqrt((parts**2).sum((1, 2)))
        unit = parts / np.maximum(length, 1e-12)[:, None, None]
        codes = np.empty(parts.shape[:2], np.int64)
        along = np.empty(parts.shape[:2])
        for s in range(parts.shape[1]):
            codes[:, s] = ((parts[:, s, None] - self.centres[s]) ** 2).sum(2).argmin(1)
            along[:, s] = ((parts[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(parts.shape[1]):
                rest = parts[:, s, None] - self.centres[s]
                line = (rest * unit[:, s, None]).sum(2)
                others = (total - along[:, s])[:, None]
                codes[:, s] = ((self.eta - 1) * (others + line) ** 2 + (rest**2).sum(2)).argmin(1)
                new = line[np.arange(len(x)), codes[:, s]]
                total += new - along[:, s]
                along[:, s] = new
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of codes adds to the score."""
        q = q - self.mean
        q = np.pad(q, ((0, 0), (0, q.shape[1] % 2))).reshape(len(q), -1, 2)
        each = np.einsum("qsd,scd->qsc", q, self.centres)
        each = np.pad(each, ((0, 0), (0, each.shape[1] % 2), (0, 0)))
        return (each[:, 0::2, None, :] + each[:, 1::2, :, None]).reshape(len(q), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 5) -> Quantiser:
    """Centres by alternating anisotropic assignment and its exact least-squares update."""
    rnd = np.random.default_rng(seed)
    d = x.shape[1]
    eta = max(1.0, (d - 1) * SHARE**2 / (1 - SHARE**2))
    mean = x.mean(0)
    model = Quantiser(mean, np.zeros((-(-d // 2), 16, 2)), eta)
    parts = model._cut(x)
    length = np.sqrt((parts**2).sum((1, 2)))
    unit = parts / np.maximum(length, 1e-12)[:, None, None]
    for s in range(parts.shape[1]):
        model.centres[s] = parts[rnd.integers(len(x), size=16), s]
    for _ in range(rounds):
        codes = model.encode(x, 1)
        residual = parts - model.centres[np.arange(parts.shape[1]), codes]
        along = (residual * unit).sum(2)
        total = along.sum(1)
        for s in range(parts.shape[1]):
            u, p = unit[:, s], parts[:, s]
            others = total - along[:, s]
            left = (eta - 1) * u[:, :, None] * u[:, None, :] + np.eye(2)
            right = (eta - 1) * u * (others + (p * u).sum(1))[:, None] + p
            for c in range(16):
                own = codes[:, s] == c
                if own.any():
                    model.centres[s, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
                else:
                    model.centres[s, c] = p[rnd.integers(len(x))]
            new = ((p - model.centres[s][codes[:, s]]) * u).sum(1)
            total += new - along[:, s]
            along[:, s] = new
    return model


def scan(model: Quantiser, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query id, id, distance of the k best of one block for each query, exactly ranked."""
    half = (((x - model.mean) ** 2).sum(1) / 2).astype(np.float32)
    out = []
    for a in range(0, len(q), 64):
        tables = model.tables(q[a : a + 64])
        scores = np.repeat(-half[None], len(tables), 0)
        for j in range(codes.shape[1]):
            scores += tables[:, j][:, codes[:, j]]
        scores[q_ids[a : a + 64, None] == ids[None]] = -np.inf
        keep = min(RERANK, len(ids))
        least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        for r in range(len(tables)):
            near = np.flatnonzero((scores[r] >= least[r]) & (scores[r] > -np.inf))  # ties with the last stay
            far = np.sqrt(((x[near] - q[a + r]) ** 2).sum(1))
            best = np.lexsort((ids[near], far))[:k]
            out.append((np.full(len(best), q_ids[a + r]), ids[near][best], far[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), for queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull()).where(sound)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], kind)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    shared = spark.sparkContext.broadcast(fit(np.stack(sample["x"])))

    def blocks(size: int, coded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, parts, n = [], [], 0
            part, number = TaskContext.get().partitionId(), 0

            def close(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
                codes = packed(shared.value.encode(v)).tobytes() if coded else b""
                arrays = [pa.array([part * 1_000_000 + number], pa.int64()), pa.array([i.astype("<i8").tobytes()]), pa.array([codes]), pa.array([v.astype("<f8").tobytes()])]
                return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "codes", "x"])

            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                parts.append(batch.column(1).flatten().to_numpy().reshape(-1, d))
                n += batch.num_rows
                while n >= size:
                    i, v = np.concatenate(ids), np.concatenate(parts)
                    yield close(i[:size], v[:size])
                    ids, parts, n, number = [i[size:]], [v[size:]], n - size, number + 1
            if n:
                yield close(np.concatenate(ids), np.concatenate(parts))

        return run

    shape = "block long, ids binary, codes binary, x binary"
    index = written(rows.mapInArrow(blocks(BLOCK, True), shape), "ann-index")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    queries = written(asked.mapInArrow(blocks(QUERIES, False), shape), "ann-queries").select(F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    # Every index block meets every query block: both go to each cell of a grid, by an ordinary equi-join.
    many, waves = index.count(), queries.count()
    if not many or not waves:
        return spark.createDataFrame([], kind)
    small_batches(spark)
    lanes = min(waves, 16)
    left = index.withColumn("cell", F.pmod("block", F.lit(min(many, 64)))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = queries.withColumn("lane", F.pmod(F.xxhash64("q_ids"), F.lit(lanes)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(many, 64) - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: E731,B023
                q_ids, ids = get("q_ids", "<i8"), get("ids", "<i8")
                found = scan(shared.value, q_ids, get("q", "<f8").reshape(-1, d), ids, get("codes", np.uint8).reshape(len(ids), -1), get("x", "<f8").reshape(-1, d), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    met = left.join(right, ["cell", "lane"]).select("ids", "codes", "x", "q_ids", "q").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
