"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text and their first four and five letters (present or not) is
trained with numpy from confirmed toxic texts (P) and unlabelled texts (U: the sample's labels
hidden). The risk, with class prior p and the logistic loss, is
    p * R_P(+1) + max(0, R_U(-1) - p * R_P(-1));
where the second part is negative its gradient is turned round, so U can't be overfitted as all
negative. Soft thresholding leaves few features, so a text is scored by looking up its words.
A fifth of the sample, not trained on, places the threshold where recall² / predicted share is
greatest, which needs no negatives; the scores are scaled so that it lies at THRESHOLD.

The sample is the only bounded thing: at most SAMPLE labelled rows, the first by a hash of their id.
All words of these are learned from, as features made by the executors; everything else reads all rows. Scores come from the text alone:
labels, lang, source and doc_id are never inputs.

Nulls: a null text is scored as empty; labels that are null or whose id is null are not used; a
null id is not held out. Repeated rows are scored each. Without a confirmed toxic row that may be
learned from, every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Labelled rows that training uses at most.
SAMPLE = 6000
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
#: Features in fewer texts of the sample are left out; steps, step size and L1 weight of training.
LEAST, STEPS, RATE, L1 = 3, 150, 0.1, 2e-4
#: Distinct words that a worker remembers.
MEMO = 300_000
_BREAKS = str.maketrans(dict.fromkeys("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", " "))


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(_BREAKS).split())


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its first four and five letters."""
    w = word.encode()
    found = [zlib.crc32(b"=" + w)]
    if len(word) > 4:
        found += [zlib.crc32(b"4" + word[:4].encode()), zlib.crc32(b"5" + word[:5].encode())]
    return tuple(found)


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    shift: float
    scale: float

    def scores(self, texts: list[str | None], memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        weights, sums = self.weights, []
        if not self.scale:
            return np.zeros(len(texts))
        for text in texts:
            active: set[int] = set()
            for word in words_of(text):
                hit = memo.get(word)
                if hit is None:
                    hit = memo[word] = tuple(f for f in features_of(word) if f in weights)
                if hit:
                    active.update(hit)
            if len(memo) > MEMO:
                memo.clear()
            sums.append(sum(weights[f] for f in sorted(active)))
        margin = self.scale * (np.array(sums, float) + self.bias - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def active_of(text: str | None) -> np.ndarray:
    """The sorted distinct features of a text."""
    return np.unique(np.fromiter((f for w in words_of(text) for f in features_of(w)), np.uint32))


def slopes(g: np.ndarray, to_p: np.ndarray, to_u: np.ndarray, prior: float) -> np.ndarray:
    """The derivative of the risk by each text's margin g, turned round where the part of the clean is negative.
    to_p and to_u are a text's shares of the means over P and U."""
    up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # the slope of the loss of calling it clean
    clean = float(to_u @ np.logaddexp(0, g) - prior * (to_p @ np.logaddexp(0, g)))
    slope = to_u * up - prior * to_p * up
    return prior * to_p * (up - 1) + slope if clean >= 0 else -slope


def train(texts: list[str | None], toxic: np.ndarray, **how) -> Model:
    """Fits a model; toxic marks the confirmed examples."""
    return train_features([active_of(text) for text in texts], toxic, **how)


def train_features(rows: list[np.ndarray], toxic: np.ndarray, least: int = LEAST, steps: int = STEPS, seed: int = 7) -> Model:
    """Fits a model to the features of texts."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any():
        return Model({}, 0.0, 0.0, 0.0)
    total = len(rows)
    hashes, owner = np.concatenate(rows), np.repeat(np.arange(total, dtype=np.int32), [len(f) for f in rows])
    names, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    kept = counts >= min(least, max(1, int(toxic.sum()) // 4))
    number = np.cumsum(kept) - 1
    use = kept[column]
    names, column, owner = names[kept], number[column[use]], owner[use]
    inner = np.random.default_rng(seed).random(total) < 0.2
    if toxic[inner].sum() < 10 or toxic[~inner].sum() < 10:
        inner[:] = False
    positive, unlabelled = toxic & ~inner, ~inner
    prior = positive.sum() / unlabelled.sum()
    to_p, to_u = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())
    w, bias = np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def margins() -> np.ndarray:
        return np.bincount(owner, w[column], total) + bias

    for t in range(1, steps + 1):
        slope = slopes(margins(), to_p, to_u, prior)
        d, db = np.bincount(column, slope[owner], len(names)), slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d, 0.9 * mb + 0.1 * db, 0.99 * vb + 0.01 * db * db
        size = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w = w - size * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - size * L1, 0)
        bias -= RATE * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    g = margins()
    judge = inner if inner.any() else np.ones(total, bool)
    p, u = np.sort(g[judge & toxic]), np.sort(g[judge])
    cuts = np.unique(u)
    recall = 1 - np.searchsorted(p, cuts) / len(p)
    share = 1 - np.searchsorted(u, cuts) / len(u)
    best = int(np.argmax(recall**2 / share))
    low = cuts[best - 1] if best else cuts[best] - 1
    shift = (low + cuts[best]) / 2
    spread = max(float(np.median(p)) - shift, shift - float(np.median(u)), 1e-6)
    active = np.flatnonzero(w)
    return Model({int(names[k]): float(w[k]) for k in active}, float(bias), float(shift), 6 / spread)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on at most ``sample`` labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most sample rows of 12 bytes: safe to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.max("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [active_of(text.as_py()).tobytes() for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["id", "toxic", "found"])

    small_batches(docs.sparkSession)
    rows = rows.select("_id", F.col("_toxic").cast("long"), "_text").mapInArrow(run, "id long, toxic long, found binary")
    # Texts stay where they are: the driver gets four bytes for each distinct feature of a row, partition by partition.
    pairs = [(np.frombuffer(r["found"], np.uint32), r["toxic"]) for r in rows.orderBy("id").toLocalIterator()]
    return train_features([f for f, _ in pairs], np.array([x > 0 for _, x in pairs], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            s = shared.value.scores(batch.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay, nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            keep = shared.value.scores(batch.column(place).to_pylist(), memo) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
