"""Media columns: chroma fingerprints of audio, and the alignment of recordings by them.

Samples are cut into overlapping frames; the power spectrum of each is folded into twelve pitch
classes, smoothed over five frames and scaled to length 1. Sixteen filters compare sums over
rectangles of that picture, taken from its integral image; each difference becomes two Gray-coded
bits, so every frame that a full window follows gives one 32-bit item.

Two recordings are compared if they share at least SHARE of the distinct items of the one asked for.
To find such pairs, only its rarest items are looked up and counted: a recording with that many shared
items holds a known number of them (so items of silence or noise that most recordings hold needn't be
joined), and only pairs with that number get their whole fingerprints. Such a pair
is aligned at the offset at which most equal items meet (a histogram of offsets, over all equal items),
and matches if there at most ERRORS of the bits differ over at least LEAST items.

Recordings with equal fingerprints (by 128 bits of hash) are one class, named by its smallest id;
only classes are compared. One shorter than a window has no items: it matches nothing, and those with
equal samples are one class. Nulls: a null recording has no samples. One with fewer than LEAST distinct
items matches its own class alone. A long recording is transformed FRAMES frames at a time.
Rows with a null id belong to classes but don't name one that has an id. Repeated rows each get a row.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Frames of a window; the least share of common items; the greatest share of differing bits; items that an alignment needs;
#: the share of items that is looked up beyond those of which a match holds one.
WIDTH, SHARE, ERRORS, LEAST, MORE = 16, 0.25, 0.15, 8, 0.1
#: Frames that are transformed at once.
FRAMES = 4096
#: (kind, first pitch class, pitch classes, frames, centre, step): kinds as in filtered(); a difference's code tells whether it lies
#: below centre - step, below centre, below centre + step, or above. Set so that all codes are usual in tunes and in noise.
FILTERS = [
    (0, 0, 12, 16, 0.0, 0.02), (1, 0, 6, 8, -0.03, 0.3), (1, 6, 6, 8, 0.13, 0.3), (2, 0, 4, 16, 0.0, 0.15), (2, 4, 4, 16, 0.0, 0.15), (2, 8, 4, 16, 0.0, 0.15),
    (3, 0, 12, 4, 0.0, 0.09), (3, 2, 8, 12, 0.0, 0.14), (4, 0, 6, 16, -0.35, 0.1), (4, 6, 6, 16, -0.35, 0.1), (5, 0, 9, 6, 0.0, 0.3), (5, 3, 9, 6, -0.02, 0.3),
    (1, 3, 3, 4, -0.52, 0.25), (2, 1, 10, 6, 0.0, 0.05), (3, 5, 6, 8, 0.0, 0.15), (5, 0, 12, 15, 0.14, 0.22),
]


def samples(data: bytes | None, encoding: str) -> np.ndarray:
    """Mono samples in [-1, 1]: 'u8', or 's16' (little-endian; an odd last byte is left out)."""
    data = data or b""
    if encoding == "u8":
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if encoding == "s16":
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
    raise ValueError(f"unknown encoding {encoding}")


def folding(rate: float, frame: int) -> np.ndarray:
    """(bins, 12): the pitch class of each bin from 28 Hz up, counted from A."""
    freq = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(freq), 12), np.float32)
    heard = np.flatnonzero((freq >= 28) & (freq <= 3520))
    octave = np.log2(freq[heard] / 27.5)
    out[heard, np.minimum((12 * (octave - np.floor(octave))).astype(int), 11)] = 1
    return out


def chroma(x: np.ndarray, frame: int, hop: int, fold: np.ndarray) -> np.ndarray:
    """(frames, 12) of length 1 each, or 0 for silence."""
    if len(x) < frame:
        return np.zeros((0, 12), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    shape = np.hanning(frame).astype(np.float32)
    parts = [(np.abs(np.fft.rfft(views[a : a + FRAMES] * shape, axis=1)) ** 2).astype(np.float32) @ fold for a in range(0, len(views), FRAMES)]
    raw = np.concatenate(parts)
    tall = np.pad(raw, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(w * tall[k : k + len(raw)] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0).astype(np.float32)


def items_of(picture: np.ndarray) -> np.ndarray:
    """One 32-bit item for each frame that a full window follows."""
    n = len(picture) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(picture) + 1, 13))
    whole[1:, 1:] = picture.astype(np.float64).cumsum(0).cumsum(1)

    def area(t0: int, p0: int, t1: int, p1: int) -> np.ndarray:
        return whole[t1 : t1 + n, p1] - whole[t0 : t0 + n, p1] - whole[t1 : t1 + n, p0] + whole[t0 : t0 + n, p0]

    def filtered(kind: int, p: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        full = area(0, p, w, p + h)
        if kind == 0:  # the rectangle against the frames after the first half of the window
            return full, 2 * area(WIDTH // 2, p, WIDTH, p + h)
        if kind == 1:  # lower half of the pitch classes against the upper
            a = area(0, p, w, p + h // 2)
        elif kind == 2:  # earlier half against the later
            a = area(0, p, w // 2, p + h)
        elif kind == 3:  # quarters crosswise
            a = area(0, p, w // 2, p + h // 2) + area(w // 2, p + h // 2, w, p + h)
        elif kind == 4:  # middle third of the frames against the outer ones
            a = 1.5 * area(w // 3, p, 2 * w // 3, p + h)
            return a, full - a / 1.5
        else:  # middle third of the pitch classes against the outer ones
            a = 2 * area(0, p + h // 3, w, p + 2 * h // 3)
            return a, full - a / 2
        return a, full - a

    out = np.zeros(n, np.uint32)
    for kind, p, h, w, centre, step in FILTERS:
        a, b = filtered(kind, p, h, w)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)) - centre
        level = (value >= -step).astype(np.uint32) + (value >= 0) + (value >= step)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out.astype(np.uint32)


def fingerprints(recordings: DataFrame, encoding: str = "s16", rate: float = 11025, frame: int = 4096, hop: int = 1365, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """id, items (array of int, the 32 bits of each) and brief (the samples, where there are no items) of every row; audio: mono samples as binary."""
    small_batches(recordings.sparkSession)
    fold = folding(rate, frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heard = [samples(x, encoding) for x in batch.column(1).to_pylist()]
            found = [items_of(chroma(x, frame, hop, fold)).view(np.int32) for x in heard]
            brief = pa.array([None if len(f) else x.tobytes() for x, f in zip(heard, found)], pa.binary())
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), items, brief], names=["id", "items", "brief"])

    return recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(run, "id long, items array<int>, brief binary")


def offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many equal items meet at each offset; entry k is offset k - len(a) + 1 of b's place less a's."""
    hist = np.zeros(len(a) + len(b) - 1, np.int64)
    values = np.intersect1d(a, b)
    ia, ib = np.flatnonzero(np.isin(a, values)), np.flatnonzero(np.isin(b, values))
    ia, ib = ia[np.argsort(a[ia], kind="stable")], ib[np.argsort(b[ib], kind="stable")]
    ea, eb = np.searchsorted(a[ia], values, "right"), np.searchsorted(b[ib], values, "right")
    for k in range(len(values)):
        pa_, pb = ia[ea[k - 1] if k else 0 : ea[k]], ib[eb[k - 1] if k else 0 : eb[k]]
        if len(pa_) * len(pb) <= 16 * len(hist):
            np.add.at(hist, (pb[None, :] - pa_[:, None] + len(a) - 1).ravel(), 1)
        else:  # the same counts by a convolution, where an item fills much of both
            x, y = np.zeros(len(a)), np.zeros(len(b))
            x[len(a) - 1 - pa_], y[pb] = 1, 1
            size = 1 << (len(hist) - 1).bit_length()
            hist += np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: len(hist)]).astype(np.int64)
    return hist


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """offset, overlap and differing bits at the offset of most equal items (ties: least shift, then earlier)."""
    hist = offsets(a, b)
    best = np.flatnonzero(hist == hist.max()) - len(a) + 1
    off = int(best[np.lexsort((best, np.abs(best)))[0]])
    x, y = a[max(0, -off) :], b[max(0, off) :]
    n = min(len(x), len(y))
    return off, n, int(np.bitwise_count(x[:n] ^ y[:n]).sum())


def search(prints: DataFrame, every: int = 100) -> DataFrame:
    """prints: id, items, brief, in a table that may be read again. One row each: id, n_items, class_id, matches.

    matches is null but for rows whose id is divisible by ``every``; there it holds (class_id, offset,
    overlap, bit_errors) of each other class that matches, by class_id.
    """
    keyed = prints.withColumns({"ka": F.xxhash64("items", "brief"), "kb": F.xxhash64(F.lit("items"), "items", "brief")})
    asked = F.coalesce(F.col("id") % every == 0, F.lit(False))
    classes = written(keyed.where("id is not null").groupBy("ka", "kb").agg(F.min("id").alias("class_id"), F.max(asked).alias("asked"), F.first("items").alias("items")), "media-classes")
    single = classes.select("class_id", "asked", F.explode(F.array_distinct("items")).alias("item"))
    common = single.groupBy("item").agg(F.count("*").alias("held"))
    own = single.where("asked").select("class_id", "item").join(common, "item")
    mine = Window.partitionBy("class_id")
    ranked = own.withColumn("n", F.count("*").over(mine)).withColumn("k", F.row_number().over(mine.orderBy("held", "item")))
    need = F.greatest(F.ceil(F.col("n") * SHARE), F.lit(1))
    more = F.least(F.floor(F.col("n") * MORE), need - 1)
    rare = ranked.where((F.col("n") >= LEAST) & (F.col("k") <= F.col("n") - need + 1 + more)).select(F.col("class_id").alias("q"), "item", (more + 1).alias("least"))
    pairs = rare.join(single.select("class_id", "item"), "item").where("class_id <> q").groupBy("q", "class_id", "least").agg(F.count("*").alias("both")).where("both >= least").select("q", "class_id")
    left = classes.select(F.col("class_id").alias("q"), F.col("items").alias("a"))
    both = pairs.join(left, "q").join(classes.select("class_id", F.col("items").alias("b")), "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].values.to_numpy().view(np.uint32) for c in ("a", "b"))
                mine = np.unique(a)
                if np.isin(mine, b).sum() < max(np.ceil(len(mine) * SHARE), 1):
                    continue
                off, n, errors = aligned(a, b)
                if n >= LEAST and errors <= ERRORS * 32 * n:
                    rows.append((batch.column("q")[r].as_py(), batch.column("class_id")[r].as_py(), off, n, errors))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["q", "class_id", "offset", "overlap", "bit_errors"])

    found = both.select("q", "class_id", "a", "b").mapInArrow(run, "q long, class_id long, offset long, overlap long, bit_errors long")
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("class_id", "offset", "overlap", "bit_errors"))).alias("matches"))
    named = classes.select("ka", "kb", "class_id").join(lists, F.col("q") == F.col("class_id"), "left").select("ka", "kb", "class_id", "matches")
    rows = keyed.select("id", "ka", "kb", F.size("items").cast("long").alias("n_items")).join(named, ["ka", "kb"], "left")
    none = F.lit(None).cast("array<struct<class_id:bigint,offset:bigint,overlap:bigint,bit_errors:bigint>>")
    return rows.select("id", "n_items", F.coalesce("class_id", "id").alias("class_id"), F.when(asked, F.coalesce("matches", F.array().cast("array<struct<class_id:bigint,offset:bigint,overlap:bigint,bit_errors:bigint>>"))).otherwise(none).alias("matches"))
