"""Packing: concatenate all documents' ids and cut the stream into fixed windows.

Two passes. The first tokenizes each document once and writes its ids, with its position in its
partition, to the shared folder; partition totals give, by prefix sum, the place of each partition
in the one global stream. The second cuts every document where the stream crosses a multiple of the
window and returns the boundary records. No sort and no shuffle of ids; each partition is on its own.

Nulls: a null text counts as empty (its end id alone); a null id is kept. Repeated rows are packed as
often as they occur. An empty table gives no pieces. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import encoder, spans
from .shared import small_batches, written

#: Bytes of ids that go back to the JVM in one Arrow batch, a longer document apart.
OUT_BYTES = 4 << 20


def with_bases(rows: DataFrame, part: str, size: str, base: str) -> DataFrame:
    """Adds what all partitions before a row's own hold. The broadcast side has one row for each task of the stage that wrote rows."""
    totals = rows.groupBy(part).agg(F.sum(size).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias(base))
    return rows.join(F.broadcast(bases), part)


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and its end id: doc_id, part, start (ids before it in its partition), n, ids (unsigned 16 or 32 bits)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        narrow = max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            at = 0
            for texts, sizes, flat in enc.encode(batch.column(1).to_pylist()):
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype(np.uint16 if narrow else np.uint32)
                sizes, k = sizes + 1, len(texts)
                stops = np.cumsum(sizes)
                offsets = np.concatenate(([0], stops)).astype(np.int64) * flat.itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), pa.array(np.full(k, part, np.int32)), pa.array(done + stops - sizes), pa.array(sizes), ids.cast(pa.binary()), pa.array(np.full(k, flat.itemsize, np.int32))],
                    names=["doc_id", "part", "start", "n", "ids", "width"],
                )
                done += int(stops[-1])
                at += k

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, start long, n long, ids binary, width int")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start (ids of its document before it), length, ids (unsigned 32 bits each), doc_tokens, sequence_id, offset.

    All sequences but the last are full, so padding is at most window - 1 ids in all.
    """
    if window < 1:
        raise ValueError("window must be positive")
    rows = with_bases(written(token_rows(docs, tokenizer, end_id, id_col, text_col), "pack-ids"), "part", "n", "base")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            n = batch.column("n").to_numpy()
            place = batch.column("start").to_numpy() + batch.column("base").to_numpy()
            first, last = place // window, (place + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            seq = spans(first, last - first + 1)
            begin = np.maximum(place[row], seq * window)
            length = np.minimum(place[row] + n[row], (seq + 1) * window) - begin
            width = batch.column("width").to_numpy()
            data, out, size, since = batch.column("ids"), [], 0, 0
            for k in range(len(row)):
                r, a = row[k], int(begin[k] - place[row[k]])
                if k == 0 or row[k - 1] != r:
                    ids = np.frombuffer(data[int(r)].as_buffer(), np.uint16 if width[r] == 2 else np.uint32)
                out.append(ids[a : a + length[k]].astype("<u4").tobytes())
                size += len(out[-1])
                if size > OUT_BYTES or k == len(row) - 1:
                    part = slice(since, k + 1)
                    arrays = [batch.column("doc_id").take(pa.array(row[part])), *(pa.array(x[part]) for x in (begin - place[row], length)), pa.array(out, pa.binary()), *(pa.array(x[part]) for x in (n[row], seq, begin - seq * window))]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    out, size, since = [], 0, k + 1

    return rows.select("doc_id", "start", "n", "ids", "width", "base").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (unsigned 32 bits each) of at most a window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
