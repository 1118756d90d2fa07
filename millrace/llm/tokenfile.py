"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

A block holds whole documents in ascending id order. In each block ids are replaced by their
frequency rank there (ties to the smaller id); a rank takes one to four bytes, little-endian, and the
lengths go, two bits each, to separate control bytes. So a block needs nothing but itself to be read:
doc_ids, lengths, ranks (rank -> id), control, data. Texts are tokenized where they lie, and their ids
(two bytes each where the vocabulary allows it) are what is shuffled by range and sorted. Blocks are
rows of Parquet files, so Spark's commit protocol and every Hadoop file system apply. Decoding looks
control bytes up in a table of 256 x 4 lengths and gathers the data with numpy.

Nulls: a null text counts as empty; a null id sorts first and is kept. Repeated rows are written as
often as they occur. An empty table gives no blocks. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import token_rows, with_bases
from .shared import discard, written

#: Ids after which a block ends, with the document in hand.
BLOCK_IDS = 2_000_000
#: Ids below this are counted in a table.
TABLE = 1 << 22
SCHEMA = "part int, block int, start long, n_ids long, n_docs long, doc_ids binary, known binary, lengths binary, ranks binary, control binary, data binary"
#: Byte lengths of four codes by control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranks, control and data of these ids."""
    if len(ids) and int(ids.max()) < TABLE:  # any vocabulary: counted and ranked by a table, without a sort of all ids
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        order = np.argsort(-counts[values], kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[values[order]] = np.arange(len(order))
        code = rank[ids]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[inverse]
    size = 1 + (code >= 1 << 8).astype(np.int64) + (code >= 1 << 16) + (code >= 1 << 24)
    control = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    control[: len(code)] = size - 1
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = (code[has] >> (8 * k)) & 255
    return values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(n: int, ranks: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids of a block, unsigned 32 bits."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    code = raw[at].astype(np.int64)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        code[has] |= raw[at[has] + k].astype(np.int64) << (8 * k)
    return np.frombuffer(ranks, "<u4")[code]


def blocks(tokens: DataFrame) -> DataFrame:
    """The blocks of all documents' ids, as packing.token_rows() gives them; part and block, in order, hold ascending ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, done = TaskContext.get().partitionId(), 0, 0
        names, lens, flats, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids, ranks, n = np.concatenate(flats), pa.concat_arrays(names), np.concatenate(lens)
            row = [part, block, done, len(ids), len(ranks), ranks.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(ranks.is_valid().to_numpy(zero_copy_only=False)).tobytes(), n.astype("<u4").tobytes(), *encode_block(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            n = batch.column(1).to_numpy()
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(BLOCK_IDS - held, n.sum(), BLOCK_IDS)) + 1, len(n)))
            for i, j in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist()):
                flats += [np.frombuffer(x.as_buffer(), f"<u{w}").astype(np.int32) for x, w in zip(batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i).to_pylist())]
                lens.append(n[i:j])
                names.append(batch.column(0).slice(i, j - i))
                held += int(n[i:j].sum())
                if held >= BLOCK_IDS:
                    yield close()
                    block, done, names, lens, flats, held = block + 1, done + held, [], [], [], 0
        if held:
            yield close()

    # Rows of one id (a repeated one may be most of a table) are told apart by a hash of their ids, and equal ones by their place.
    key = [F.col("doc_id"), F.xxhash64("ids"), F.col("part"), F.col("start")]
    ordered = tokens.repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.select("doc_id", "n", "ids", "width").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids, each document closed by end_id, as token files under path."""
    tokens = written(token_rows(docs, tokenizer, end_id, id_col, text_col), "tokens")
    blocks(tokens).write.option("compression", "zstd").parquet(path)
    discard(tokens)


def read(spark, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = decode_block(x["n_ids"], x["ranks"], x["control"], x["data"]).astype("<u4")
                n = np.frombuffer(x["lengths"], "<u4").astype(np.int64)
                valid = np.unpackbits(np.frombuffer(x["known"], np.uint8), count=x["n_docs"]).astype(bool)
                names = pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=~valid)
                stops = np.cumsum(n)
                for a in range(0, len(n), 1000):
                    b = min(a + 1000, len(n))
                    first, last = stops[a] - n[a], stops[b - 1]
                    offsets = np.concatenate(([0], stops[a:b] - first)) * 4
                    part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids[first:last]))])
                    yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(x["base"] + x["start"] + stops[a:b] - n[a:b]), pa.array(n[a:b]), part.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.schema(SCHEMA).parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    totals = files.select("part", "n_ids")
    rows = files.join(F.broadcast(bases_of(totals)), "part")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def bases_of(totals: DataFrame) -> DataFrame:
    """part and base, one row for each task that wrote blocks."""
    return with_bases(totals, "part", "n_ids", "base").groupBy("part").agg(F.max("base").alias("base"))
