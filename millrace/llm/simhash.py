"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints that are equal form one class; only classes are compared. Two 64-bit fingerprints that
differ in at most d bits agree on one of d + 1 disjoint parts, so each class goes to d + 1 buckets. A
bucket that holds more than HOT classes is split again, exactly, by the same argument on the bits
that are left, up to three levels; what three levels leave open bounds a bucket's size.

In a bucket, classes are sorted by Gray rank, so that neighbours differ in few bits. Groups of
neighbours share the bits they all agree on: those move to an upper node as a masked pattern, level
by level. A search goes down pairs of nodes, adds the differences of the bits that become known at
each level, and drops a pair, with all below it, once they exceed d.

A bucket returns a star for each of its local components rather than all pairs; components over all
buckets are found by graph.components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, small_batches, written

#: Classes of a bucket beyond which it is split; children of an index node; shingles hashed and node pairs compared at once.
HOT, FAN, SHINGLES, PAIRS = 20_000, 8, 100_000, 400_000
#: Texts of which frequent shingles are counted; shingles of a chunk of texts that are sent at once; of a block of texts that are compared in memory.
SAMPLE, CHUNK, BLOCK = 4000, 2_000_000, 1_000_000
SEED = 42


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """A fingerprint of each text: bit k is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    import xxhash

    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lens = np.array([len(x) for x in held])
            np.add.at(counts, owners, np.add.reduceat(bits, np.cumsum(lens) - lens, axis=0, dtype=np.int64))
        held, owners, size = [], [], 0

    for k, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z alone and splits at 0x20 and 0x09-0x0D
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        ends = (ends - 1).tolist()
        starts, ends = (starts[: 1 - width], ends[width - 1 :]) if len(words) >= width > 1 else (starts, ends) if width == 1 else ([0], [len(joined)])
        totals[k] = len(starts)
        for a in range(0, len(starts), SHINGLES):
            part = [joined[i:j] for i, j in zip(starts[a : a + SHINGLES], ends[a : a + SHINGLES])]
            held.append(np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part)))
            owners.append(k)
            size += len(part)
            if size >= SHINGLES:
                flush()
    flush()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits, signed) of every row; a null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def parts_of(distance: int, levels: int = 3) -> list[list[int]]:
    """Bucket masks by level: each mask of a level fixes one more part of the bits its parent left open."""
    found: list[list[int]] = []
    masks = [0]
    for _ in range(levels):
        below = []
        for mask in masks:
            rest = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(rest) * i // (distance + 1) for i in range(distance + 2)]
            below += [mask | sum(1 << b for b in rest[i:j]) for i, j in zip(cuts, cuts[1:])]
        found.append(below)
        masks = below
    return found


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def linked(bucket: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join what is within distance in the same bucket: a star for each local component."""
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, pattern = bucket[order], fp[order]
    n = len(order)
    levels = [(pattern, np.full(n, ~np.uint64(0)), np.arange(n), np.ones(n, np.int64))]
    owner = bucket
    while len(owner) and (owner[1:] == owner[:-1]).any():
        begin = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        heads = np.flatnonzero(place % FAN == 0)
        below, known = levels[-1][:2]
        both, any_ = np.bitwise_and.reduceat(below, heads), np.bitwise_or.reduceat(below, heads)
        mask = np.bitwise_and.reduceat(known, heads) & ~(both ^ any_)
        levels.append((both & mask, mask, heads, np.diff(np.append(heads, len(owner)))))
        owner = owner[heads]
    label = np.arange(n)
    top = np.arange(len(owner))
    stack = [(len(levels) - 1, top, top, np.zeros(len(top), np.int64))]
    while stack:
        level, a, b, far = stack.pop()
        if level == 0:
            i, j = a, b
            while len(i):
                i, j = label[i], label[j]
                apart = i != j
                i, j = i[apart], j[apart]
                np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
                while (label != label[label]).any():
                    label = label[label]
            continue
        _, mask, first, size = levels[level]
        pat, low, *_ = levels[level - 1]
        room = np.cumsum(size[a] * size[b])
        cut = max(1, int(np.searchsorted(room, PAIRS)))
        if cut < len(a):
            stack.append((level, a[cut:], b[cut:], far[cut:]))
            a, b, far = a[:cut], b[:cut], far[:cut]
        each = size[a] * size[b]
        pair = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, y = first[a[pair]] + k // size[b[pair]], first[b[pair]] + k % size[b[pair]]
        keep = (a[pair] != b[pair]) | ((x < y) if level == 1 else (x <= y))
        pair, x, y = pair[keep], x[keep], y[keep]
        fresh = low[x] & low[y] & ~(mask[a[pair]] & mask[b[pair]])
        sums = far[pair] + np.bitwise_count((pat[x] ^ pat[y]) & fresh)
        near = sums <= distance
        if near.any():
            stack.append((level - 1, x[near], y[near], sums[near]))
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def links(classes: DataFrame, distance: int) -> DataFrame:
    """classes: fp, rep, one row a fingerprint. Returns u, v: links between reps that connect all within distance."""
    edges = None
    rows, levels = classes, parts_of(distance)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    for level, masks in enumerate(levels):
        if level == 0:
            keys = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)])
            rows = rows.select("fp", "rep", F.inline(keys))
        else:
            mask_of = F.array(*[F.lit(signed(m)) for m in masks])
            below = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.col("path") * (distance + 1) + i)
            rows = rows.select("fp", "rep", F.explode(below).alias("path")).withColumn("value", F.col("fp").bitwiseAND(F.element_at(mask_of, F.col("path") + 1)))
        sizes = rows.groupBy("path", "value").agg(F.count("*").alias("size")).where("size > 1")
        last = level == len(levels) - 1
        sized = written(rows.join(sizes, ["path", "value"]), "buckets") if not last else rows.join(sizes, ["path", "value"])
        found = search(sized if last else sized.where(F.col("size") <= HOT), distance)
        edges = found if edges is None else edges.unionByName(found)
        if last or not (rows := sized.where(F.col("size") > HOT).select("fp", "rep", "path")).head(1):
            return edges
    return edges


def search(rows: DataFrame, distance: int) -> DataFrame:
    """The links within each bucket (path, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy() for c in ("path", "value", "fp", "rep")]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                if not len(held[0]):
                    continue
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            else:
                cut = 0 if held is None else len(held[0])
            if not cut:
                continue
            path, value, fp, rep = (x[:cut] for x in held)
            held = [x[cut:] for x in held]
            bucket = np.cumsum(np.concatenate(([0], (path[1:] != path[:-1]) | (value[1:] != value[:-1]))))
            i, j = linked(bucket, fp.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["u", "v"])

    near = rows.select("path", "value", "fp", "rep").repartition("path", "value").sortWithinPartitions("path", "value")
    return near.mapInArrow(run, "u long, v long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links), one row each of docs.

    Texts without words have fingerprint zero and link like any other; a null text has no words.
    Rows with a null id take part and never name a component (null where no other row is reachable).
    Repeated rows each get a row. An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = written(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # Fingerprints that rows without an id alone have: they may bridge others.
    lone = rows.where("doc_id is null").select("fp").distinct().join(classes, "fp", "left_anti").select("fp", F.lit(None).cast("long").alias("rep"))
    if lone.head(1):
        return _with_nameless(rows, classes, lone, distance)
    return _named(rows, classes, components(links(classes, distance)))


def _with_nameless(rows: DataFrame, classes: DataFrame, lone: DataFrame, distance: int) -> DataFrame:
    """As near_duplicates, over the fingerprints themselves as nodes; a component takes its smallest id afterwards."""
    both = written(classes.unionByName(lone), "classes")
    found = components(links(both.select("fp", F.col("fp").alias("rep")), distance))
    placed = both.join(found, both.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("node"))
    names = placed.groupBy("node").agg(F.min("rep").alias("name"))
    named = placed.join(names, "node").select("fp", F.col("name").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    placed = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by a checked similarity. A screen leaves the texts that could have a similar one; the SimHash index groups
# most copies among these; shared rare shingles lead to what it leaves apart. Whole sets of shingles decide, and no pair is lost.


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> tuple[int, np.ndarray]:
    """A signed 64-bit hash of a text's words in order, and the hash of each word."""
    import xxhash

    words = (text or "").encode().lower().split()
    node = xxhash.xxh3_64_intdigest(b" ".join(words))
    return node - (node >> 63 << 64), np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles (of fewer words: of the whole), from the words' hashes."""
    width = min(width, len(words))
    out = np.full(max(1, len(words) - width + 1), width + 1, np.uint64)
    for k in range(width):
        out = _mixed((out * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : len(words) - width + 1 + k])
    return np.unique(out)


def shingles_of(text: str | None, width: int) -> np.ndarray:
    return shingle_hashes(word_hashes(text)[1], width)


def word_fingerprint(words: np.ndarray, seed: int = 1) -> int:
    """A signed 64-bit fingerprint of the distinct words: a word counts once, however often it occurs."""
    single = np.unique(words)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(single), SHINGLES):
        h = _mixed(_mixed(single[a : a + SHINGLES] + np.uint64(seed)))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(single), bitorder="little").view(np.int64)[0])


def least_common(n, similarity: float):
    """How many of n shingles a text has in common with any that is similar."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


_CHUNK = "doc_id long, node long, chunk long, bucket int, owners binary, hashes binary"


def _chunked(rows: DataFrame, width: int, bits: int, wide: bool) -> DataFrame:
    """Three kinds of rows, from one pass over the texts. Without a bucket: doc_id and node of each row. In bucket -1: the
    nodes (hashes) and numbers of shingles (owners) of the distinct texts of a chunk of CHUNK shingles. In any other: the
    chunk's shingles in this bucket (hashes), text by text, and each one's text less that of the one before (owners)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _CHUNK.split(", ")]
    kept = np.uint32 if not wide else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        nodes: dict[int, None] = {}
        sets: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in sets], np.uint32)
            h = np.concatenate(sets)
            bucket = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            low = h if wide else (h >> np.uint64(32 - bits)).astype(np.uint32)
            low, owner = low[order].astype(kept), np.repeat(np.arange(len(sets)), sizes)[order]
            ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
            out = [(first + done, -1, sizes.tobytes(), np.array(list(nodes), np.int64).tobytes())]
            for b, (i, j) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
                if i < j:
                    out.append((first + done, b, np.diff(owner[i:j], prepend=0).astype(np.uint32).tobytes(), low[i:j].tobytes()))
            for a in range(0, len(out), 64):
                columns = list(zip(*out[a : a + 64]))
                none = [None] * len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((none, none, *columns), kinds)], names=names)

        for batch in batches:
            mine = []
            for text in batch.column(1):
                node, words = word_hashes(text.as_py())
                mine.append(node)
                if node not in nodes:
                    nodes[node] = None
                    sets.append(shingle_hashes(words, width))
                    size += len(sets[-1])
                if size >= CHUNK:
                    yield from close()
                    nodes, sets, size, done = {}, [], 0, done + 1
            none = [pa.nulls(len(mine), k) for k in kinds[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine, pa.int64()), *none], names=names)
        if sets:
            yield from close()

    return rows.mapInArrow(run, _CHUNK)


def screened(rows: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and node of each row; and the nodes of the texts of whose shingles so many occur in other texts (or in copies)
    that one could be similar. Shingles go to buckets by their hash, as blocks of bytes; a shingle is in a chunk's block once
    for each text of the chunk, and the number of buckets grows with the texts, so that no bucket is large."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6 + 1  # shingles, about
    bits = min(24, max(3, (total // CHUNK).bit_length()))
    wide = total >> (bits + 24) > 0  # else the hash's first 32 bits after the bucket's make few shingles the same
    kept = np.uint64 if wide else np.uint32
    chunks = written(_chunked(rows, width, bits, wide), "shingle-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            sizes = [len(h) for _, _, h in held]
            h = np.concatenate([h for _, _, h in held])
            order = np.argsort(h)
            same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
            shared = np.zeros(len(h), bool)
            shared[order[same]] = shared[order[same + 1]] = True
            found, at = [], 0
            for (_, owners, _), n in zip(held, sizes):
                text, many = np.unique(owners[shared[at : at + n]], return_counts=True)
                found.append(np.stack((text, many)).astype(np.uint32).tobytes())
                at += n
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()), pa.array(found, pa.binary())], names=["chunk", "owners"])

        for batch in batches:
            for k in range(batch.num_rows):
                if (b := batch.column(0)[k].as_py()) != now and held:
                    yield close()
                    held = []
                now = b
                held.append((batch.column(1)[k].as_py(), np.cumsum(np.frombuffer(batch.column(2)[k].as_py(), np.uint32), dtype=np.int64), np.frombuffer(batch.column(3)[k].as_py(), kept)))
        if held:
            yield close()

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, many, nodes, sizes = None, [], [], None, None
        for batch in _then_none(batches):
            for k in range(1 if batch is None else batch.num_rows):
                chunk = None if batch is None else batch.column(0)[k].as_py()
                if chunk != now and now is not None:
                    sums = np.bincount(np.concatenate(texts), np.concatenate(many), len(nodes)) if texts else np.zeros(len(nodes))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[sums >= least_common(sizes, similarity)])], names=["node"])
                    texts, many = [], []
                now = chunk
                if batch is None:
                    continue
                counts = np.frombuffer(batch.column(1)[k].as_py(), np.uint32)
                if (names := batch.column(2)[k].as_py()) is not None:
                    nodes, sizes = np.frombuffer(names, np.int64), counts
                else:
                    texts.append(counts[: len(counts) // 2])
                    many.append(counts[len(counts) // 2 :])

    blocks = chunks.where("bucket >= 0").select("bucket", "chunk", "owners", "hashes")
    shares = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "chunk long, owners binary").select("*", F.lit(None).cast("binary").alias("nodes"))
    heads = chunks.where("bucket = -1").select("chunk", "owners", F.col("hashes").alias("nodes"))
    both = shares.unionByName(heads).repartition("chunk").sortWithinPartitions("chunk")
    left = written(both.mapInArrow(total_of, "node long").distinct(), "screened")
    printed = written(chunks.where("bucket is null").select("doc_id", "node"), "word-prints")
    discard(chunks)
    return printed, left


def sets_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, fp, s: number and hashes of the shingles of each text asked for (_rep, an id of rows that has it; _node, its hash), once, and its words' fingerprint."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, node in zip(batch.column(0), batch.column(1).to_pylist()):
                mine, words = word_hashes(text.as_py())
                if mine == node:  # rows that share an id may hold other texts
                    s = shingle_hashes(words, width)
                    found.append((node, len(s), word_fingerprint(words), s.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["node", "n", "fp", "s"])

    texts = rows.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_rep")).select("text", "_node")
    return written(texts.mapInArrow(shingle, "node long, n int, fp long, s binary").dropDuplicates(["node"]), "shingles")


def merged(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> np.ndarray:
    """A label of each text: texts of a group, and those joined by similar sets, share one. Exact: each text that ends outside
    the largest label is compared with all others, those that share most first, so that one original soon joins its copies."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by = owner[np.argsort(token, kind="stable")]
    often = np.bincount(token)
    ends = np.cumsum(often)
    begins = ends - often
    first = np.cumsum(size) - size
    label = np.unique(group, return_inverse=True)[1]
    order = np.argsort(-np.bincount(owner, often[token], n), kind="stable")
    left = np.ones(n, bool)
    while True:
        rest = order[left[order] & (label[order] != np.argmax(np.bincount(label)))]
        if not len(rest):
            return label
        k = rest[0]
        left[k] = False
        own = token[first[k] : first[k] + size[k]]
        own = own[often[own] > 1]
        both = np.zeros(n, np.int64)
        reach = np.cumsum(often[own])
        for part in np.split(own, np.flatnonzero(np.diff(reach // PAIRS)) + 1):
            if len(part):
                both += np.bincount(by[np.repeat(begins[part] - np.cumsum(often[part]) + often[part], often[part]) + np.arange(often[part].sum())], minlength=n)
        near = (both >= similarity * (size[k] + size - both)) & (label != label[k])
        if near.any():
            label[np.isin(label, label[near])] = label[k]


def confirmed(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """members: node, group, part. u, v: links that join, in each part, the texts of a group and the similar ones.

    A part is cut into blocks of BLOCK shingles, and each two of its blocks meet in one row of a shuffle."""
    sized = sets.select("node", "n").join(members, "node")
    ahead = Window.partitionBy("part").orderBy("group", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(sized.withColumn("block", F.floor(F.sum("n").over(ahead) / BLOCK)), "blocks")
    last = placed.groupBy("part").agg(F.max("block").alias("last"), F.count("*").alias("texts")).where("texts > 1")
    other = placed.join(last, "part").select("node", "group", "part", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("with"))
    tasks = other.select("node", "group", "part", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, group, held = None, [], [], []
        for batch in _then_none(batches):
            for k in range(1 if batch is None else batch.num_rows):
                now = None if batch is None else tuple(batch.column(c)[k].as_py() for c in range(3))
                if now != key and held:
                    label = merged(held, np.array(group), similarity)
                    _, at = np.unique(label, return_index=True)
                    names = np.array(node)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[at[np.searchsorted(label[at], label)]])], names=["u", "v"])
                    node, group, held = [], [], []
                if batch is not None:
                    key = now
                    node.append(batch.column(3)[k].as_py())
                    group.append(batch.column(4)[k].as_py())
                    held.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))

    near = tasks.join(sets, "node").select("part", "i", "j", "node", "group", "s").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    return near.mapInArrow(run, "u long, v long").where("u <> v")


def by_fingerprint(sets: DataFrame, distance: int, similarity: float) -> DataFrame:
    """node, group: similar texts among those that fingerprints within ``distance`` connect. Equal fingerprints are one entry of the index."""
    first = F.min("node").over(Window.partitionBy("fp"))
    held = written(sets.select("node", "fp", first.alias("rep")), "prints")
    near = links(held.where("node = rep").select("fp", "rep"), distance)
    parts = components(near.unionByName(held.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))))
    members = parts.select("node", F.col("node").alias("group"), F.col("component").alias("part"))
    groups = components(confirmed(sets, members, similarity))
    return written(held.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group")), "groups")


def frequent(sets: DataFrame) -> np.ndarray:
    """Shingles, sorted, that over a hundredth of a sample of SAMPLE texts hold: they come last in prefixes, which spares a
    task for each and changes no result. Each text of the sample adds at most a hundredth of its shingles to the list's bound."""
    sample = sets.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_buffer(), np.int64))], names=["h"])

    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("held")).where(F.col("held") > SAMPLE // 100).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64))


def by_shingles(sets: DataFrame, grouped: DataFrame, similarity: float) -> DataFrame:
    """node, group, part: the texts of different groups that share one of their rarest shingles, and what these connect.

    Of a text's n shingles a similar one lacks at most n - least_common(n). All that no other text holds are among those;
    so, in an order in which rare ones come first, is not the whole of the next so many: two similar texts share one of them."""
    common = sets.sparkSession.sparkContext.broadcast(frequent(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, group, s in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3)):
                h = np.frombuffer(s.as_buffer(), np.int64)
                usual = np.isin(h, common.value)
                columns = [pa.array(h), *[pa.array(np.full(n, x)) for x in (node, group)], pa.array(np.full(n, n, np.int32)), pa.array(usual)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "node", "group", "n", "usual"])

    entries = sets.join(grouped, "node").select("node", "n", "group", "s").mapInArrow(spread, "h long, node long, group long, n int, usual boolean")
    entries = written(entries, "entries")
    held = entries.where("not usual").withColumn("held", F.count("*").over(Window.partitionBy("h"))).where("held > 1").drop("usual")
    usual = entries.where("usual").drop("usual").withColumn("held", F.lit((1 << 62)).cast("long"))
    own = Window.partitionBy("node")
    ranked = held.unionByName(usual).withColumn("m", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy("held", "h")))
    need = F.ceil(F.col("n") * similarity - 1e-9)
    met = written(ranked.where(F.col("k") <= F.col("m") - need + 1).select("h", "node", "group"), "prefixes")
    discard(entries)
    several = met.groupBy("h").agg(F.min("group").alias("one"), F.max("group").alias("other")).where("one <> other").select("h", "one")
    shared = written(met.join(several, "h").select("node", "group", "one").distinct(), "meetings")
    parts = components(shared.select(F.col("group").alias("u"), F.col("one").alias("v")))
    return shared.select("node", "group").distinct().join(parts, parts.node == shared.group).select(shared.node, "group", F.col("component").alias("part"))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id, one row each of docs: texts of equal words, or linked by a Jaccard similarity of their
    shingles of at least this, are one component, named by its smallest doc_id. No such link is missed.

    Texts of which enough shingles occur elsewhere are indexed by the fingerprint of their distinct words; those that
    ``distance`` bits connect are compared. Then texts of different groups that share one of their rarest shingles are.
    A null text has no words, as an empty one; texts of fewer words than ``width`` have one shingle. Repeated rows each get
    a row. An empty table gives no rows. Other columns are not read. Rows with a null id must be left out before.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    printed, left = screened(rows, width, similarity)
    classes = written(printed.groupBy("node").agg(F.min("doc_id").alias("rep")), "text-classes")
    wanted = written(classes.join(left, "node", "left_semi").select(F.col("rep").alias("_rep"), F.col("node").alias("_node")), "wanted")
    sets = sets_of(rows, wanted, width)
    grouped = by_fingerprint(sets, distance, similarity)
    members = written(by_shingles(sets, grouped, similarity), "members")
    edges = confirmed(sets, members, similarity).unionByName(grouped.select(F.col("node").alias("u"), F.col("group").alias("v")))
    groups = components(edges)
    placed = written(classes.join(groups, "node").select("node", "rep", F.col("component").alias("group")), "placed")
    discard(sets)
    first = placed.groupBy("group").agg(F.min("rep").alias("first"))
    named = classes.join(placed.join(first, "group").select("node", "first"), "node", "left").select("node", F.coalesce("first", "rep").alias("component_id"))
    return printed.join(named, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component that similar(), with these parameters, finds: the one with the smallest id (of rows that share it, the first by a hash of the text). All columns stay.

    Rows with a null id can't be told apart by it: one of each text stays, whatever it resembles.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found = similar(named, id_col=id_col, text_col=text_col, **how)
    # Ids whose rows don't just stay: those of other members, and those that several rows have.
    marked = found.groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_first"), F.count("*").alias("_rows"))
    marked = written(marked.where("_first <> _id or _rows > 1"), "marked")
    # Hashed to the texts by id at every size: the list grows with the corpus, so it isn't broadcast, and texts aren't sorted.
    out = named.join(marked.select("_id").hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("_id"), "left_anti")
    again = marked.where("_first = _id").select("_id")
    if again.head(1):
        rows = named.join(again.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("_id"), "left_semi")
        first = Window.partitionBy(id_col).orderBy(F.md5(text_col), F.to_json(F.struct(*docs.columns)))
        out = out.unionByName(rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place"))
    nameless = docs.where(F.col(id_col).isNull())
    if nameless.head(1):
        out = out.unionByName(nameless.dropDuplicates([text_col]))
    return out
