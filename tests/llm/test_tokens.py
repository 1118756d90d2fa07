"""op1, op5 and op7 against the tokenizers library, text by text."""

import random
import zlib
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, tokencount, tokenfile
from millrace.llm.pieces import PieceEncoder, tokenizer_path

ODD = ["a", "B", "é", "É", "1", "٣", "½", " ", "  ", "\n", "\t", " ", " ", "'", "'s", "'RE", "'ll", "!", "...", "<|endoftext|>", "é", "İ", "Σ", "ς", "漢", "😀", "‍", "́", "\x1c", "\x85", "_", "'T", "ſ", "K", "ß", "ﬁ", "\x00"]
DOCS = [(3, "The cat's 12 mats.\n\nIt's"), (1, ""), (7, None), (2, "<|endoftext|> x"), (None, "né é"), (5, "word " * 3000), (5, "word " * 3000), (5, "other")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 as part", "'x' as n", "2 as ids")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", None, "x" * 5000]
    lib, enc = Tokenizer.from_file(tokenizer_path(name)), PieceEncoder(tokenizer_path(name))
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = [x.tolist() for _, sizes, flat in enc.encode(texts) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert enc.scheme != "whole" and got == want
    assert [int(n) for _, c in enc.count(texts) for n in c] == [len(x) for x in want]


def test_memo_generations(monkeypatch):
    from millrace.llm import pieces

    monkeypatch.setattr(pieces, "MEMO_PIECES", 40)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 50)
    texts = [f"w{i % 37} common x{i}" for i in range(200)]
    lib, enc = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    got = [x.tolist() for _, sizes, flat in enc.encode(texts) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [lib.encode(t).ids for t in texts]


def test_packing_is_whole(spark):
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = sorted((-1 if d is None else d, lib.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in DOCS)
    pieces = packing.pack(docs(spark).repartition(3), tokenizer_path("byte_bpe_50k.json"), 1, 64).cache()
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    place, made, parts = 0, [], {}
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(place, 64) and r.length > 0 and r.offset + r.length <= 64
        place += r.length
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length
        if r.start == 0:
            made.append((-1 if r.doc_id is None else r.doc_id, []))
        assert len(made[-1][1]) == r.start
        made[-1][1].extend(got)
    assert sorted(made) == ids
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert sum(r.length for r in whole.values()) == place and all(len(r.ids) == 4 * r.length for r in whole.values())


def test_token_files_round_trip(spark, tmp_path):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenfile.write(docs(spark).repartition(3), f"{tmp_path}/f", tokenizer_path("word_bpe_49k.json"), 2)
    rows = tokenfile.read(spark, f"{tmp_path}/f").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5, 5, 7]
    start = 0
    for r in rows:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted((-1 if d is None else d, crc(lib.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in DOCS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids)) for r in rows) == want


def test_code_of_every_width():
    rnd = np.random.default_rng(0)
    for ids in [np.arange(70000), rnd.integers(0, 300, 5001), np.array([], int), np.array([7]), np.array([5_000_000, 3, 3])]:
        ranks, control, data = tokenfile.encode_block(ids)
        assert (tokenfile.decode_block(len(ids), ranks, control, data) == ids).all()
        assert len(control) == -(-len(ids) // 4)


def test_counts(spark):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = tokencount.count_tokens(docs(spark), tokenizer_path("word_bpe_49k.json"), 2048).collect()
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in DOCS]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    path = tokenizer_path("word_bpe_49k.json")
    tokenfile.write(none, f"{tmp_path}/e", path, 2)
    assert packing.pack(none, path, 1).count() == tokencount.count_tokens(none, path).count() == tokenfile.read(spark, f"{tmp_path}/e").count() == 0
