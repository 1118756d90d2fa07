"""The pipeline against a brute-force version of each of its stages."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import toxicity
from millrace.llm.pieces import tokenizer_path
from millrace.llm.queries import MIXTURE

from .test_native import slow_lines, slow_mix
from .test_simhash import exact

WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "mer", "nor", "pa") for b in ("ta", "kin", "sol", "ra", "ven", "dor")]


def fixture(spark, path):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(5, 80))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), "vileword")
        text = " ".join(words) + ("\nshare this page" if rnd.random() < 0.5 else "") + rnd.choice(["", "\n" + " ".join(words[:3])])
        rows.append((i, text, rnd.choice(["en", "en", "de", "fr"]), rnd.choice(["src0", "src0", "src0", "src1", "src2", "other"]), len(text)))
        if rnd.random() < 0.7:
            labels.append((i, 1, toxic))
    rows += [(200 + k, rows[k][1], "en", "src0", 0) for k in range(30)] + [(300, None, None, None, None), (301, "", "en", "src1", 0), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, {i: t for i, _, t in labels}


def domain(source):
    tail = (source or "")[len((source or "").rstrip("0123456789")) :]
    return f"d{int(tail) % 4}" if tail else "other"


def slow_pipeline(rows, labels):
    by_id = {r[0]: r[1] for r in rows}
    known = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.train([by_id[i] for i in known], np.array([labels[i] for i in known]))
    scores = model.scores([r[1] for r in rows], {})
    stages = [[r for r, s in zip(rows, scores) if s < 0.7]]
    cut = slow_lines([(k, r[3], r[1]) for k, r in enumerate(stages[-1])], 0.05, 5)
    stages.append([(r[0], t, *r[2:]) for r, (_, _, t) in zip(stages[-1], cut)])
    unique = sorted(set(stages[-1]), key=lambda r: r[0])
    label = exact([r[1] for r in unique])
    stages.append([r for k, r in enumerate(unique) if label[k] == k])
    given = [MIXTURE["weights"]["domain"], MIXTURE["weights"]["lang"], {}]
    tree = [(r[0], domain(r[3]), r[2], r[3], r[1]) for r in stages[-1]]
    times = {r[0]: n for r, n in slow_mix(tree, given, MIXTURE["fraction"], MIXTURE["epochs"], MIXTURE["seed"])}
    stages.append([r for r in stages[-1] for _ in range(times[r[0]])])
    return stages


def test_pipeline(spark, tmp_path):
    rows, labels = fixture(spark, tmp_path)
    want = slow_pipeline(rows, labels)
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    before = len(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = sorted(map(tuple, docs.collect()), key=str)
        assert got == sorted(want[k], key=str), name
        assert name == "line_dedup" or len(got) < before
        before = len(got)
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokens = [len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want[3]]
    for pieces in (corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))):
        got = pieces.collect()
        assert sum(r.length for r in got) == sum(tokens) and sorted(r.doc_tokens for r in got if r.start == 0) == sorted(tokens)
        assert max(r.sequence_id for r in got) == (sum(tokens) - 1) // 2048
