"""op3, op8 and op10 against brute force and hand-made cases."""

import difflib
import random

import numpy as np
import pytest

from millrace.llm import ann, licenses, media
from millrace.llm.shared import written

NAN, INF = float("nan"), float("inf")


def exact(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % every == 0}):
        v = np.array(min(list(x) for i, x in good if i == q))
        out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q)[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as ids", "2 as x", "3 as score")


def test_nearest_edge_cases(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (100, rows[4][1]), (102, rows[3][1])]
    rows += [(200, None), (300, [0.0] * 8), (400, [NAN] * 8), (103, [INF] + [1.0] * 7), (104, [None] + [1.0] * 7), (None, [1.0] * 8), (500, [1.0] * 3), (105, [])]
    got = {}
    for r in ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == exact(rows)
    assert ann.nearest(vectors(spark, rows[:3])).count() == 2
    assert ann.nearest(vectors(spark, [])).count() == ann.nearest(vectors(spark, rows[1:3])).count() == ann.nearest(vectors(spark, rows[:1])).count() == 0


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERIES", 8)
    monkeypatch.setattr(ann, "RERANK", 20)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rnd.normal(size=8) * 0.4]) for i in range(3000)]
    got = {}
    for r in ann.nearest(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = exact(rows)
    hits = sum(len(set(got[q].values()) & {i for _, i in near}) for q, near in want.items())
    assert all(sorted(g) == list(range(1, 11)) for g in got.values()) and hits >= 0.9 * 10 * len(want)


def test_equal_distances_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = [(i, [1.0, float(i % 3), 0.0, 0.0, 2.0, 0.0, 0.0, 0.0]) for i in range(1, 60)] + [(100, [1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0]), (61, [1.0, 0.0] + [0.5] * 6)]
    got = {}
    for r in ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == exact(rows) and [i for _, i in got[100]] == list(range(1, 30, 3))


def test_anisotropic_codes_lose_less_along_the_vector():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(800, 64))
    model = ann.fit(x)

    def loss(codes):
        parts = model._cut(x)
        r = (parts - model.centres[np.arange(parts.shape[1]), codes]).reshape(len(x), -1)
        u = (x - model.mean) / np.linalg.norm(x - model.mean, axis=1, keepdims=True)
        return ((model.eta - 1) * (r * u).sum(1) ** 2 + (r**2).sum(1)).sum()

    assert model.eta > 1 and loss(model.encode(x, 2)) < loss(model.encode(x, 0))
    codes, q = model.encode(x), rnd.normal(size=(3, 64))
    scores = sum(model.tables(q)[:, j][:, ann.packed(codes)[:, j]] for j in range(16))
    centre = model.centres[np.arange(32), codes].reshape(len(x), -1)
    assert np.allclose(scores, (q - model.mean) @ centre.T, atol=1e-4)


def test_longest_rising_run():
    rnd = random.Random(0)
    for _ in range(50):
        p = rnd.sample(range(30), 12)
        k = licenses.rising(p)
        assert all(a < b and p[a] < p[b] for a, b in zip(k, k[1:]))
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max([best[j] for j in range(i) if p[j] < p[i]], default=0)
        assert len(k) == max(best)
    assert licenses.rising([]) == []


def test_align():
    a, b = "x the cat sat on the mat y".split(), "the cat sat on a mat".split()
    pairs = licenses.align(a, b)
    assert [a[i] for i, _ in pairs] == "the cat sat on mat".split() and all(a[i] == b[j] for i, j in pairs)
    words = licenses.words_of(licenses.TEMPLATES["MIT"])
    changed = ["new"] + words[:30] + ["extra", "words"] + words[33:]
    assert len(licenses.align(changed, words)) == sum(m.size for m in difflib.SequenceMatcher(None, changed, words, False).get_matching_blocks()) == len(words) - 3


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    texts = [
        "intro\n" + mit.upper() + "\nend",
        " ".join(words[:60] + ["changed"] * 4 + words[64:]),
        " ".join(words[: len(words) // 2]),
        ("filler mit license the " * 3000) + "Released under the MIT license! " + "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0. All rights reserved",
        "", None, "clean text without any of it", "license " * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 as matches")
    got = {}
    for r in licenses.best(licenses.scan(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and got[0][0].license == got[None][0].license == "MIT" and got[0][0].coverage == 1.0
    assert (got[0][0].first_word, got[0][0].matched) == (1, len(licenses.words_of(mit)))
    assert got[1][0].license == "MIT" and 0.95 < got[1][0].coverage < 1
    assert got[3][0].license == "MIT-line" and got[3][0].coverage == 1.0 and got[3][0].first_word == 12000
    assert got[4][0].licenses == "Apache-2.0-line,all-rights-reserved"
    assert all(got[k][0].license is None and got[k][0].licenses == "" for k in (2, 5, 6, 7, 8))
    assert licenses.scan(df.limit(0)).count() == 0


def slow_licenses(text, coverage=0.8):
    """Every template against the whole text, or, of a notice, against each stretch of the text."""
    words, found = licenses.words_of(text), {}
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words_of(template)
        slack = max(2, len(t) // 4)
        places = [(0, len(words))] if len(t) >= licenses.LINE else [(max(0, o - slack), o + len(t) + slack) for o in range(-len(t) - slack, len(words) + slack)]
        most = max(len(licenses.align(words[a:b], t)) for a, b in places)
        if most >= coverage * len(t):
            found[name] = most
    return found


def test_scan_loses_nothing():
    rnd = np.random.default_rng(2)
    filler = [f"w{k}" for k in range(500)]
    mit, texts = licenses.TEMPLATES["MIT"].split(), []
    for gap in (0, 30, 60, 100, 2000):
        at = len(mit) // 3
        texts.append(" ".join(["the software"] * 20 + mit[:at] + list(rnd.choice(filler, gap)) + mit[at:]))
    for name, template in licenses.TEMPLATES.items():
        for _ in range(12):
            words = template.split()
            for _ in range(rnd.integers(0, 1 + len(words) // 4)):
                at = int(rnd.integers(len(words)))
                words[at : at + int(rnd.integers(0, 2))] = list(rnd.choice(filler + ["license", "the", "under"], rnd.integers(0, 3)))
            texts.append(" ".join([*rnd.choice(filler, 30), *words, *rnd.choice(["the", "license", "of", "copyright"], 20), *template.split()[: int(rnd.integers(len(words) + 1))]]))
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    hits = 0
    for k, text in enumerate(texts):
        got = {m[0]: m[2] for m in scanner.scan(text)}
        for name, most in slow_licenses(text).items():
            assert got.get(name, 0) >= most, (k, name)
            hits += 1
        for name, share, matched, first, last in scanner.scan(text):
            assert share == matched / len(licenses.words_of(licenses.TEMPLATES[name])) >= 0.8 and first + matched - 1 <= last
    assert hits > 80
    for text in texts[:5]:
        assert ("MIT", 1.0) in [m[:2] for m in scanner.scan(text)]


def test_scan_of_the_table(spark):
    """Each template with each whole text of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: {m.license: m.matched for m in r.matches} for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        want = slow_licenses(r.text)
        assert all(got[r.doc_id].get(name, 0) >= most for name, most in want.items()) and set(want) <= set(got[r.doc_id])


RATE = 11025


def tune(seed, notes=60):
    rnd = np.random.default_rng(seed)
    t = np.arange(RATE // 4) / RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) * np.exp(-3 * t) for n in rnd.integers(0, 24, notes)]) * 0.5


def pcm(x):
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def brute(prints, every=100):
    classes = {}
    for i, items in prints:
        if items and i is not None:
            classes.setdefault(tuple(items), []).append(i)
    out = {}
    for a, ids in classes.items():
        if any(i % every == 0 for i in ids) and len(set(a)) >= media.LEAST:
            x, found = np.array(a, np.int32).view(np.uint32), []
            for b, others in classes.items():
                if b != a and len(set(a) & set(b)) >= max(1, np.ceil(len(set(a)) * media.SHARE)):
                    y = np.array(b, np.int32).view(np.uint32)
                    counts = {}
                    for p, q in [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]:
                        counts[q - p] = counts.get(q - p, 0) + 1
                    off = min(counts, key=lambda o: (-counts[o], abs(o), o))
                    pairs = [(p, p + off) for p in range(len(a)) if 0 <= p + off < len(b)]
                    errors = sum((int(x[p]) ^ int(y[q])).bit_count() for p, q in pairs)
                    if len(pairs) >= media.LEAST and errors <= media.ERRORS * 32 * len(pairs):
                        found.append((min(others), off, len(pairs), errors))
            out[min(ids)] = sorted(found)
    return classes, out


def test_recordings_are_aligned(spark):
    noise = np.random.default_rng(9)
    one, two = tune(1), tune(2)
    rows = [(100, pcm(one)), (7, pcm(one)), (8, pcm(one + noise.normal(0, 0.02, len(one)))), (9, pcm(np.concatenate([two[: 1365 * 9], one]))), (200, pcm(two)), (10, pcm(np.zeros(60000)))]
    rows += [(300, None), (301, b""), (302, pcm(one[:9000])), (303, pcm(one[:9000])), (304, pcm(one[:9001])), (400, pcm(np.zeros(60000))), (None, pcm(two)), (11, pcm(np.zeros(90000))), (100, pcm(one))]
    df = spark.createDataFrame(rows, "id long, audio binary").selectExpr("*", "1 as items", "2 as q")
    prints = written(media.fingerprints(df), "prints")
    got = media.search(prints).collect()
    assert len(got) == len(rows)
    classes, want = brute([(r.id, r["items"]) for r in prints.collect()])
    by = {r.id: r for r in got}
    assert by[100].class_id == by[7].class_id == 7 and by[None].class_id == 200 and by[400].class_id == 10 and by[300].class_id == 300
    assert [by[i].class_id for i in (301, 302, 303, 304)] == [300, 302, 302, 304] and by[300].matches == []
    assert {m.class_id for m in by[100].matches} >= {8, 9} and next(m for m in by[100].matches if m.class_id == 9).offset == 9
    for r in got:
        if r.id is not None and r.id % 100 == 0:
            assert [tuple(m) for m in r.matches] == want.get(r.class_id, [])
        else:
            assert r.matches is None
    assert media.search(written(media.fingerprints(df.limit(0)), "prints")).count() == 0


@pytest.mark.parametrize("sizes", [(50, 70, 3), (400, 500, 1), (300, 5, 2)])
def test_offset_histogram(sizes):
    rnd = np.random.default_rng(3)
    a, b = (rnd.integers(0, sizes[2], n).astype(np.uint32) for n in sizes[:2])
    want = [int(sum(a[p] == b[p + o] for p in range(len(a)) if 0 <= p + o < len(b))) for o in range(1 - len(a), len(b))]
    assert media.offsets(a, b).tolist() == want
