"""op6: held-out accuracy on planted texts, and the defined edge cases."""

import math
import random
import zlib

import numpy as np

from millrace.llm import toxicity

CLEAN = ["river", "stone", "window", "garden", "letter", "market", "silver", "morning", "paper", "bridge"]
BAD = ["vileword", "nastyword", "grimword"]


def corpus(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(CLEAN) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randint(3, 60))]
        toxic = int(rnd.random() < 0.15)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (5000, ""), (5001, None), (3, "garden")], "doc_id long, text string").selectExpr("*", "9 as score", "'x' as held_out")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 2] + [(None, 1), (8, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 904
    truth = {i: t for i, _, t in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    assert all(not r.predicted for r in got if r.doc_id in (None, 5000, 5001))
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - r.predicted for r in got)


def test_held_out_labels_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows]
    a = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a == b


def test_risk_is_kept_non_negative():
    texts = [f"word{i} filler" for i in range(60)]
    model = toxicity.train(texts + ["vileword filler"] * 12, np.array([False] * 60 + [True] * 12))
    s = model.scores(["vileword here", "filler", ""], {})
    assert s[0] >= 0.7 > s[1] and s[2] < 0.7


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [(0.0, 0)]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_all_words_of_long_texts_are_learned_from():
    bad = max((f"vile{k}" for k in range(5000)), key=lambda w: zlib.crc32(w.encode()))
    long = [f"w{k}" for k in range(5000)]
    assert sum(zlib.crc32(w.encode()) < zlib.crc32(bad.encode()) for w in long) > 4500
    texts = [" ".join(long + [bad] * (k % 3 == 0)) for k in range(60)]
    toxic = np.arange(60) % 3 == 0
    scores = toxicity.train(texts, toxic).scores(texts, {})
    assert ((scores >= toxicity.THRESHOLD) == toxic).all()


def test_gradient_is_that_of_the_risk():
    """Against the risk written out text by text, and its finite differences by each weight."""
    rnd = np.random.default_rng(1)
    x = (rnd.random((14, 6)) < 0.4).astype(float)
    toxic = np.array([1] * 4 + [0] * 10, bool)
    prior, to_p, to_u = 0.7, toxic / 4, np.ones(14) / 14

    def parts(w):
        p = u = n = 0.0
        for row, bad in zip(x, toxic):
            g = sum(a * b for a, b in zip(row, w))
            u += math.log1p(math.exp(g)) / 14
            if bad:
                p += math.log1p(math.exp(-g)) / 4
                n += math.log1p(math.exp(g)) / 4
        return prior * p, u - prior * n

    seen = set()
    for scale in (0.1, 1, 6):
        for _ in range(12):
            w = rnd.normal(size=6) * scale
            w += scale * np.array([2.0, -1, 0, 0, 0, 0]) * rnd.integers(-3, 4)
            positive, clean = parts(w)
            seen.add(clean >= 0)
            got = x.T @ toxicity.slopes(x @ w, to_p, to_u, prior)
            for k in range(6):
                up, down = (parts(w + s * 1e-6 * np.eye(6)[k]) for s in (1, -1))
                want = (up[0] + up[1] - down[0] - down[1]) if clean >= 0 else -(up[1] - down[1])
                assert abs(got[k] - want / 2e-6) < 1e-5
    assert seen == {True, False}


def test_scores_word_by_word():
    rows = corpus(300)
    model = toxicity.train([t for _, t, _ in rows], np.array([bad for _, _, bad in rows], bool))
    for text in [t for _, t, _ in rows[:40]] + ["", None, "Vileword! GARDENS", "garden " * 50_000]:
        words = {w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()}
        active = {zlib.crc32(b"=" + w.encode()) for w in words} | {zlib.crc32(f"{n}{w[:n]}".encode()) for w in words if len(w) > 4 for n in (4, 5)}
        margin = model.scale * (sum(model.weights.get(f, 0.0) for f in active) + model.bias - model.shift) + math.log(0.7 / 0.3)
        assert abs(model.scores([text], {})[0] - 1 / (1 + math.exp(-max(-30, min(30, margin))))) < 1e-9
