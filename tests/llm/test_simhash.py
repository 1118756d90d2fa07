"""op2 against hashing word by word and comparing every pair."""

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.graph import components


def slow_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(fps, distance=2):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if label[i] != label[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= distance:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def planted(rnd, n):
    base = rnd.integers(0, 1 << 63, n // 6, dtype=np.uint64)
    out = list(base)
    while len(out) < n:
        x = int(out[rnd.integers(len(out))])
        for _ in range(rnd.integers(0, 5)):
            x ^= 1 << int(rnd.integers(64))
        out.append(x)
    return np.array(out, np.uint64)


def rep_of(n, i, j):
    label = np.arange(n)
    for _ in range(n):
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_links_of_a_bucket(seed):
    fps = np.unique(planted(np.random.default_rng(seed), 300))
    i, j = simhash.linked(np.zeros(len(fps), np.int64), fps, 2)
    assert rep_of(len(fps), i, j) == slow_components(fps)


def test_index_keeps_buckets_apart():
    fps = np.array([1, 3, 1, 3, 7, 1 << 40], np.uint64)
    i, j = simhash.linked(np.array([0, 0, 1, 2, 2, 2]), fps, 2)
    assert sorted(map(tuple, map(sorted, zip(i.tolist(), j.tolist())))) == [(0, 1), (3, 4)]


def test_fingerprints():
    texts = ["", None, "One", "one TWO", "a b c d e f g", " \t\n", "É é É x\x0by", "long " * 999 + "end", "x y z w"]
    assert simhash.fingerprints_of(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_parts_agree_for_any_two_flips():
    for level in simhash.parts_of(2):
        for a, b in [(0, 63), (5, 6), (21, 42), (30, 50)]:
            assert any(not m >> a & 1 and not m >> b & 1 for m in level)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(vocab, 40)) for _ in range(25)]
    for _ in range(60):
        words = texts[rnd.integers(len(texts))].split()
        words[rnd.integers(len(words))] = "w0"
        texts.append(" ".join(words))
    texts += ["", None, "  "] + ["same text here now"] * 5
    rows = [(int(k) + 100, t) for k, t in enumerate(texts)][::-1] + [(None, texts[0]), (100, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as rep")
    fps = [slow_fingerprint(t) for t in texts]
    want = {k + 100: (f"{fps[k]:016x}", c + 100) for k, c in enumerate(slow_components(fps))}
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == want[100 if r.doc_id is None else r.doc_id]


def exact(texts, width=5, least=0.8):
    """Components by index: all pairs of sets of shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in words]
    i, j = [], []
    for a in range(len(texts)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                i.append(a)
                j.append(b)
    return rep_of(len(texts), np.array(i, int), np.array(j, int))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_similar(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 4000, 80)) for _ in range(15)]
    for _ in range(50):
        words = texts[rnd.integers(len(texts))].split()
        for _ in range(rnd.integers(0, 3)):
            words[rnd.integers(len(words))] = f"new{rnd.integers(99)}"
        texts.append(" ".join(words))
    texts += ["", None, " \n", "two words", "words two", "Two  WORDS"]
    rows = [(int(k) + 100, t) for k, t in enumerate(texts)][::-1] + [(100, texts[0]), (101, "another text under a used id"), (None, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as rep", "3 as _rows")
    label = exact(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar(df.where("doc_id <> 101")).collect()}
    want = {k + 100: c + 100 for k, c in enumerate(exact([t for k, t in enumerate(texts) if k != 1]))}
    assert len(set(label)) < len(texts) - 20
    shift = lambda i: i if i == 100 else i + 1  # noqa: E731  (without row 101)
    assert got == {shift(i): shift(c) for i, c in want.items()}
    kept = simhash.deduplicated(df)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == df.columns and len(ids) == len(set(ids)) and set(ids) >= {k + 100 for k, c in enumerate(label) if k == c and k != 1}
    assert kept.where("doc_id is null").count() == 1


def test_nameless_rows_bridge(spark):
    a, b = slow_fingerprint("a b c"), slow_fingerprint("d e f")
    df = spark.createDataFrame([(None, "a b c"), (3, "d e f"), (9, "d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert (a ^ b).bit_count() > 2 and got == {(None, None), (3, 3), (9, 3)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == simhash.deduplicated(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (100, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_similar_finds_appended_passages(spark):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 9000, rnd.integers(90, 160))) for _ in range(40)]
    for k in range(40):
        words, new = texts[k].split(), [f"n{x}" for x in rnd.integers(0, 9000, rnd.integers(10, 28))]
        at = [0, len(words), len(words) // 2][k % 3]
        texts.append(" ".join(words[:at] + new + words[at:]))
    want = exact(texts)
    assert len(set(want)) < 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("block", [1_000_000, 60_000])
def test_similar_joins_a_star(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = np.random.default_rng(4)
    origin = [f"w{k}" for k in range(400)]
    texts = [" ".join(origin)]
    for n in range(1000):
        words = origin.copy()
        for k in rnd.choice(400, 8, replace=False):
            words[k] = f"c{n}x{k}"
        texts.append(" ".join(words))
    texts += ["a b c d e f", " ".join(origin[:300])]
    sets = [simhash.shingles_of(t, 5) for t in texts]
    near = [len(np.intersect1d(s, sets[0])) >= 0.8 * len(np.union1d(s, sets[0])) for s in sets]
    assert sum(near) > 990
    ids = [(1500 - k if k else 2000, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(ids, "doc_id long, text string")).collect()}
    assert len({got[i] for (i, _), n in zip(ids, near) if n}) == 1


def test_merged_is_exact():
    rnd = np.random.default_rng(6)
    sets = [np.sort(rnd.choice(60, rnd.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(150)]
    i, j = zip(*[(a, b) for a in range(150) for b in range(150) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))])
    want = rep_of(150, np.array(i), np.array(j))
    label = simhash.merged(sets, np.arange(150), 0.6)
    assert len(set(want)) == len(set(zip(want, label.tolist()))) == len(set(label.tolist())) < 150


def test_dense_group_of_one_vocabulary(spark):
    """Texts of the same words in other orders: the words' fingerprints can't tell which are similar."""
    rnd = np.random.default_rng(11)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(rnd.permutation(words)) for _ in range(150)]
    for k in range(40):
        w = texts[k].split()
        at = int(rnd.integers(20, 100))
        texts.append(" ".join([*w[:at], w[at + 1], w[at], *w[at + 2 :]]))
    want = exact(texts)
    assert len(set(want)) == 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("chunk, block, sample", [(2_000_000, 1_000_000, 4000), (500, 900, 40), (1, 1, 1)])
def test_shared_passages(spark, monkeypatch, chunk, block, sample):
    """Passages that many texts share, texts made of these alone, and texts on both sides of the similarity asked for."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rnd = np.random.default_rng(12)
    new = lambda n: [f"w{k}" for k in rnd.integers(0, 3000, n)]
    passages = [new(60) for _ in range(4)]
    texts = [" ".join([*new(rnd.integers(10, 80)), *passages[k % 4], *new(rnd.integers(0, 40))]) for k in range(90)]
    texts += [" ".join(passages[a] + passages[b]) for a in range(4) for b in range(4)] + [" ".join(p) for p in passages] * 2
    for k in range(60):
        w = texts[int(rnd.integers(90))].split()
        for _ in range(rnd.integers(1, 6)):
            w[rnd.integers(len(w))] = "edited"
        texts.append(" ".join(w[: int(len(w) * rnd.uniform(0.8, 1))]))
    want = exact(texts)
    assert 90 < len(set(want)) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == dict(enumerate(want))


def test_many_texts_of_one_fingerprint(spark):
    """All of the same words, so of one fingerprint: one entry of the index, whatever their number."""
    words = [f"w{k}" for k in range(40)]
    rnd = np.random.default_rng(13)
    texts = [(k, " ".join(rnd.permutation(words))) for k in range(3000)]
    got = simhash.similar(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got.where("doc_id = component_id").count() == 3000
