"""op4 and op9, against plain Python on small tables."""

import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import linededup, mixing


def slow_lines(rows, ratio, least):
    totals, seen = {}, {}
    for _, host, text in rows:
        totals[host] = totals.get(host, 0) + 1
        for line in {x.strip(" \t\r") for x in text.split("\n")} if text is not None else ():
            if line:
                seen[host, line] = seen.get((host, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * totals[k[0]]}
    return [(i, h, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in bad)) for i, h, t in rows]


def key(row):
    return str(tuple(row))


def test_line_dedup(spark):
    rnd = random.Random(2)
    lines = ["menu", " menu\t", "", "foot", "rare one", "x" * 5000] + [f"line {k}" for k in range(30)]
    rows = [(i, rnd.choice(["a", "b", None, ""]), "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for i in range(300)]
    rows += [(1, "a", None), (None, "a", "menu"), (2, "lone", "menu\nmenu"), (3, "a", "menu\nfoot"), (3, "a", "menu\nfoot")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as line", "2 as host", "3 as n")
    for ratio, least in [(0.05, 5), (0.2, 1), (0.0, 40)]:
        out = linededup.without_boilerplate(df, ratio, least)
        assert out.columns == df.columns
        assert sorted(map(key, out.select("doc_id", "source", "text").collect())) == sorted(map(key, slow_lines(rows, ratio, least)))
    assert linededup.without_boilerplate(df.limit(0)).count() == 0
    plan = linededup.without_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_share(budget, kids):
    """kids: (cap, weight). Water-filling by repeated passes."""
    share, open_ = [0.0] * len(kids), {i for i, (c, w) in enumerate(kids) if w > 0}
    left = budget
    while open_:
        total = sum(kids[i][1] for i in open_)
        full = {i for i in open_ if kids[i][0] <= left * kids[i][1] / total + 1e-9}
        if not full:
            for i in open_:
                share[i] = left * kids[i][1] / total
            break
        for i in full:
            share[i] = kids[i][0]
        left -= sum(kids[i][0] for i in full)
        open_ -= full
    return share


def slow_mix(rows, weights, fraction, epochs, seed):
    depths = len(weights)
    tokens = {r: len([w for w in (r[1 + depths] or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for r in rows}
    total = sum(tokens[r] for r in rows)

    def down(members, depth, budget):
        if depth == depths:
            t = sum(tokens[r] for r in members)
            target = int(round(budget, 4))
            whole = min(target // t, epochs) if t else 0
            rest = target - whole * t if whole < epochs else -1
            name = lambda r: "null" if r[0] is None else str(r[0])
            place = lambda r: (hashlib.md5(f"{seed}:{whole}:{name(r)}".encode()).hexdigest(), name(r))
            return [(r, whole + int(rest >= 0 and sum(tokens[x] for x in members if place(x) <= place(r)) <= rest)) for r in members]
        kids = {}
        for r in members:
            kids.setdefault(r[1 + depth], []).append(r)
        names = list(kids)
        give = slow_share(budget, [(sum(tokens[r] for r in kids[k]) * epochs, weights[depth].get(k, 1)) for k in names])
        none = [(r, 0) for k in names if weights[depth].get(k, 1) <= 0 for r in kids[k]]  # weight 0: nothing, not even empty texts
        return none + [x for k, g in zip(names, give) if weights[depth].get(k, 1) > 0 for x in down(kids[k], depth + 1, g)]

    return down(rows, 0, min(total * fraction, total * epochs))


def test_mixing(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["s0"] * 6 + ["s1", "s2", None]), " ".join(["w"] * rnd.randint(0, 30))) for i in range(400)]
    rows += [(500 + i, "fr", "s9", "a b") for i in range(3)] + [(7, "en", "s0", "a\tb\nc"), (8, "en", "s0", None), (None, "de", "s1", "x y"), (900, "zero", "s0", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").selectExpr("*", "5 as tokens", "6 as id", "7 as target")
    given = {"lang": {"en": 2.0, "de": 1.0, "fr": 5.0}, "source": {"s1": 3.0, "s2": 0.0}}
    for fraction, epochs, bucket in [(0.5, 1, 4096), (0.6, 2, 4), (1.7, 2, 4), (9.0, 2, 16), (0.0, 1, 4096)]:
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        got = mixing.copies(df, {"lang": F.col("lang"), "source": F.col("source")}, given, fraction, epochs, 3)
        want = slow_mix(rows, [given["lang"], given["source"]], fraction, epochs, 3)
        assert sorted(map(key, got.select("doc_id", "lang", "source", "text", "_mx_copies").collect())) == sorted(key((*r, n)) for r, n in want)
        mixed = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, given, fraction=fraction, epochs=epochs, seed=3)
        assert mixed.columns == df.columns and mixed.count() == sum(n for _, n in want)
    assert mixing.mix(df.limit(0), {"lang": F.col("lang")}, {}).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10, 1), ("a", "y", 100, 1), ("b", "z", 1000, 1)], "lang string, source string, tokens long, rows long")
    got = {r.source: r.target for r in mixing.budgets(leaves, ["lang", "source"], {}, 160 / 1110, 1).collect()}
    assert got == {"x": 10, "y": 70, "z": 80}
    got = {r.source: r.target for r in mixing.budgets(leaves, ["lang", "source"], {}, 400 / 1110, 1).collect()}
    assert got == {"x": 10, "y": 100, "z": 290}
