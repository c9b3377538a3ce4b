import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from portcullis.llm import mixing as M


def shares(words, weights=(5, 2, 1), share=1.5, most=2.0):
    """Excess over the bound is shared again, round by round."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = share * sum(words.values()), set(names)
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += rest * w[s] / total
        for s in list(open_):
            if target[s] >= most * words[s]:
                over += target[s] - most * words[s]
                target[s] = most * words[s]
                open_.discard(s)
        rest = over
    return target


def rows(rng):
    out = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "Ω", "c", None, "zz", "", "d"])
        n = rng.choice([0, 1, 3, 5, 9, 40, 40, 40, rng.randint(1, 300)])
        out.append((i, source, " ".join(["w x"] * n) if n else rng.choice([None, "", " \n"])))
    return out + [(5000, "long", "w " * 50000), (None, "a", "x y"), (6001, "a", "x y"), (6001, "a", "x y")]


def test_targets_and_taken(spark, monkeypatch):
    given = rows(random.Random(4))
    docs = spark.createDataFrame(given, "doc_id long, source string, text string").repartition(4)
    monkeypatch.setattr(M, "SLICE", 16)
    out = M.mix(docs.withColumn("id", F.lit(1)).withColumn("n", F.lit(1))).collect()
    assert len(out) == len(given)
    words, longest, by = defaultdict(int), defaultdict(int), defaultdict(list)
    for d, s, t in given:
        n = len((t or "").split(" ")) if t and t.strip() else 0
        n = len([x for x in (t or "").split() if x]) if " " not in (t or "") else n
        words[s] += n
        longest[s] = max(longest[s], n)
        by[d].append(s)
    want = shares(words)
    taken = defaultdict(int)
    for r in out:
        s = by[r.doc_id][0]
        assert r.source_size == words[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in words:
        assert abs(taken[s] - want[s]) <= max(0.5 * longest[s], 1e-6), s
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_rates_are_the_tilted_ones(spark):
    """The dual variables solve the token constraints: against a bisection on one machine."""
    rng = np.random.default_rng(1)
    sizes = {s: rng.integers(1, 200, 50) for s in "pqr"}
    cells = spark.createDataFrame([(s, int(z), int(c)) for s in sizes for z, c in zip(*np.unique(sizes[s], return_counts=True), strict=True)],
                                  "source string, size long, n long")
    want = {"p": 0.3, "q": 1.4, "r": 1.9}
    wanted = spark.createDataFrame([(s, int(sizes[s].sum()), 50, float(want[s] * sizes[s].sum())) for s in sizes],
                                   "source string, words long, docs long, target double")
    got = {r.source: r for r in M.balance(cells, wanted).collect()}
    for s, z in sizes.items():
        x = z / z.mean()
        lo, hi = -500.0, 500.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (z * np.minimum(2, np.exp(np.minimum(mid * x, 50)))).sum() < want[s] * z.sum() else (lo, mid)
        assert abs(got[s].dual - lo) < 1e-5 * max(1, abs(lo))


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    assert [tuple(r) for r in M.mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).collect()] == [(1, 0, 0, 0.0, 0, 0)]


def test_repeated_keeps_the_bound_for_ids_of_several_sizes(spark):
    """Rows of one id, or of none, that differ in size or source each take their own copies."""
    given = [(1, "a", "x " * 3), (1, "a", "x " * 7), (1, "b", "y " * 3), (2, "b", "z " * 5), *[(None, "a", "n " * k) for k in range(1, 12)]]
    docs = spark.createDataFrame(given, "doc_id long, source string, text string")
    plan = defaultdict(int)
    for r in M._planned(docs, "doc_id", "source", "text").collect():
        plan[r.id, r.source, r.size] += r.copies
    got = defaultdict(int)
    for r in M.repeated(docs).collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert max(got.values()) <= M.MOST and got == {k: n for k, n in plan.items() if n}
    again = defaultdict(int)
    for r in M.repeated(docs.union(spark.createDataFrame([(1, "b", "v " * 3)], docs.schema))).collect():
        again[r.doc_id, r.source, len(r.text.split())] += 1
    assert all(n <= M.MOST * (2 if k == (1, "b", 3) else 1) for k, n in again.items())
