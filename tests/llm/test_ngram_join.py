import random
import re

import pytest

from portcullis.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng, groups=12, hot=70):
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    common, rows = text(25), []
    for g in range(groups):
        base = text(rng.choice([3, 8, 40, 90]))
        for _ in range(hot if g == 0 else rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = common + w
            rows.append((" ".join(w).upper() if rng.random() < 0.1 else "\t".join(w)))
    rows += [" ".join(text(60)) for _ in range(60)] + [" ".join(common)] * 5
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = corpus(rng) + [(900001, None), (900000, ""), (900002, " \n\t"), (None, "lone row without id"), (None, "a b c d e f"), (5000, "A b\tc d e f"),
                          (5000, "A b\tc d e f"), (900003, "long " * 30000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for small in (32, 4):  # few and many large buckets
        monkeypatch.setattr(J, "SMALL_BUCKET", small)
        monkeypatch.setattr(J, "BLOCK", 256 if small == 32 else 16)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()), key=repr)
        assert got == brute(rows)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, k int, n int, token int, id int")
    assert J.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(1, "x", 1, 1)], "doc_id long, text string, k int, id int")
    assert [tuple(r) for r in J.near_duplicates(one).collect()] == [(1, 1, 1, 1)]


@pytest.mark.parametrize("small", [32, 4])
def test_all_links_are_counted(spark, monkeypatch, tmp_path, small):
    """The registered query gives each row the number of all different sets that link with its own."""
    from portcullis.llm.queries import QUERIES
    monkeypatch.setattr(J, "SMALL_BUCKET", small)
    monkeypatch.setattr(J, "BLOCK", 16)
    # one word changed at a time: many links, and pairs on both sides of the bound
    near = [(800000 + i, " ".join(f"n{j}" if j != i % 100 else f"x{i}" for j in range(150 if i % 3 else 118))) for i in range(80)]
    rows = [*corpus(random.Random(3), groups=4), *near, (900001, None), (900003, "a b c d e f"), (900004, "A b c d e f")]
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    every = set(sets.values())
    want = {s: sum(o != s and 4 * len(s & o) >= 3 * len(s | o) for o in every) for s in every}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_links for r in QUERIES["op2_ngram_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {d: want[s] for d, s in sets.items()} and max(got.values()) > 40
