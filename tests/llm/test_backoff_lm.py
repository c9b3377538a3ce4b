import math
import random
import re
import zlib
from collections import Counter

import pytest

from portcullis.llm import backoff_lm as L
from portcullis.llm.common import crc_rest


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]


def brute(rows, order, mu):
    learn = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = Counter()
    for _, t in learn:
        w = ["<s>", *tokens(t)]
        c.update((x,) for x in w)
        for k in (2, 3):
            c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    n = sum(v for g, v in c.items() if len(g) == 1 and g != ("<s>",))
    v = len([g for g in c if len(g) == 1 and g != ("<s>",)])

    def p(h, w):
        if not h:
            return (c[w,] + 1) / (n + v + 1)
        m = mu[len(h) - 1]
        return (c[h + (w,)] + m * p(h[1:], w)) / (c[h] + m)
    out = []
    for d, t in rows:
        w = ["<s>", *tokens(t)]
        s = sum(math.log10(p(tuple(w[max(0, i - order + 1):i]), w[i])) for i in range(1, len(w)))
        b = sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w[1:])
        out.append((d, (d, t) in learn, len(w) - 1, sum(c[x,] > 0 for x in w[1:]), n, b, s))
    return out


@pytest.mark.parametrize(("order", "chunk"), [(3, 600_000), (3, 300), (2, 300)])
def test_equals_brute_force(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "B", "the", "é", *[f"w{j}" for j in range(i % 40)]]) for _ in range(rng.choice([0, 1, 2, 3, 25]))))
            for i in range(200)]
    rows += [(7, None), (8, ""), (9, "rare " * 3000), (9, "rare " * 3000), (None, "the the the"), (14, " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS id", "2 AS training")
    got = L.score(docs, crc_rest("doc_id", 7) != 2, order=order).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, order, L.MU), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), (g, w)


def test_empty_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(none, crc_rest("doc_id", 7) != 2).count() == 0
    two = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = L.score(spark.createDataFrame([(two, "x y")], "doc_id long, text string"), crc_rest("doc_id", 7) != 2).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_query_scores_with_contexts_of_two_words(spark, tmp_path):
    """The registered query has the model of three words, whatever turns its ranges are asked in."""
    from portcullis.llm.queries import QUERIES
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(12))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op3_backoff_automaton"](spark, str(tmp_path)).collect()}
    for w in brute(rows, 3, L.MU):
        assert math.isclose(got[w[0]], w[6], rel_tol=1e-9), w
