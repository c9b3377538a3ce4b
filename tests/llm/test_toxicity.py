import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis.llm import toxicity as T


def plain(p, x):
    """One window's logit, word by word, in double precision."""
    H, sig = T.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(x), 2 * H))
    for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        h = np.zeros(H)
        for t in order:
            g, u = x[t] @ p[f"in{d}"] + p[f"bias{d}"], h @ p[f"again{d}"]
            z, r = sig(g[:H] + u[:H]), sig(g[H:2 * H] + u[H:2 * H])
            h = (1 - z) * h + z * np.tanh(g[2 * H:] + r * u[2 * H:])
            states[t, d * H:(d + 1) * H] = h
    e = np.tanh(states @ p["attend"] + p["attend_b"]) @ p["focus"]
    w = np.exp(e - e.max())
    return float((w / w.sum()) @ states @ p["out"] + p["out_b"][0])


def embedded(p, w):
    marked = b"\x02" + w + b"\x03"
    bucket, grams, _ = T.word_inputs([w])
    assert len(grams) == len(marked) - 2
    return np.concatenate([p["word"][bucket[0]], p["gram"][grams].mean(0)])


def test_worst_window_matches_a_plain_network():
    rng = random.Random(2)
    net = T.Network.fresh(5)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = ["a", "you", "ÉÇ", "x9", *[f"word{i}" for i in range(40)]]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 5, 23, 24, 25, 36, 37, 100)] + [None, "", " !?"]
    got = T.logits(net, texts)
    for t, g in zip(texts, got, strict=True):
        ws = T.words(t)
        windows = [ws] if len(ws) <= T.WINDOW else [ws[s:s + T.WINDOW] for s in sorted({*range(0, len(ws) - T.WINDOW + 1, T.STRIDE), len(ws) - T.WINDOW})]
        want = max((plain(p, np.stack([embedded(p, w) for w in ws])) for ws in windows if ws), default=-np.inf)
        assert g == pytest.approx(want, abs=2e-4)


def test_pieces_of_long_texts_give_the_same(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randint(0, 400)}" for _ in range(24 * 40 + 7))
    net = T.Network.fresh(6)
    whole = T.logits(net, [text, "x"])
    monkeypatch.setattr(T, "PIECE", 48)
    monkeypatch.setattr(T, "BLOCK", 3)
    # pieces begin at multiples of the stride, so they have the same windows and some more at their ends
    assert (T.logits(net, [text, "x"]) >= whole - 1e-5).all()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = T.Network.fresh(7)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    distinct = T.word_inputs([b"ab", b"cde", b"f", b"ghijk", b"lm"])
    ids = rng.integers(0, 5, (6, T.WINDOW))
    ids[4, 9:] = -1
    keep, y = np.ones((5, 1)), np.array([0, 1, 0, 1, 1, 0.0])
    loss = lambda: float(np.sum(np.logaddexp(0, v := net.forward(ids, net.gates(net.inputs(distinct, keep)))) - y * v))  # noqa: F841
    x, trace = net.inputs(distinct, keep), []
    logit = net.forward(ids, net.gates(x), trace)
    grad = net.backward(ids, x, distinct, keep, trace, T._sigmoid(logit) - y)
    for name, g in grad.items():
        flat, at = net.p[name].reshape(-1), int(np.argmax(np.abs(g)))
        old, step = flat[at], 1e-3
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert g.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name


def corpus(n):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("an", "be", "co", "du", "el") for b in ("ra", "ti", "mo", "se", "lu", "na")] + ["the", "of"]
    def text(i):
        ws = [rng.choice(words) for _ in range(rng.choice([6, 30, 90, 250]))]
        if i % 4 == 0:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = "zloq" + rng.choice(["", "a", "ur", "eti", "onda"])
        return " ".join(ws)
    return [(i, text(i)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    noisy = labels.withColumn("toxic", F.when(F.col("doc_id") % 41 == 3, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    out = {r.id: r.score for r in T.score(docs, T.fit(docs, noisy)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(out[i] >= 0.5) == (i % 4 == 0) for i in held]
    assert sum(right) >= 0.93 * len(held)
    toxic, clean = [out[i] for i in held if i % 4 == 0], [out[i] for i in held if i % 4]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc >= 0.97


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "a b c " * 30000, 3.0), (3, "a b", 3.0), (None, "x", 4.0)],
                                 "doc_id long, text string, score double").selectExpr("*", "1 AS id", "'t' AS t", "2 AS _text", "3 AS _order", "4 AS _label")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(docs, T.fit(docs, none)).collect()] == [0.0] * 5
    some = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    out = T.score(docs, T.fit(docs, some)).collect()
    assert [r.id for r in out] == [1, 2, 3, 3, None] and all(0 <= r.score <= 1 for r in out)
    assert T.score(docs.limit(0), T.fit(docs, some)).count() == 0
