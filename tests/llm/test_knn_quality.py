import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from portcullis.llm import knn_quality as K


def test_scores_match_brute_force():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        at = np.sort(rng.choice(K.TERMS, 30, replace=False))
        rows.append((at, rng.random(30).astype(np.float32)))
    y = (rng.random(120) < 0.7).astype(float)
    m = K.fit_model(rows, y, k=7, directions=12)
    got = m.scores(m.vectors[:40])
    for i in range(40):
        cos = [float(np.dot(m.vectors[i], v)) for v in m.vectors]
        near = sorted(range(120), key=lambda j: (-cos[j], j))[:7]
        w = [max(cos[j], 0.0) ** K.SHARPNESS for j in near]
        want = (sum(a * y[j] for a, j in zip(w, near, strict=True)) + 1e-6 * m.prior) / (sum(w) + 1e-6)
        assert math.isclose(got[i], want, rel_tol=1e-3, abs_tol=1e-4)


def test_nulls_empty_clashing_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "a b c " * 5000, 3.0), (3, "a b c", 3.0), (None, "x", 4.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = K.score(docs, K.fit(docs, none)).collect()
    assert [r._quality_score for r in out] == [0.5] * 5 and [r.score for r in out] == [1.0, 2.0, 3.0, 3.0, 4.0]
    some = spark.createDataFrame([(3, 1), (3, 0), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert all(0 <= r._quality_score <= 1 for r in K.score(docs, K.fit(docs, some)).collect())
    assert K.score(docs.limit(0), K.fit(docs.limit(0), some)).count() == 0


def test_held_out_accuracy(spark):
    def text(i):
        good = " ".join(f"word{(i * 7 + j) % 90} the of" for j in range(20 + i % 30)) + "."
        return good if i % 4 else " ".join(f"W{j % 13}!!" for j in range(20 + i % 50))
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    out = {r.doc_id: r._quality_score for r in K.score(docs, K.fit(docs, labels, sample=200)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.3) == bool(i % 4) for i in held) >= 0.98 * len(held)
