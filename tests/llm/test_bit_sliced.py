import math
import os

import duckdb
import numpy as np
import pytest

from portcullis.llm import bit_sliced as B
from portcullis.llm import blocks
from portcullis.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in ok:
        if i % every == 0:
            first[i] = min(v, first.get(i, v))
    out = []
    for a, v in first.items():
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in ok if i != a and len(w) == len(v))[:k]
        out += [(a, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("segment", [65_536, 4_100])
def test_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(blocks, "SEGMENT", segment)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6) * rng.choice([0.01, 0.3, 2])]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(0, rows[3][1]), (60, None), (61, [None] * 6), (62, [math.nan] + [0.0] * 5),
             (63, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (700, [1.0, 2.0]), (701, [0.5, 0.5]), (800, []), (750, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df = df.selectExpr("*", "1 AS id", "2 AS q", "3 AS rank")
    got = sorted(tuple(r) for r in B.top_k(df, lambda c: c % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 5, 50)


def test_slices_against_sums():
    rng = np.random.default_rng(5)
    q, v = rng.integers(-300, 300, (333, 9)), rng.integers(-40, 40, 9)
    index = B.Slices(q)
    slices, shift, slack = B.leading_sum(index, v, 99)
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:333].astype(np.int64) << i) for i, s in enumerate(slices))
    assert slack == 0 and (total + shift == q @ v).all()
    alive = np.packbits(np.arange(index.words * 64) < 333, bitorder="little").view(np.uint64)
    for k in (1, 5, 100, 333):
        assert B.kth_largest(slices, k, alive) == np.sort(total)[-k]


def test_empty(spark):
    assert B.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert B.top_k(one, lambda c: c % 50 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_oracle(spark):
    name = "op5_bit_sliced_top_k"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({ORACLES[name]})").fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_components_beyond_32_bits(spark):
    rows = [(50, [256.0, 1.0]), (1, [1e7, 0.0]), (2, [3.0, 5.0]), (3, [-1e7, 0.0])]
    got = B.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 65536 * 2560000000), (2, 2, 65536 * 768 + 256 * 1280), (3, 3, -65536 * 2560000000)]
    with pytest.raises(OverflowError):
        B.top_k(spark.createDataFrame([(50, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
