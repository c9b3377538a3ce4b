import math
import os

import duckdb
import numpy as np
import pytest

from portcullis.llm import blocks
from portcullis.llm import multi_index as M

SF = "/root/testdata/sf0.1"


def brute(rows, k, every):
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    first = {}
    for i, v in ok:
        if i % every == 0:
            first[i] = min(v, first.get(i, v))
    out = {}
    for a, v in first.items():
        near = sorted((math.dist(v, w), i) for i, w in ok if i != a and len(w) == len(v))[:k]
        out[a] = near
    return out


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 16)).astype(np.uint16)
    codes[:500] = codes[0] ^ (rng.random((500, 16)) < 0.2) * rng.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    index = M.Index(codes)
    bits = lambda c: np.unpackbits(np.ascontiguousarray(c).view(np.uint8), axis=-1)
    for q in (0, 7, 2000):
        got = index.within(codes[q], 40)
        distance = (bits(codes) != bits(codes[q])).sum(1)
        assert len(got) >= 40
        assert set(np.nonzero(distance <= distance[got].max())[0]) == set(got) or len(got) == 3000


def test_small_tables_are_exact(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(5)]) for i in range(220)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(100, rows[3][1]), (400, None), (500, [0.0] * 5), (600, [None] * 5), (700, [math.nan] + [1.0] * 4),
             (800, [1.0, 2.0]), (900, [2.0, 2.0]), (901, [3.0, 2.0]), (None, [1.0] * 5), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS rank")
    got = {}
    for r in sorted(M.neighbours(df, lambda c: c % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = {a: n for a, n in brute(rows, 10, 100).items() if n}
    assert got.keys() == want.keys()
    for a, near in want.items():
        assert [i for _, i in got[a]] == [i for _, i in near] and np.allclose([d for d, _ in got[a]], [d for d, _ in near], rtol=1e-12)


def test_empty(spark):
    assert M.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 100 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_recall(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in M.neighbours(spark.read.parquet(f"{SF}/embeddings.parquet"), lambda c: c % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for a in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == a][0]) ** 2).sum(1))
        d[ids == a] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hits += sum(int(i) in got[a] for i in near)
        total += len(near)
        assert all(math.isclose(s, d[ids == i][0], rel_tol=1e-12) for i, s in got[a].items())
    assert hits >= 0.95 * total, hits / total
