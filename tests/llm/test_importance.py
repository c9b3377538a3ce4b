import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb

from portcullis.llm import importance as I
from portcullis.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    def feats(t):
        ws = WORD.findall(lower(t))
        return len(ws), [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(low, high + 1) for i in range(len(ws) - k + 1)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, x in docs:
        n, f = feats(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain(b) for b in f)
        rows.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r.append(i + 1)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=repr)


def given(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Öl", "çé", "x1", *[f"w{i}" for i in range(60)]]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n\n", "\x00", "  "]) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60])))
    docs = [(i, text()) for i in range(n)] + [(900, None), (901, ""), (902, "!?"), (None, text()), (902, "Word " * 40), (902, "Word " * 40), (903, "long text " * 40000)]
    docs += [(None, "same words " * 15)] * 3
    return docs, [text() for _ in range(50)] + [None, ""]


def frames(spark, docs, target):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "'x' AS score", "1 AS weight", "2 AS id", "3 AS __at"),
            spark.createDataFrame([(t,) for t in target], "text string"))


def test_resample_matches_brute_force(spark):
    docs, target = given(4)
    for low, high, percent, least in [(1, 1, 10, 20), (1, 3, 37, 1), (2, 2, 100, 0)]:
        got = I.resample(*frames(spark, docs, target), low=low, high=high, percent=percent, least_words=least)
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
        assert rows == brute(docs, target, low, high, percent=percent, least=least)


def test_overlapped_spans():
    two = I.scanner(2)
    assert [m[0] for m in two.finditer(b"a bb ccc d", overlapped=True)] == [b"a bb", b"bb ccc", b"ccc d"]
    assert I.collapsed(b"  A--b\t\nC9\xc3\x89 ") == b"a b c9\xc3\x89"


def test_empty_tables(spark):
    docs, target = frames(spark, *given(5, 5))
    assert I.resample(docs.limit(0), target).count() == 0
    assert {r.rank for r in I.resample(docs, target.limit(0), least_words=10_000).collect()} == {None}


def test_query_matches_its_sql(spark, tmp_path):
    docs, target = given(6, 120)
    docs = [d for d in docs if d[0] is not None and d[0] != 903]
    a, b = frames(spark, docs, target)
    a.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((tuple(r) for r in Q.QUERIES["op12_importance_resampling"](spark, str(tmp_path)).collect()), key=repr)
    r = con.execute(Q.ORACLES["op12_importance_resampling"])
    assert [d[0] for d in r.description] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got == sorted(r.fetchall(), key=repr)
