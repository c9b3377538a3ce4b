import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from portcullis.llm import bpe, mixing, pii
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", *[f"w{i}" for i in range(300)]]) for _ in range(n)) + "."


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        t = text(rng, rng.choice([3, 30, 90]))
        if i % 7 == 0:
            t += f" call +1 (212) 555-0{rng.randint(100, 999)} or a{i}.b@mail.example.com"
        if i % 9 == 0:
            t = " ".join(f"W{rng.randint(0, 9)}X!!" for _ in range(60))
        rows.append((i, t, "en", rng.choice(["s0", "s0", "s1", None]), len(t)))
    rows += [(1000 + i, rows[i][1] + " more", "en", "s1", 0) for i in range(0, 40, 3)] + [(2000 + i, rows[i][1], "en", "s0", 0) for i in range(20)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (5, rows[5][1], "en", "s1", 0), (None, text(rng, 40), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(d, 0 if "!!" in (t or "") else 1, 0) for d, t, *_ in rows if d is not None and d % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, frames = docs, []
    for name, stage in C.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append([tuple(r) for r in at.collect()])
    good, unique, private, mixed, tokens = frames
    assert Counter(good) == Counter(r for r in rows if "!!" not in (r[1] or ""))
    # one row of each component, that of the smallest id
    comp = brute([(r[0], r[1]) for r in good])
    assert {r[0] for r in unique} == {d for d, n, c in comp if n == 0 or d == c} and len(unique) == len({c for d, n, c in comp if n}) + 2
    assert set(unique) <= set(good)
    assert Counter(private) == Counter((d, t and pii.pseudonymise(t, pii.SAMPLE_KEY)[0], *r) for d, t, *r in unique)
    times = Counter(mixed)
    assert set(times) <= set(private) and max(times.values()) <= 2
    words, taken = defaultdict(int), defaultdict(int)
    for r in private:
        words[r[3]] += len((r[1] or "").split())
    for r, n in times.items():
        taken[r[3]] += n * len(r[1].split())
    from test_mixing import shares
    for s, target in shares(words).items():
        assert abs(taken[s] - target) <= 50, s
    tables = bpe.opened(bpe.word_vocabulary())
    want = []
    for r in mixed:
        ids = tables.library.encode(r[1] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tables.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(tokens) == Counter(want)


def test_repeated_ids_share_copies(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b", "s"), (2, "x y z w", "t"), (None, "q r", None)]
    out = Counter(tuple(r) for r in mixing.repeated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert all(n <= 2 * Counter(rows)[r] for r, n in out.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_runs_on_the_given_tables(spark):
    assert 0 < C.run(spark, SF).count() < 400


CLASHING = ["_n", "_size", "_id", "_k", "_text", "_quality_text", "_quality_score", "_pii_count", "score", "t", "n", "id", "source2"]


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, text(rng, 40) if i % 3 else f"W{i % 3}!! " * 30, rng.choice(["a", "b"]), *[f"{c}{i}" for c in CLASHING]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "a", *[f"{c}{100 + i}" for c in CLASHING]) for i in range(0, 30, 4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {r[0]: r for r in rows}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and all(r[2:] == known[r[0]][2:] for r in got), name
    assert len(C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == len(rows)


def test_columns_of_one_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d e f", "t")], "doc_id long, text string, source string").selectExpr("*", "1 AS x", "2 AS x")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES[:-1]:
        assert [tuple(r)[3:] for r in stage(spark, docs, str(tmp_path)).collect()][:1] == [(1, 2)], name


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
