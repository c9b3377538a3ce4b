import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from portcullis.llm import prefix_trie as T
from portcullis.llm import queries as Q

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    own_saved = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved[p]
    end = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(end(p).encode()).hexdigest()) for p, m in list(members.items())), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS depth", "'x' AS c", "2 AS block", "3 AS t1", "4 AS longest")
    return sorted((tuple(r) for r in T.trie(df).collect()), key=repr)


def small(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "", None, "a b\tc"]))
            for c in rng.sample(range(-45, 200), 90) for t in range(rng.choice([1, 2, 3, 5, 8, 9, 17]))]
    rows += [(400, None, "user", "first"), (400, 0, "bot", "x"), (401, 3, "u", "same"), (401, 3, "u", "same"), (401, 3, None, "other"), (None, 0, "u", "lost")]
    return rows


def test_nodes_match_brute_force(spark):
    rows = small(3)
    assert run(spark, rows) == brute(rows)


def test_long_conversations_and_a_hot_one(spark):
    rng = random.Random(5)
    rows = [(1000 + i, t, "user", "hello world" if t < 40 else f"w {rng.randint(0, 1)}") for i in range(3) for t in range(70)]
    rows += [(2000, t, "user", f"turn {t % 7}") for t in range(300)]          # one conversation with a third of the rows
    rows += [(3000 + i, t, "user", "copy") for i in range(100) for t in range(4)]  # a group of copies
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_absent_bases(spark):
    assert run(spark, []) == []
    rows = [(c, 0, "u", "t") for c in (21, 22, 23, 24, 25, 26)]  # no conversation 20: some are left without turns
    got = run(spark, rows)
    assert got == brute(rows) and any(d == 0 and n == 6 for _, d, _, n, *_ in got)


def test_ids_longer_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    rows = [(i, 0, "u", "t") for i in range(0, 60)]
    assert run(spark, rows) == brute(rows)


def test_query_matches_its_sql(spark, tmp_path):
    rows = small(9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = Q.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    r = con.execute(Q.ORACLES["op13_prefix_trie"])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(x[c] for c in names) for x in got.collect()), key=repr) == sorted(r.fetchall(), key=repr)
