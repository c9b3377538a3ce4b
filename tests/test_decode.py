"""Bodies decoded range by range give what the standard library gives for the whole body, wherever the ranges end."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from portcullis.functions import text as X
from portcullis.operators import verify as V
from portcullis.sources import decode as D
from portcullis.sources import tree as T


def cut(data, span):
    return (data[lo:lo + span] for lo in range(0, len(data), span))


def is_json(data):
    def refuse(word):
        raise ValueError(word)
    try:
        json.loads(data.decode(), parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return not data.startswith(b"\xef\xbb\xbf")


def texts():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 7:
            return {rng.choice(["a", "é\n", '"', "\\", "𝄞"]) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        return [None, True, False, rng.uniform(-1e9, 1e9), rng.randrange(-99, 99), "x\t é\"\\/" * rng.randrange(3)][kind]
    for i in range(250):
        yield json.dumps(value(4), ensure_ascii=i % 2 == 0, indent=[None, 1][i % 3 == 0]).encode()
    yield from (b"", b" ", b"0", b"-0", b"01", b"-", b"1.", b"1.e3", b"1e", b"1e+", b"1E-7 ", b".5", b"+1", b"NaN", b"tru", b"truex", b"nullnull", b"[1,]", b"[,1]",
                b'{"a":1,}', b'{"a" 1}', b'{a:1}', b'{"a":}', b'["\\u12g4"]', b'["\\x"]', b'["\x01"]', b"[}", b"]", b"[[]", b'"open', b'"\\u00', b"\xef\xbb\xbf1", b"\xff", b'["\xc3"]',
                b'"\xed\xa0\x80"', b'"\xc0\x80"', b"[" * 3000 + b"]" * 3000, b"1 2", b"[1]\n\n", b'"\\ud800"')


@pytest.mark.parametrize("span", [1, 2, 3, 7, 1 << 20])
def test_faults_equal_the_standard_library(span):
    rng = random.Random(span)
    seen = set()
    for whole in texts():
        damaged = bytearray(whole)
        if damaged and rng.random() < 0.7:
            damaged[rng.randrange(len(damaged))] = rng.choice(b'"\\{}[],:0e- \x00\xff\xc3')
        for data in (whole, bytes(damaged)):
            try:
                data.decode()
                bad = None
            except UnicodeDecodeError as e:
                bad = e.start
            coding = D.first_fault(cut(data, span), False)
            assert (coding and coding[:2]) == (None if bad is None else ("encoding", bad)), data
            found = D.first_fault(cut(data, span), True)
            if whole.startswith(b"[[["):  # deeper than the standard library goes; whole, it is right, with a changed byte it is not
                assert (found is None) == (data == whole)
            else:
                assert (found is None) == (not data or is_json(data)), (data, found)
            seen.add(found and found[0])
    assert seen == {None, "encoding", "json"}


def test_tokens_longer_than_a_range_and_depth():
    assert D.first_fault(cut(b'"' + b"x" * 100000 + b'"', 1000), True) is None
    assert D.first_fault(cut(b"1" * 100000 + b".5", 1000), True) is None
    assert D.first_fault(cut(b"1" * 100000 + b".", 1000), True) == ("json", 100001, "the value is not complete")
    shallow = D.Json(depth=10)
    with pytest.raises(D.Fault, match="open brackets"):
        shallow.feed(b"[" * 11)


def test_bodies_and_findings(spark):
    rows = [(1, b'{"a": "\xc3\xa9"}', True), (2, b"plain", False), (3, b"plain", True), (4, b"\xff", True), (5, None, True), (6, b"", True), (7, b"[1", None), (8, b"[1", True)]
    items = spark.createDataFrame(rows, "k long, content binary, is_json boolean").withColumn("fault", F.lit("clash"))
    for span in (1, 1 << 20):
        faults = D.body_faults(items, ["k"], F.col("content"), F.col("is_json"), span=span)
        assert {r.k: r.fault for r in faults.collect()} == {1: None, 2: None, 3: "json", 4: "encoding", 5: None, 6: None, 7: None, 8: "json"}
        found = {r.k: (r.code, r.terminal, r.detail) for r in D.fault_findings(faults, "k").collect()}
        assert found[8] == ("UNPARSEABLE", True, "byte 2: the value is not complete") and found[4][:2] == ("DECODE_FAIL", False)
    assert D.body_faults(items.limit(0), ["k"], F.col("content"), F.col("is_json")).count() == 0
    with pytest.raises(ValueError, match="tier"):
        D.body_faults(items, ["k"], F.col("content"), F.col("is_json"), tier="none")


def test_files_by_ranges(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    big = ("é" * 50000).encode()
    bodies = {"good.json": b"[" + b'"' + big + b'"' + b", 1" * 20000 + b"]", "cut.json": b"[" + b"1, " * 20000, "odd": big[:70001] + b"\xff" + big[:30000],
              "text": big, "empty.json": b"", ".hidden": b"\xff"}
    for name, body in bodies.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)
    files = T.listing(spark, root).unionByName(spark.createDataFrame([(root + "/gone", None, None)], T.LISTED))
    named = lambda df: {os.path.basename(r.path): r.fault for r in df.collect()}
    want = {"good.json": None, "cut.json": "json", "odd": "encoding", "text": None, "empty.json": None, ".hidden": "encoding", "gone": "unreadable"}
    assert named(D.file_faults(files, F.col("path").endswith(".json"), span=1000)) == want
    # the quick tier looks at both ends only; windows may begin and end inside a character
    assert named(D.file_faults(files, F.col("path").endswith(".json"), tier="quick")) == {**want, "cut.json": None, "odd": None}


def test_canonical_hash_of_composed_and_decomposed_copies(spark):
    rows = [(1, "caf\u00e9 \n"), (2, "cafe\u0301\r\n"), (3, "\uac00"), (4, "\u1100\u1161"), (5, "plain"), (6, "plain  \n\n"), (7, None), (8, "\ufb01"), (9, "fi")]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k long, s string").select("k", V.canonical_hash(F.col("s")).alias("h")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and got[7] is None and got[8] != got[9]


def test_very_many_links_of_one_text(spark):
    n = 100_000
    body = " ".join(f"http://{'AbC'[i % 3]}{i % (n // 2)}.example.com/x" for i in range(n))
    got = spark.createDataFrame([(body,), ("see WWW.A.com, www.a.com and www.b.com",), (None,)], "s string").select(X.find_links(F.col("s")).alias("l")).collect()
    want = list({m.lower(): m for m in reversed(body.split())}.values())[::-1]
    assert got[0].l == want and got[1].l == ["WWW.A.com", "www.b.com"] and got[2].l == []
