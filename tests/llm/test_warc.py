import glob
import gzip
import hashlib
import io
import os

import duckdb
import pytest

from portcullis.llm import warc as W
from portcullis.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100:
            k = (i is None, i or 0)
            first[p] = min(k, first.get(p, k))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        k = first.get(p)
        revisit = k is not None and k != (i is None, i or 0)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", k[1] if revisit and not k[0] else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE", 20_000)
    same = "<p>é" + "same " * 60
    rows = [(i, f"http://h/{i}", f"<html>{i} \r\n\r\nWARC/1.1\r\n" + "é中 x\n" * (i % 90)) for i in range(300)]
    rows += [(400 + i, "http://h/s\r\nX: y", same) for i in range(50)] + [(390, None, same), (390, "u", same), (500, "u", None), (501, "u", ""), (None, "u", same),
             (502, "u", "short"), (503, "u", "short"), (504, "big", "0123456789" * 300_000), (505, "big", "0123456789" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "1 AS digest", "2 AS payload")
    got = W.round_trip(pages, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    # every member stands alone, and the members together are the monolithic stream
    for path in glob.glob(f"{tmp_path}/members/*.warc.gz"):
        with open(path, "rb") as f, open(path + ".idx") as index:
            data = f.read()
            parts = [data[int(o):int(o) + int(n)] for o, n in (line.split() for line in index)]
        assert b"".join(parts) == data
        with gzip.open(path.replace("members", "monolithic")) as whole:
            assert b"".join(map(gzip.decompress, parts)) == whole.read()


def test_streams_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 7)
    rs = [W.record(i, "u", b"x" * i, "d", None, False) for i in range(40)]
    for data in (gzip.compress(b"".join(rs)), b"".join(map(gzip.compress, rs))):
        reader = W.Records()
        assert [r for piece in W.inflate(io.BytesIO(data)) for r in reader.feed(piece)] == rs
        reader.close()
    with pytest.raises(ValueError):
        reader.waiting += b"WARC"
        reader.close()


def test_empty(spark, tmp_path):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_oracle(spark):
    name = "op7_warc_normaliser"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted(r.fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()) == want


def test_revisits_are_checked_against_their_response(spark):
    schema = "page_id long, record_type string, refers_to long, claimed_bytes long, claimed_digest string, n long, digest string"
    good = [(1, "response", None, 200, "aa", 200, "aa"), (2, "revisit", 1, 200, "aa", 0, "ee"), (3, "response", None, 5, "cc", 5, "cc")]
    out = W.resolved(spark.createDataFrame(good, schema)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 200, "aa", "response", None), (2, 200, "aa", "revisit", 1), (3, 5, "cc", "response", None)]
    for bad in ([good[1]], [(1, "response", None, 200, "aa", 200, "damaged"), good[1]], [(1, "response", None, 199, "aa", 199, "aa"), good[1]]):
        with pytest.raises(Exception, match="was not read as claimed"):
            W.resolved(spark.createDataFrame(bad, schema)).collect()
