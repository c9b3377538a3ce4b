"""The report document in pieces against json built in Python."""
import json

import pytest
from pyspark.sql import functions as F

from portcullis.operators.verdict import document_pieces, finding_entries
from portcullis.sources.sinks import write_document

NAMES = {0: "PASS", 1: "WARN", 3: "FAIL", 4: "BLOCK"}
HEAD = dict(tool="portcullis", version="0.1.0", command="ingest", profile="homelab")
FOUND = "item_id long, stage int, seq long, code string, severity int, message string, detail string"


def written(spark, pieces, path, segments=None):
    manifest = write_document(pieces, path, segments).orderBy("segment").collect()
    parts = [open(f"{path}/{r.name}", "rb").read() for r in manifest]
    at = 0
    for r, part in zip(manifest, parts, strict=True):
        assert (r.start, r.bytes) == (at, len(part))
        at += r.bytes
    return json.loads(b"".join(parts)), parts


def test_a_document_of_any_size(spark, tmp_path):
    """More files than one row should hold, one of them with a third of all findings."""
    i = F.col("id")
    judged = spark.range(12000).select(i.alias("item_id"), F.format_string("/in/%05d \"q\"\n\u202e", i).alias("path"), F.when(i == 7, 4).otherwise(0).alias("verdict"),
                                       F.when(i % 2 == 0, F.concat(F.lit("/out/"), i.cast("string"))).alias("output"),
                                       F.when(i % 3 == 0, F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), i.cast("string"))).alias("info"), (i % 50).alias("duration_ms"))
    found = spark.range(9000).select(F.when(i % 3 == 0, 7).otherwise(i).cast("long").alias("item_id"), (i % 2).cast("int").alias("stage"), i.alias("seq"), F.lit("X").alias("code"),
                                     F.lit(4).alias("severity"), F.concat(F.lit("m\\"), i.cast("string")).alias("message"), F.when(i % 4 == 0, "d").otherwise("").alias("detail"))
    actions = spark.range(600).select((i % 200).alias("item_id"), (F.floor(i / 200) + 1).alias("ordinal"), F.concat(F.lit("keep #"), i.cast("string")).alias("line"))
    at = F.lit("2026-01-02 03:04:05.9").cast("timestamp")
    pieces = document_pieces(judged, found.repartition(11), actions, started=at, finished=at, errors=["late \"one\""], **HEAD)
    doc, parts = written(spark, pieces.repartition(16), str(tmp_path / "doc"), 7)
    of = {}
    for n in range(9000):
        e = {"code": "X", "severity": "BLOCK", "message": f"m\\{n}", **({"detail": "d"} if n % 4 == 0 else {})}
        of.setdefault(7 if n % 3 == 0 else n, []).append(((n % 2, n), e))
    want = [{"path": f"/in/{n:05d} \"q\"\n\u202e", "verdict": "BLOCK" if n == 7 else "PASS", "findings": [e for _, e in sorted(of.get(n, []), key=lambda x: x[0])],
             **({"output": f"/out/{n}"} if n % 2 == 0 else {}), **({"actions": [f"keep #{n + 200 * k}" for k in range(3)]} if n < 200 else {}),
             **({"info": {"a": str(n), "z": "1"}} if n % 3 == 0 else {}), "duration_ms": n % 50} for n in range(12000)]
    assert doc.pop("files") == want
    assert doc == {"schema": "portcullis.report/1", **HEAD, "started": "2026-01-02T03:04:05Z", "finished": "2026-01-02T03:04:05Z", "verdict": "BLOCK",
                   "counts": {"BLOCK": 1, "PASS": 11999}, "errors": ["late \"one\""]}
    assert len(parts) == 7 and max(map(len, parts)) < sum(map(len, parts)) / 2  # no task writes the whole
    with pytest.raises(Exception):
        write_document(pieces, str(tmp_path / "doc"))


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    rows = [(1, None, 0), (1, "/twice", 1), (None, "/no key", 3), (2, "", 0)]
    judged = spark.createDataFrame(rows, "item_id long, path string, verdict int")
    found = spark.createDataFrame([(1, 1, 0, "A", 1, None, None), (1, 1, 0, "A", 1, None, None), (9, 1, 0, "ORPHAN", 4, "m", None), (None, 1, 0, "B", 1, "m", None)], FOUND)
    doc, _ = written(spark, document_pieces(judged, found, started=at, finished=at, **HEAD), str(tmp_path / "a"))
    twice = [{"code": "A", "severity": "WARN", "message": ""}] * 2
    assert [(f["path"], f["verdict"], f["findings"], f["duration_ms"]) for f in doc["files"]] == [
        ("", "PASS", twice, 0), ("", "PASS", [], 0), ("/no key", "FAIL", [], 0), ("/twice", "WARN", twice, 0)]
    empty, _ = written(spark, document_pieces(judged.limit(0), found, started=at, finished=at, **HEAD), str(tmp_path / "b"))
    assert (empty["files"], empty["errors"], empty["counts"], empty["verdict"]) == ([], [], {}, "PASS")
    assert finding_entries(found.limit(0)).count() == 0
