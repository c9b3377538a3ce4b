"""Streams, sinks and whole runs over real files."""
import json
import os

import pytest
from pyspark.sql import functions as F

from portcullis.operators.profiles import Profile
from portcullis.operators.routing import check_quarantine_root
from portcullis.operators.verdict import document_pieces, run_header, verdicts
from portcullis.plans.ingest import ingest
from portcullis.plans.scan import finding_rows, scan_items
from portcullis.sources.items import as_attachments, as_parts, list_items
from portcullis.sources.sinks import stored_items, write_clean, write_document, write_quarantine, write_report
from portcullis.streaming import gate, settle

HOME = Profile.load("homelab")
FILES = {"clean.srt": b"1\n00:00:01,000 --> 00:00:02,000\nHello\n", "empty.mkv": b"", "run.sh": b"#!/bin/sh\n", "text.mkv": b"just text", "polyglot.mkv": b"\x1a\x45\xdf\xa3" + b"x" * 99 + b"PK\x03\x04",
         "exe.mkv": b"MZ\x90\x00", "movie‮vkm.mkv": b"\x1a\x45\xdf\xa3", "sub/a.nfo": b"get it at www.example-group.to", ".DS_Store": b"x", ".portcullis-a.tmp": b"x",
         ".portcullis-a.txt": b"planted", "double.exe.mkv": b"\x1a\x45\xdf\xa3", "page.txt": b"<html>"}
EXPECTED = {"clean.srt": ("PASS", {"SIDECAR_OK"}), "empty.mkv": ("BLOCK", {"EMPTY_FILE"}), "run.sh": ("BLOCK", {"SIDECAR_BLOCKED"}), "text.mkv": ("FAIL", {"EXT_MISMATCH"}),
            "polyglot.mkv": ("BLOCK", {"POLYGLOT"}), "exe.mkv": ("BLOCK", {"DANGEROUS_CONTENT"}), "movie‮vkm.mkv": ("BLOCK", {"BIDI_NAME"}),
            "a.nfo": ("WARN", {"SIDECAR_OK", "NOTE_TEXT", "LINK_IN_SIDECAR"}), ".portcullis-a.txt": ("PASS", {"SIDECAR_OK"}), "double.exe.mkv": ("WARN", {"DOUBLE_EXT"}),
            "page.txt": ("BLOCK", {"DANGEROUS_CONTENT"})}
NAMES = {0: "PASS", 1: "WARN", 3: "FAIL", 4: "BLOCK"}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "in"
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return str(root)


def test_scan_of_a_tree(spark, tree, tmp_path):
    items = list_items(spark, tree, exclude=[tree + "/none"]).withColumn("item_id", F.col("path"))
    scanned = scan_items(items, HOME)
    got = {r.name: (NAMES[r.verdict], {f.code for f in r.findings}) for r in scanned.collect()}
    assert got == EXPECTED
    assert "a.nfo" not in {r.name for r in list_items(spark, tree, exclude=[tree + "/sub"]).select("name").collect()}
    found = finding_rows(scanned)
    judged = verdicts(items.select("item_id", "path"), found)
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    pieces = document_pieces(judged, found, tool="portcullis", version="0.1.0", command="scan", profile="homelab", started=at, finished=at)
    names = [r.name for r in write_document(pieces, str(tmp_path / "document")).orderBy("segment").collect()]
    doc = json.loads(b"".join((tmp_path / "document" / n).read_bytes() for n in names))
    assert doc["verdict"] == "BLOCK" and sum(doc["counts"].values()) == len(EXPECTED) == len(doc["files"]) and doc["errors"] == []
    assert all(isinstance(f["findings"], list) for f in doc["files"])
    head = run_header(judged, tool="portcullis", version="0.1.0", command="scan", profile="homelab", started=at, finished=at)
    write_report(head.withColumnRenamed("header", "line"), str(tmp_path / "report"))
    with pytest.raises(Exception):
        write_report(head.withColumnRenamed("header", "line"), str(tmp_path / "report"))


def test_quarantine_never_overwrites(spark, tree, tmp_path):
    store = str(tmp_path / "q")
    items = list_items(spark, tree).withColumn("verdict", F.when(F.col("name") == "exe.mkv", 4).otherwise(0)).select("path", "verdict", "content")
    first = write_quarantine(items, tree, store).collect()
    again = write_quarantine(items.withColumn("content", F.lit(b"other")), tree, store).collect()
    assert [r.severity for r in first] == [4] and [r.severity for r in again] == [1]
    kept = stored_items(spark, store).collect()
    assert [(r.key, bytes(r.content)) for r in kept] == [("exe.mkv", b"MZ\x90\x00")]
    for bad in (tree, tree + "/x"):
        with pytest.raises(ValueError):
            check_quarantine_root(bad, tree)


def test_clean_output_is_placed_once(spark, tmp_path):
    items = spark.createDataFrame([("/in/a.mp4", True, b"1"), ("/in/a.avi", True, b"2"), ("/in/b.mp4", False, b"3")], "path string, eligible boolean, content binary")
    store = str(tmp_path / "out")
    codes = {r.path: r.code for r in write_clean(items, "/in", store).collect()}
    assert codes == {"/in/a.avi": "PLACED", "/in/a.mp4": "OUTPUT_EXISTS"}
    assert {r.code for r in write_clean(items, "/in", store).collect()} == {"OUTPUT_EXISTS"}
    assert [bytes(r.content) for r in stored_items(spark, store).collect()] == [b"2"]


def test_ingest_run(spark):
    rows = [("a", "a.mkv", b"\x1a\x45\xdf\xa3"), ("b", "b.mp4", b"\0\0\0\x18ftypmp42"), ("c", "c.mkv", b"MZ"), ("d", "d.txt", b"hello")]
    items = spark.createDataFrame(rows, "item_id string, name string, content binary").withColumns({
        "path": F.concat(F.lit("/in/"), "name"), "container": F.when(F.col("item_id") == "b", "mp4").otherwise("matroska"), "copies": F.lit(1), "tool_warning": F.lit(False),
        "chapter_n": F.lit(0), "title": F.lit("T"), "global_tags": F.lit(2), "track_tags": F.lit(0), "muxing_app": F.lit(""), "writing_app": F.lit("")})
    parts = spark.createDataFrame([(i, n, t) for i in "abc" for n, t in enumerate(("video", "audio"))], "item string, idx long, type string")
    parts = as_parts(parts, item_id="item", idx="idx", type="type", lang=F.lit("eng"), is_default=F.col("type") == "audio", codec=F.lit("x"))
    atts = as_attachments(spark.createDataFrame([("a", 1)], "item string, n long"), item_id="item", att_id="n", file_name=F.lit("cover.jpg"), mime=F.lit("image/jpeg"), size=F.lit(3), payload=F.lit(b"\xff\xd8\xff"))
    run = ingest(items, parts, HOME, atts)
    got = {r.item_id: (NAMES[r.verdict], r.route) for r in run.items.collect()}
    assert got == {"a": ("PASS", "clean"), "b": ("PASS", "remux"), "c": ("BLOCK", "skip"), "d": ("PASS", "skip")}
    codes = {(r.item_id, r.code) for r in run.findings.collect()}
    assert {("a", "METADATA"), ("a", "ATTACH_OK"), ("c", "REFUSED"), ("b", "ROUTE"), ("d", "ROUTE")} <= codes


def test_ingest_of_audio_and_data_streams(spark):
    """An audio file needs no video; a data stream blocks; a missing video stream fails a video file."""
    rows = [("song", "song.ogg", b"OggS\0\2"), ("odd", "odd.mkv", b"\x1a\x45\xdf\xa3"), ("deaf", "deaf.mkv", b"\x1a\x45\xdf\xa3")]
    items = spark.createDataFrame(rows, "item_id string, name string, content binary").withColumns({
        "path": F.concat(F.lit("/in/"), "name"), "container": F.when(F.col("item_id") == "song", "ogg").otherwise("matroska"), "copies": F.lit(1),
        "tool_warning": F.lit(False), "chapter_n": F.lit(0), "title": F.lit(""), "global_tags": F.lit(0), "track_tags": F.lit(0), "muxing_app": F.lit(""),
        "writing_app": F.lit(""), "tags": F.create_map(F.lit("note"), F.lit("www.a.to"))})
    parts = spark.createDataFrame([("song", 0, "audio"), ("odd", 0, "video"), ("odd", 1, "data"), ("deaf", 0, "audio")], "item string, idx long, type string")
    run = ingest(items, as_parts(parts, item_id="item", idx="idx", type="type", lang=F.lit("fin"), codec=F.lit("c")), HOME)
    assert {r.item_id: (NAMES[r.verdict], r.route) for r in run.items.collect()} == {"song": ("WARN", "clean"), "odd": ("BLOCK", "skip"), "deaf": ("FAIL", "skip")}
    codes = {(r.item_id, r.code) for r in run.findings.collect()}
    assert {("odd", "DATA_STREAM"), ("odd", "REFUSED"), ("deaf", "NO_VIDEO"), ("song", "LINK_IN_TAG")} <= codes and ("song", "NO_VIDEO") not in codes


# --- settle ------------------------------------------------------------------------------------------
def observed(spark, rows):
    return spark.createDataFrame([(p, v, t) for p, v, t in rows], "path string, version string, s long").select(
        "path", "version", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz").alias("ts"))


LOG = ([("grow", f"v{i}", i * 30) for i in range(4)] + [("grow", "v3", 105), ("grow", "v3", 120), ("grow", "v3", 150)]
       + [("once", "x", t) for t in range(0, 200, 10)] + [("again", "x", 0), ("again", "x", 30), ("again", "y", 40), ("again", "y", 69), ("again", "y", 70), ("again", "x", 80), ("again", "x", 115)]
       + [("gone", "x", 0), ("gone", None, 20), ("gone", "x", 31), ("gone", "x", 60), ("gone", "x", 61)])
SETTLED = {("grow", "v3", 90, 120), ("once", "x", 0, 30), ("again", "x", 0, 30), ("again", "y", 40, 70), ("again", "x", 80, 115), ("gone", "x", 31, 61)}


def answers(df):
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) - 1_700_000_000
    return sorted(tuple(r) for r in df.select("path", "version", at("since"), at("settled_at")).collect())


def test_settle_batch_and_stream_agree(spark, tmp_path):
    obs = observed(spark, LOG)
    assert answers(settle.settle_batch(obs, 30, block_seconds=50)) == sorted(SETTLED)
    source = str(tmp_path / "obs")
    for low, high in ((0, 40), (40, 80), (80, 1000)):   # three arrivals, one after the other
        observed(spark, [r for r in LOG if low <= r[2] < high]).coalesce(1).write.mode("append").parquet(source)
        out = settle.settle_files(spark, source, lambda d: d, 30, work=str(tmp_path / "work"))
    assert answers(out) == sorted(SETTLED)


def test_absent_from_a_pass(spark):
    rows = [("p", "x", t) for t in (0, 10, 40, 50, 70)]
    df = observed(spark, rows).withColumn("n", (F.unix_seconds(F.col("ts").cast("timestamp")) - 1_700_000_000).cast("int") / 10)
    got = answers(settle.settle_batch(df.withColumn("n", F.col("n").cast("int")), 30, pass_no="n"))
    assert got == []   # every run of passes without a gap is shorter than the window
    assert answers(settle.settle_batch(df, 30)) == [("p", "x", 0, 40)]


def test_once_per_change(spark):
    msgs = observed(spark, [("a", m, t) for t, m in enumerate(["e1", "e1", "", "e1", "e2", None, "e2"])]).withColumnRenamed("version", "msg")
    got = settle.once_per_change(msgs, ["path"], block_seconds=2).orderBy("ts").collect()
    assert [r.msg for r in got] == ["e1", "e1", "e2", "e2"]


def test_silence_mode_settles_without_a_second_look(spark, tmp_path):
    source = str(tmp_path / "obs")
    read = spark.readStream.schema("path string, version string, ts timestamp").option("maxFilesPerTrigger", 1)
    for batch in ([("a", "x", 0)], [("b", "y", 500)], [("b", "y", 900)]):
        observed(spark, batch).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    q = (settle.settle(read.parquet(source), 30, silence=True, lateness="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert ("a", "x", 0, 30) in answers(spark.read.schema(settle.SETTLED_TYPE).parquet(str(tmp_path / "out")))


def test_gate_stream_reports_each_pass(spark, tree, tmp_path):
    seen = []

    def act(batch):
        seen.append({r.item_id: (r.fresh, r.why) for r in gate.recheck(batch).collect()})

    def start():
        scanned = gate.gate_stream(spark, tree, HOME)
        return gate.start_passes(scanned, str(tmp_path / "reports"), HOME, str(tmp_path / "state"), act)

    late = os.path.join(tree, "late.txt")
    gate.run_once(start, lambda: open(late, "w").write("hello"))
    reports = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "reports")).collect()]
    assert sorted(sum(r["counts"].values()) for r in reports) == [1, len(EXPECTED)]   # empty and hidden files as well
    assert all(fresh for batch in seen for fresh, _ in batch.values())
