import os

import pytest
from pyspark.sql import functions as F

from portcullis.sources import tree as T
from portcullis.sources.items import list_items


def build(root, n=40):
    want = {}
    for i in range(n):
        folder = os.path.join(root, *[f"d{i % 3}", f"e{i % 7}", "f", "g"][:i % 5])
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, [f"a{i}.txt", f".hidden{i}", f"_under{i}", f"empty{i}"][i % 4])
        body = b"" if i % 4 == 3 else bytes([i]) * (i + 1)
        with open(path, "wb") as f:
            f.write(body)
        want[path] = body
    os.symlink(root, os.path.join(root, "loop"))
    return want


def test_listing_and_bodies_of_a_whole_tree(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    os.makedirs(root)
    want = build(root)
    for folders in (1, 128):
        monkeypatch.setattr(T, "FOLDERS", folders)
        got = [(r.path, r.length) for r in T.listing(spark, root).collect()]
        assert sorted(got) == sorted((p, len(b)) for p, b in want.items())
    assert {r.path: bytes(r.content) for r in list_items(spark, "file://" + root).collect()} == want
    one = next(iter(want))
    assert [r.path for r in T.listing(spark, one).collect()] == [one]
    assert T.listing(spark, root).rdd.getNumPartitions() > 3
    with pytest.raises(Exception, match="does not exist"):
        T.listing(spark, root + "/none").collect()
    os.makedirs(root + "/nothing")
    assert T.listing(spark, root + "/nothing").count() == 0


def test_large_files_by_their_ends_and_errors_by_name(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:      # three GiB, most of it a hole
        f.write(b"head")
        f.seek((3 << 30) - 4)
        f.write(b"tail")
    (tmp_path / "small").write_bytes(b"x" * 64)
    rows = {r.path.rpartition("/")[2]: r for r in list_items(spark, str(tmp_path), whole=64, window=4).collect()}
    assert (rows["big.bin"].length, bytes(rows["big.bin"].content), rows["big.bin"].whole) == (3 << 30, b"headtail", False)
    assert (bytes(rows["small"].content), rows["small"].whole, rows["small"].error) == (b"x" * 64, True, None)
    gone = T.with_bodies(spark.createDataFrame([(str(tmp_path / "gone"),), (str(tmp_path),)], "path string")).collect()
    assert all(r.content is None and "no longer there" in r.error for r in gone)


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f{i}").write_bytes(b"x")
    per_task = T.with_bodies(T.listing(spark, str(tmp_path))).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 1 and sum(r["count"] for r in per_task) == 200


def test_stream_sees_each_version_once(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(root)
    want = build(root, 12)

    def go():
        q = (T.listing_stream(spark, root).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination(120)

    go()
    changed = sorted(want)[0]
    with open(changed, "ab") as f:
        f.write(b"more")
    with open(root + "/.late", "wb"):
        pass
    go()
    go()
    got = sorted(r.path for r in spark.read.schema(T.LISTED).parquet(out).collect())
    assert got == sorted([*want, changed, root + "/.late"])
