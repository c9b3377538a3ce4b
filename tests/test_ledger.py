import os

import pytest
from pyspark.sql import functions as F

from portcullis.sources import ledger
from portcullis.sources.sinks import stored_items, write_clean, write_quarantine


def blocked(spark, names, tag):
    return spark.createDataFrame([(f"/in/{n}", 4, f"{tag} {n}".encode()) for n in names], "path string, verdict int, content binary")


def contents(spark, store):
    rows = stored_items(spark, store).select("key", F.decode("content", "UTF-8").alias("c")).collect()
    keys = [r.key for r in rows]
    assert len(keys) == len(set(keys))
    return {r.key: r.c for r in rows}


def test_repeats_of_a_run_change_nothing(spark, tmp_path):
    store = str(tmp_path / "q")
    assert contents(spark, store) == {}
    first = sorted(tuple(r) for r in write_quarantine(blocked(spark, "ab", "one"), "/in", store, run="r1").collect())
    again = sorted(tuple(r) for r in write_quarantine(blocked(spark, "ab", "two"), "/in", store, run="r1").collect())
    assert first == again and [r[3] for r in first] == [4, 4]
    other = write_quarantine(blocked(spark, "bc", "three"), "/in", store, run="r2").collect()
    assert sorted((r.path, r.severity) for r in other) == [("/in/b", 1), ("/in/c", 4)]
    assert contents(spark, store) == {"a": "one a", "b": "one b", "c": "three c"}


def test_a_run_that_loses_the_race_plans_again(spark, tmp_path, monkeypatch):
    store, real, raced = str(tmp_path / "q"), ledger.publish, []

    def publish(session, where, entry):
        if not raced:  # between this run's rows and its entry, another whole run comes first
            raced.append(entry)
            assert write_quarantine(blocked(spark, "bc", "fast"), "/in", store, run="fast").count() == 2
        return real(session, where, entry)

    monkeypatch.setattr(ledger, "publish", publish)
    slow = write_quarantine(blocked(spark, "ab", "slow"), "/in", store, run="slow").collect()
    assert sorted((r.path, r.severity) for r in slow) == [("/in/a", 4), ("/in/b", 1)]
    assert contents(spark, store) == {"a": "slow a", "b": "fast b", "c": "fast c"}
    assert [e["run"] for e in ledger.entries(spark, store)] == ["fast", "slow"]
    assert not os.path.exists(f"{store}/data/{raced[0]['token']}")


def test_a_killed_run_is_unseen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "c")
    items = blocked(spark, "ab", "x").withColumn("eligible", F.lit(True))
    with monkeypatch.context() as m:
        m.setattr(ledger, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write_clean(items, "/in", store, run="r")
    assert os.listdir(f"{store}/data") and contents(spark, store) == {}
    assert {r.code for r in write_clean(items, "/in", store, run="r").collect()} == {"PLACED"}
    assert sorted(contents(spark, store).values()) == ["x a", "x b"]
    assert {r.code for r in write_clean(items, "/in", store, run="later").collect()} == {"OUTPUT_EXISTS"}


def test_an_entry_is_put_only_where_it_is_absent(spark, tmp_path):
    store = str(tmp_path / "s")
    assert ledger.publish(spark, store, {"version": 1, "run": "a", "token": "t1"})
    assert not ledger.publish(spark, store, {"version": 1, "run": "b", "token": "t2"})
    assert [e["run"] for e in ledger.entries(spark, store)] == ["a"]
