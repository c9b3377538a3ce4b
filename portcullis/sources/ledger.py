"""A store of rows that several runs may add to at once, each row's key at most once.

A run reads a snapshot of the store, plans against it, and writes its rows and its plan into folders of its own, which
nobody reads yet. One entry in the store's log, put there only if that version is still absent, then makes them
visible at once. A run that loses its version to another one plans again on the new snapshot. So a killed run leaves
folders without an entry, which no reader sees, and its repeat begins anew; a repeat of a finished run finds its own
entry and answers with the plan it names.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Attempts at a version before a run gives up; each one lost means that another run has finished.
ATTEMPTS = 100
_ENTRY = "version long, run string, token string"


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, store: str) -> list[dict]:
    """The log in order of versions: one small entry for each run that has finished."""
    fs, log = _store(spark, f"{store.rstrip('/')}/_log")
    if not fs.exists(log):
        return []
    rows = spark.read.schema(_ENTRY).json(f"{log.toString()}/*.json").orderBy("version").collect()
    return [r.asDict() for r in rows]


def _folders(store: str, kind: str, log: list[dict]) -> list[str]:
    return [f"{store.rstrip('/')}/{kind}/{e['token']}" for e in log]


def stored_rows(spark: SparkSession, store: str, log: list[dict] | None = None) -> DataFrame | None:
    """What finished runs have written, or None."""
    log = entries(spark, store) if log is None else log
    return spark.read.parquet(*_folders(store, "data", log)) if log else None


def publish(spark: SparkSession, store: str, entry: dict) -> bool:
    """Put an entry's version into the log unless it is there; whether it was absent. The entry appears whole."""
    fs, target = _store(spark, f"{store.rstrip('/')}/_log/{entry['version']:012d}.json")
    fs.mkdirs(target.getParent())
    text = json.dumps(entry, sort_keys=True)
    hidden = f".{entry['token']}"
    if fs.getUri().getScheme() == "file":  # a hard link is made only where its name is free
        where = target.toUri().getPath()
        waiting = os.path.join(os.path.dirname(where), hidden)
        with open(waiting, "w") as f:
            f.write(text)
        try:
            os.link(waiting, where)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(waiting)
    jvm = spark._jvm
    waiting = jvm.org.apache.hadoop.fs.Path(target.getParent(), hidden)
    out = fs.create(waiting, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    never = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(waiting, target, never)
        return True
    except Exception:  # noqa: BLE001  a lost race is known by the entry that stands there; any other fault is raised
        if not fs.exists(target):
            raise
        fs.delete(waiting, False)
        return False


def add(spark: SparkSession, store: str, run: str | None, plan: Callable[[DataFrame | None], DataFrame],
        rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add what ``rows`` makes of a plan to the store; ``plan`` gets what is stored already (or None). Returns the plan
    that took effect. ``run`` names the run: a repeat under the same name changes nothing and gives the same answer."""
    run = run or uuid.uuid4().hex
    for _ in range(ATTEMPTS):
        log = entries(spark, store)
        done = [e for e in log if e["run"] == run]
        if done:
            return spark.read.parquet(*_folders(store, "plans", done[:1]))
        version = (log[-1]["version"] if log else 0) + 1
        entry = {"version": version, "run": run, "token": f"{version:012d}-{uuid.uuid4().hex}"}
        (plans,), (data,) = _folders(store, "plans", [entry]), _folders(store, "data", [entry])
        made = plan(stored_rows(spark, store, log))
        made.write.parquet(plans)
        made = spark.read.schema(made.schema).parquet(plans)
        rows(made).write.parquet(data)
        if publish(spark, store, entry):
            return made
        for folder in (plans, data):
            fs, path = _store(spark, folder)
            fs.delete(path, True)
    raise RuntimeError(f"{store}: other runs took {ATTEMPTS} versions in a row")
