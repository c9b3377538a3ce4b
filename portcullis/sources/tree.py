"""A tree of files as a Spark data source, in batch and as a stream, and bodies read inside tasks.

The planner lists only the top of the tree, until there are enough folders; each folder is a partition, and its
task walks what lies below it. Every file is listed: empty ones, names that begin with '.' or '_', and files of any
size. A listing holds no bodies. ``with_bodies`` deals the paths out anew, so that the files of one folder are read
by many tasks, and reads each by itself: whole up to a bound, beyond it only its first and last bytes, by range.

As a stream the offset is a poll: each batch lists the tree once, as of that poll. A file's version (path, time of
change, length) comes through once; which versions have come lies in the stream's state, spread by path.

Paths may lie in any store that pyarrow opens by its address. Links to folders are not followed.
"""
from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "portcullis_tree"
LISTED = "path string, modificationTime timestamp, length long"
READ = "path string, modificationTime timestamp, length long, content binary, whole boolean, error string"
#: Folders the planner looks for, levels it goes down at most, files in a batch of a listing.
FOLDERS, LEVELS, BATCH = 128, 3, 4096
#: Files up to WHOLE bytes are read whole; of larger ones the first and the last WINDOW bytes.
WHOLE, WINDOW = 1 << 30, 4 << 20
#: Bytes of bodies in one Arrow batch (one file more).
BATCH_BYTES = 32 << 20
_STAMP = pa.timestamp("us", tz="UTC")
_LISTED = pa.schema([("path", pa.string()), ("modificationTime", _STAMP), ("length", pa.int64())])
_READ = pa.schema([*_LISTED, ("content", pa.binary()), ("whole", pa.bool_()), ("error", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The store of a path, the path in it, and what leads from there to an address."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path), ""
    if "://" not in path:
        return pafs.LocalFileSystem(), path, ""
    store, inner = pafs.FileSystem.from_uri(path)
    return store, inner, path[:len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"


def _inside(store: pafs.FileSystem, folder: str) -> tuple[list[str], list[pafs.FileInfo]]:
    """Folders and files directly in a folder; one that is gone meanwhile has none."""
    folders, files = [], []
    for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.type == pafs.FileType.Directory:
            if not (isinstance(store, pafs.LocalFileSystem) and os.path.islink(info.path)):
                folders.append(info.path)
        elif info.type == pafs.FileType.File:
            files.append(info)
    return folders, files


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool   # with all that lies below, or only the files directly in it

    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def _folders(root: str) -> list[Folder]:
    store, inner, _ = opened(root)
    kind = store.get_file_info(inner).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{root} does not exist")
    if kind == pafs.FileType.File:
        return [Folder(inner, False)]
    shallow, deep = [], [inner]
    for _ in range(LEVELS):
        below = [(f, _inside(store, f)[0]) for f in deep]
        if len(deep) >= FOLDERS or not any(inside for _, inside in below):
            break
        shallow += deep
        deep = [x for _, inside in below for x in inside]
    return [Folder(f, False) for f in shallow] + [Folder(f, True) for f in deep]


def _listing(root: str, partition: Folder) -> Iterator[pa.RecordBatch]:
    store, _, lead = opened(root)
    if store.get_file_info(partition.path).type == pafs.FileType.File:
        yield _listed(lead, [store.get_file_info(partition.path)])
        return
    waiting, files = [partition.path], []
    while waiting:
        folders, found = _inside(store, waiting.pop())
        if partition.deep:
            waiting += folders
        files += found
        while len(files) >= BATCH:
            yield _listed(lead, files[:BATCH])
            files = files[BATCH:]
    yield _listed(lead, files)


def _stamp(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


def _listed(lead: str, files: list[pafs.FileInfo]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lead + f.path for f in files], pa.string()),
                                       pa.array([_stamp(f) for f in files], pa.int64()).cast(_STAMP),
                                       pa.array([f.size for f in files], pa.int64())], schema=_LISTED)


class _Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Folder]:
        return _folders(self.root)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _listing(self.root, partition)


class _Polls(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return _folders(self.root)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _listing(self.root, partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: an offset is only the time of a poll."""


class FileTree(DataSource):
    """``spark.read.format(FORMAT).load(root)`` or ``spark.readStream``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def _root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a tree needs a path")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._root())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Polls(self._root())


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime and length of every file below ``root``; no body is read."""
    spark.dataSource.register(FileTree)
    return spark.read.format(FORMAT).load(root)


def listing_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream: each version of a file once."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format(FORMAT).load(root).dropDuplicates(["path", "modificationTime", "length"])


def _body(store: pafs.FileSystem, path: str, size: int, whole: int, window: int) -> bytes:
    if size <= whole:
        with store.open_input_stream(path, compression=None) as f:
            return f.read()
    with store.open_input_file(path) as f:
        return f.read_at(window, 0) + f.read_at(window, size - window)


def _reader(whole: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _READ]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()).cast(_STAMP),
                                               *[pa.array(c, f.type) for c, f in zip(columns[2:], list(_READ)[2:], strict=True)]], schema=_READ)
        for b in batches:
            for path in b.column(0).to_pylist():
                stamp = size = content = None
                error = None
                try:
                    store, inner, _ = opened(path)
                    info = store.get_file_info(inner)
                    if info.type != pafs.FileType.File:
                        raise FileNotFoundError("it is no longer there")
                    stamp, size = _stamp(info), info.size
                    content = _body(store, inner, size, whole, window)
                except (OSError, pa.ArrowException, ValueError) as e:  # what a store may say; the finding names it
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, stamp, size, content, None if size is None else size <= whole, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH:
                    yield flush()
                    rows, held = [], 0
        yield flush()
    return run


def with_bodies(files: DataFrame, whole: int = WHOLE, window: int = WINDOW) -> DataFrame:
    """For every row's path: path, modificationTime, length, content, whole and error, as they are when the file is
    read. ``content`` holds a file of up to ``whole`` bytes, of a larger one its first and last ``window`` bytes
    (``whole`` is false then); it is null, and ``error`` says why, where a file cannot be read."""
    if window * 2 > whole:
        raise ValueError("the windows of a file must be smaller than a file that is read whole")
    return files.select("path").repartition(F.col("path")).mapInArrow(_reader(whole, window), READ)
