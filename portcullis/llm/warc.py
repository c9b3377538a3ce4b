"""WARC archives: a normaliser of monolithic gzip files, with a writer and a reader.

``write_archives`` writes one WARC record a page into whole-file gzip streams, as careless crawlers leave
them: no record can be reached without inflating everything before it. ``normalise`` inflates each such
stream once, in bounded pieces, rewrites every record as a gzip member of its own, and writes a sidecar
index of (offset, length) for each record. ``read_records`` then reads records by their index entries,
each by itself.

Archives hold at most about ``ARCHIVE`` bytes of payload (one record more), so a task inflates one
archive at a time in bounded memory. Files are written under a name that begins with a dot and renamed
when complete, and an archive's name holds its task's attempt: a task that runs again may get its rows in another
order, so it writes files of its own, and only those that the finished task returned are read. Folders may lie in any store that pyarrow opens by
its address (file, hdfs, s3, gs) and must be shared by all executors.

Of records with equal payloads of ``SMALLEST_REVISIT`` bytes or more, the one with the smallest page_id is
the response and the others revisit it: such records have no payload of their own and name it. Digests are
grouped with partial aggregates, so a payload that a third of all pages share costs no task more.

Defined results: null html is an empty payload; rows that repeat a page_id are records of their own, and
all rows of the smallest page_id stay responses; a null page_id sorts behind all others; an empty table
gives an empty result.
"""
from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import stored

SMALLEST_REVISIT = 100
ARCHIVE = 8 << 20
PIECE = 1 << 20
MOST_TASKS = 20_000
CRLF = b"\r\n"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(folder).path)
    return pafs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers: bool) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block and names the record that it repeats."""
    kind, block = ("revisit", b"") if refers else ("response", payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
            "WARC-Target-URI: " + "".join(c for c in url or "" if c >= " "), f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + block + CRLF + CRLF


class Records:
    """Splits a growing stream of bytes into whole records."""

    def __init__(self) -> None:
        self.waiting = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.waiting += data
        at = 0
        while (end := self.waiting.find(b"\r\n\r\n", at)) >= 0:
            size = int(headers(bytes(self.waiting[at:end]))["content-length"])
            whole = end + 4 + size + 4
            if whole > len(self.waiting):
                break
            yield bytes(self.waiting[at:whole])
            at = whole
        del self.waiting[:at]

    def close(self) -> None:
        if self.waiting:
            raise ValueError("the archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def inflate(stream) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, in bounded memory."""
    d = zlib.decompressobj(wbits=31)
    data = stream.read(PIECE)
    while data:
        yield d.decompress(data, PIECE)
        if d.eof:
            data = d.unused_data or stream.read(PIECE)
            d = zlib.decompressobj(wbits=31)
        else:
            data = d.unconsumed_tail or stream.read(PIECE)
    while not d.eof and (rest := d.decompress(d.unconsumed_tail, PIECE)):
        yield rest


def _put(fs: pafs.FileSystem, path: str, write) -> None:
    """The file at ``path`` at once or not at all; a second attempt replaces the first."""
    folder, _, name = path.rpartition("/")
    from pyspark import TaskContext
    context = TaskContext.get()
    hidden = f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(hidden, compression=None) as f:
        write(f)
    fs.move(hidden, path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """``records``: page_id, url, payload, digest, refers, refers_to. Writes whole-file gzip archives into
    ``folder``; returns one row (path) for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, attempt, number, paths = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, []
        buffer, size, packer = io.BytesIO(), 0, None

        def close() -> None:
            nonlocal buffer, size, packer, number
            packer.close()
            path = f"{base}/part-{part:06d}-{number:05d}-{attempt}.warc.gz"
            _put(fs, path, lambda f: f.write(buffer.getvalue()))
            paths.append(path)
            buffer, size, packer, number = io.BytesIO(), 0, None, number + 1

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for r in b.slice(lo, 256).to_pylist():
                    packer = packer or gzip.GzipFile(fileobj=buffer, mode="wb", compresslevel=4, mtime=0)
                    packer.write(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers"]))
                    size += len(r["payload"])
                    if size >= ARCHIVE:
                        close()
        if packer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])
    return records.mapInArrow(run, "path string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """``archives`` has path. Rewrites each archive into ``folder`` with one gzip member for each record and a
    sidecar index beside it; returns the index: path, offset, length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for source in b.column("path").to_pylist():
                path = f"{base}/{source.rpartition('/')[2]}"
                entries: list[tuple[int, int]] = []

                def rewrite(f, source: str = source, entries: list = entries) -> None:
                    records, at = Records(), 0
                    with fs.open_input_stream(source, compression=None) as s:
                        for piece in inflate(s):
                            for r in records.feed(piece):
                                member = gzip.compress(r, compresslevel=4, mtime=0)
                                f.write(member)
                                entries.append((at, len(member)))
                                at += len(member)
                    records.close()

                _put(fs, path, rewrite)
                index = "".join(f"{o} {n}\n" for o, n in entries).encode()
                _put(fs, path + ".idx", lambda f, index=index: f.write(index))
                yield pa.RecordBatch.from_arrays([pa.array([path + ".idx"])], names=["index"])
    return archives.mapInArrow(run, "index string")


def read_records(indexes: DataFrame, folder: str) -> DataFrame:
    """``indexes`` has index (paths of sidecars in ``folder``). Reads every record by its entry alone: page_id,
    record_type, refers_to, claimed_bytes, claimed_digest and payload."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("claimed_bytes", pa.int64()),
                        ("claimed_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        number = lambda s: int(s[len("<urn:page:"):-1]) if s and s != "<urn:page:>" else None
        for b in batches:
            for index in b.column("index").to_pylist():
                with fs.open_input_stream(index, compression=None) as f:
                    entries = [tuple(map(int, line.split())) for line in f.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(index[:-len(".idx")]) as f:
                    for offset, length in entries:
                        head, _, block = gzip.decompress(f.read_at(length, offset)).partition(b"\r\n\r\n")
                        h = headers(head)
                        rows.append((number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), int(h["x-payload-length"]),
                                     h["warc-payload-digest"].removeprefix("sha256:"), block[:int(h["content-length"])]))
                        size += len(block)
                        if size > PIECE:
                            yield _rows(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows, schema)
    return indexes.mapInArrow(run, "page_id long, record_type string, refers_to long, claimed_bytes long, claimed_digest string, payload binary")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers, refers_to of every page."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = (p.where(F.length("payload") >= SMALLEST_REVISIT).select("digest", "page_id").groupBy("digest")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id")).alias("m"), F.count("*").alias("c"))
             .where("c > 1").select(F.col("digest").alias("_digest"), F.col("m.page_id").alias("_first")))
    # few digests repeat: the pages with their bodies stay where they are if those fit Spark's own bound
    j = p.join(first, F.col("digest") == F.col("_digest"), "left")
    refers = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return j.select("page_id", "url", "payload", "digest", refers.alias("refers"), F.when(refers, F.col("_first")).alias("refers_to"))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages, normalise the archives, read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Lengths and digests of responses are taken from the payload read; those of
    revisits from the response they name, which must have been read with the digest that the revisit claims; a revisit
    whose response is missing or damaged raises an error."""
    raw = stored(write_archives(with_revisits(pages), f"{folder}/monolithic"))
    tasks = max(1, min(raw.count(), MOST_TASKS))  # the lists are small, the work behind them is not
    indexes = stored(normalise(raw.repartition(tasks, "path"), f"{folder}/members"))
    read = read_records(indexes.repartition(tasks, "index"), f"{folder}/members")
    return resolved(stored(read.select("page_id", "record_type", "refers_to", "claimed_bytes", "claimed_digest",
                                       F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))))


def resolved(read: DataFrame) -> DataFrame:
    """``read``: one narrow row a record, n and digest taken from the payload read. Revisits get those of their response."""
    responses = (read.where((F.col("record_type") == "response") & (F.col("n") >= SMALLEST_REVISIT))
                 .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("n").alias("_n")).distinct())
    revisit = F.col("record_type") == "revisit"
    j = read.join(responses, revisit & F.col("refers_to").eqNullSafe(F.col("_page")) & (F.col("claimed_digest") == F.col("_digest")), "left")
    lost = revisit & (F.col("_n").isNull() | (F.col("_n") != F.col("claimed_bytes")))
    told = F.raise_error(F.format_string("page %s revisits %s, whose response was not read as claimed",
                                         F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))
    size = F.when(lost, told.cast("long")).when(revisit, F.col("_n")).otherwise(F.col("n"))
    return j.select("page_id", size.alias("payload_bytes"), F.when(revisit, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"),
                    "record_type", "refers_to")
