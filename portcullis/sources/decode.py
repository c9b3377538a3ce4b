"""Bodies of any size decoded range by range: is a body UTF-8, and is it one JSON value where it should be?

A validator keeps its state between the ranges of a body, so a task holds one range of it however long it is. Text is
followed by the incremental decoder of the standard library; JSON by a pushdown automaton whose stack takes a byte for
each open bracket (at most ``DEPTH``; what is nested deeper is reported as unparseable). Strings and numbers may be
longer than a range.

Defined results: a null body has no fault (it is unreadable, which another check says); an empty one holds nothing to
decode and passes; a byte order mark before JSON is a fault; the first fault of a body is reported, and a fault of
the encoding wins over one of JSON at the same or a later place.
"""
from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.schema import FAIL, finding, gather, text, to_rows
from portcullis.sources.tree import opened

#: Bytes of a range, brackets that may be open, bytes looked at on each end in the quick tier.
RANGE, DEPTH, WINDOW = 4 << 20, 1 << 24, 8192
FAULTS = "fault string, at long, why string"

_SPACE = re.compile(rb"[ \t\n\r]*")
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
_ESCAPE = re.compile(rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_ESCAPE_BEGUN = re.compile(rb"\\(?:u[0-9a-fA-F]{0,3})?\Z")
_WORDS = {b"t": b"true", b"f": b"false", b"n": b"null"}

# What may come next.
VALUE, ITEM_OR_END, KEY_OR_END, KEY, COLON, AFTER, IN_STRING, IN_KEY = range(8)
# Inside a number: what has been read of it last.
MINUS, ZERO, WHOLE, POINT, FRACTION, E, SIGN, EXPONENT = range(8, 16)
_COMPLETE = {ZERO, WHOLE, FRACTION, EXPONENT}


def _number_steps() -> dict[tuple[int, int], int]:
    """(state, byte) -> state of the numbers of JSON."""
    rules = {MINUS: [("0", ZERO), ("123456789", WHOLE)], ZERO: [(".", POINT), ("eE", E)],
             WHOLE: [("0123456789", WHOLE), (".", POINT), ("eE", E)], POINT: [("0123456789", FRACTION)],
             FRACTION: [("0123456789", FRACTION), ("eE", E)], E: [("+-", SIGN), ("0123456789", EXPONENT)],
             SIGN: [("0123456789", EXPONENT)], EXPONENT: [("0123456789", EXPONENT)]}
    return {(state, ord(c)): to for state, steps in rules.items() for chars, to in steps for c in chars}


_STEPS = _number_steps()


class Fault(Exception):
    """The place of the first fault, and what it is."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


class Utf8:
    def __init__(self) -> None:
        self.decoder = codecs.getincrementaldecoder("utf-8")("strict")
        self.fed = 0

    def feed(self, data: bytes, last: bool = False) -> None:
        held = len(self.decoder.getstate()[0])
        try:
            self.decoder.decode(data, last)
        except UnicodeDecodeError as e:
            raise Fault(self.fed - held + e.start, e.reason) from None
        self.fed += len(data)

    def end(self) -> None:
        self.feed(b"", True)


class Json:
    """A pushdown automaton over the bytes of one JSON value."""

    def __init__(self, depth: int = DEPTH) -> None:
        self.state, self.stack, self.depth = VALUE, bytearray(), depth
        self.rest, self.at = b"", 0  # the begun token that the next range completes, and its place

    def _close(self, bracket: bytes, place: int) -> None:
        if not self.stack or self.stack[-1:] != bracket:
            raise Fault(place, "a bracket that does not fit")
        self.stack.pop()
        self.state = AFTER

    def _open(self, bracket: bytes, place: int) -> None:
        if len(self.stack) >= self.depth:
            raise Fault(place, f"more than {self.depth} open brackets")
        self.stack += bracket
        self.state = ITEM_OR_END if bracket == b"[" else KEY_OR_END

    def feed(self, data: bytes) -> None:
        data, begin = self.rest + data, self.at
        self.rest = b""
        i, n = 0, len(data)
        while i < n:
            if self.state in (IN_STRING, IN_KEY):
                i = _PLAIN.match(data, i).end()
                if i == n:
                    break
                escape = _ESCAPE.match(data, i)
                if escape:
                    i = escape.end()
                elif data[i] == 0x22:
                    i, self.state = i + 1, COLON if self.state == IN_KEY else AFTER
                elif _ESCAPE_BEGUN.match(data, i):
                    self.rest = data[i:]
                    break
                else:
                    raise Fault(begin + i, "a control character or unknown escape in a string")
                continue
            if self.state >= MINUS:
                to = _STEPS.get((self.state, data[i]))
                if to is not None:
                    i, self.state = i + 1, to
                    continue
                if self.state not in _COMPLETE:
                    raise Fault(begin + i, "a number that is not complete")
                self.state = AFTER
            i = _SPACE.match(data, i).end()
            if i == n:
                break
            token = data[i:i + 1]
            if self.state in (VALUE, ITEM_OR_END) and token in _WORDS:
                word = _WORDS[token]
                if data[i:i + len(word)] == word:
                    i, self.state = i + len(word), AFTER
                elif n - i < len(word) and word.startswith(data[i:]):
                    self.rest = data[i:]
                    break
                else:
                    raise Fault(begin + i, "an unknown word")
                continue
            self._step(token, begin + i)
            i += 1
        self.at = begin + n - len(self.rest)

    def _step(self, token: bytes, place: int) -> None:
        """One structural byte, or the first of a string or number."""
        if self.state in (VALUE, ITEM_OR_END):
            if token == b'"':
                self.state = IN_STRING
            elif token in (b"[", b"{"):
                self._open(token, place)
            elif token == b"]" and self.state == ITEM_OR_END:
                self._close(b"[", place)
            elif token == b"-":
                self.state = MINUS
            elif token.isdigit():
                self.state = ZERO if token == b"0" else WHOLE
            else:
                raise Fault(place, "a value is missing")
        elif self.state in (KEY, KEY_OR_END):
            if token == b'"':
                self.state = IN_KEY
            elif token == b"}" and self.state == KEY_OR_END:
                self._close(b"{", place)
            else:
                raise Fault(place, "a key is missing")
        elif self.state == COLON:
            if token != b":":
                raise Fault(place, "a colon is missing")
            self.state = VALUE
        elif not self.stack:
            raise Fault(place, "more than one value")
        elif token == b",":
            self.state = VALUE if self.stack[-1:] == b"[" else KEY
        elif token in (b"]", b"}"):
            self._close(b"[" if token == b"]" else b"{", place)
        else:
            raise Fault(place, "a comma is missing")

    def end(self) -> None:
        if self.rest or self.stack or not (self.state == AFTER or self.state in _COMPLETE):
            raise Fault(self.at, "the value is not complete")


def first_fault(ranges: Iterator[bytes], json: bool, whole: bool = True) -> tuple[str, int, str] | None:
    """(kind, place, reason) of a body's first fault. Without ``whole`` the body goes on behind the ranges."""
    coding, value, unfit, some = Utf8(), Json(), None, False
    try:
        for data in ranges:
            some = some or bool(data)
            coding.feed(data)
            if json and unfit is None:
                try:
                    value.feed(data)
                except Fault as f:  # a fault of the encoding further back in this range comes first
                    unfit = f
        if whole:
            coding.end()
    except Fault as f:
        if unfit is None or f.at <= unfit.at:
            return "encoding", f.at, f.why
    if json and some and whole and unfit is None:
        try:
            value.end()
        except Fault as f:
            unfit = f
    return None if unfit is None else ("json", unfit.at, unfit.why)


def _tail_fault(tail: bytes, begin: int) -> tuple[str, int, str] | None:
    """A tail may begin inside a character, of which it has at most three bytes."""
    cut = 0
    while cut < min(3, len(tail)) and tail[cut] & 0xC0 == 0x80:
        cut += 1
    found = first_fault(iter([tail[cut:]]), False)
    return found and (found[0], found[1] + begin + cut, found[2])


def _body_fault(read, size: int, json: bool, tier: str, span: int) -> tuple[str, int, str] | None:
    """``read(place, bytes)`` gives a range of a body of ``size`` bytes."""
    if tier == "quick" and size > 2 * WINDOW:
        return first_fault(iter([read(0, WINDOW)]), json, whole=False) or _tail_fault(read(size - WINDOW, WINDOW), size - WINDOW)
    return first_fault((read(lo, min(span, size - lo)) for lo in range(0, size, span)), json)


def _with_faults(keys: pa.RecordBatch, faults: list[tuple | None]) -> pa.RecordBatch:
    split = [[f and f[i] for f in faults] for i in range(3)]
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(split[0], pa.string()), pa.array(split[1], pa.int64()), pa.array(split[2], pa.string())],
                                      names=[*keys.schema.names, "fault", "at", "why"])


def _bodies(tier: str, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, json = b.column("__body"), b.column("__json").to_pylist()
            faults = []
            for i in range(b.num_rows):
                data = body[i].as_buffer()
                faults.append(None if data is None else _body_fault(lambda lo, n, data=data: data.slice(lo, n).to_pybytes(), data.size, json[i], tier, span))
            yield _with_faults(b.select([n for n in b.schema.names if n not in ("__body", "__json")]), faults)
    return run


def _files(tier: str, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            faults: list[tuple | None] = []
            for path, json in zip(b.column("path").to_pylist(), b.column("__json").to_pylist(), strict=True):
                try:
                    store, inner, _ = opened(path)
                    with store.open_input_file(inner) as f:
                        faults.append(_body_fault(lambda lo, n, f=f: f.read_at(n, lo), f.size(), json, tier, span))
                except (OSError, pa.ArrowException, ValueError) as e:  # what a store may say; the finding names it
                    faults.append(("unreadable", None, f"{type(e).__name__}: {e}"))
            yield _with_faults(b.select(["path"]), faults)
    return run


def _known(tier: str) -> str:
    if tier not in ("quick", "full"):
        raise ValueError(f"no such tier: {tier}")
    return tier


def body_faults(items: DataFrame, keys: list[str], body: Column, json: Column, tier: str = "full", span: int = RANGE) -> DataFrame:
    """The keys of every row with ``fault`` (encoding, json or null), ``at`` and ``why``; ``json`` holds where a body must be JSON."""
    given = items.select(*keys, body.cast("binary").alias("__body"), F.coalesce(json, F.lit(False)).alias("__json"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:len(keys)])
    return given.mapInArrow(_bodies(_known(tier), span), f"{fields}, {FAULTS}")


def file_faults(files: DataFrame, json: Column, tier: str = "full", span: int = RANGE) -> DataFrame:
    """path, fault (encoding, json, unreadable or null), at and why of every file listed by ``path``; a file is read by ranges
    of ``span`` bytes, so its size does not matter. Paths are dealt out anew: the files of one folder are read by many tasks."""
    given = files.select("path", F.coalesce(json, F.lit(False)).alias("__json")).repartition(F.col("path"))
    return given.mapInArrow(_files(_known(tier), span), f"path string, {FAULTS}")


def fault_findings(faults: DataFrame, *keys: str) -> DataFrame:
    """UNREADABLE, UNPARSEABLE (both end the item's checks) or DECODE_FAIL of each body with a fault, its place in the detail."""
    fault, where = F.col("fault"), text("byte ", F.col("at"), ": ", F.col("why"))
    return to_rows(faults, gather(
        finding(fault == "unreadable", "readable", "UNREADABLE", FAIL, "content could not be read", F.col("why"), terminal=True),
        finding(fault == "json", "structure", "UNPARSEABLE", FAIL, "content is not one JSON value", where, terminal=True),
        finding(fault == "encoding", "decode", "DECODE_FAIL", FAIL, "content does not decode (full)", where)), *keys)
