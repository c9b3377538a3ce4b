"""Signature scan: how an outcome is graded, and matching bodies against a signature table."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.operators.spread import with_stats
from portcullis.schema import BLOCK, FAIL, WARN, finding, gather, text, to_rows
from portcullis.session import fine_shuffles, kept


def effective_mode(mode: Column, forced: Column) -> Column:
    return F.when(forced & (mode == "off"), "optional").otherwise(mode)


def signature_policy(mode: Column, forced: Column, present: Column, size: Column, outcome: Column) -> Column:
    """Finding for one item. ``outcome``: clean, infected, or anything else for no verdict."""
    m = effective_mode(mode, forced)
    required, active = m == "required", m != "off"
    grade = F.when(required, FAIL).otherwise(WARN)
    big = size > T.SIGNATURE_MAX_BYTES
    missing = active & ~present & required
    running = active & present
    code = (F.when(missing, "SIGNATURE_MISSING").when(running & big, "SIGNATURE_ERROR")
             .when(running & (outcome == "infected"), "SIGNATURE_INFECTED")
             .when(running & (outcome != "clean"), "SIGNATURE_ERROR"))
    severity = F.when(code == "SIGNATURE_MISSING", FAIL).when(code == "SIGNATURE_INFECTED", BLOCK).otherwise(grade)
    message = (F.when(missing, "signature scan required by profile but not available")
                .when(running & big, text("item is ", size, " bytes and items larger than ", T.SIGNATURE_MAX_BYTES >> 20,
                                          " MiB cannot be scanned, so it was not scanned"))
                .when(outcome == "infected", "signature scan reports infected")
                .otherwise(text("signature scan gave no verdict: ", outcome)))
    return finding(code.isNotNull(), "signature", code, severity, message,
                   terminal=(code == "SIGNATURE_INFECTED") | required)


# --- matching -----------------------------------------------------------------------------------
#: Kinds of signatures by their bytes: (shortest, bytes of a run, runs in a window). Below the last kind a run is the
#: whole signature.
KINDS = [(47, 16, 32), (16, 8, 9), (8, 4, 5)]
#: Bytes of bodies that are hashed at a time; longer bodies are cut into overlapping pieces of half that size.
PIECE = 8 << 20
#: Bits of the bitmap of one kind's anchors.
BITS = 1 << 22


def _kind(length: Column) -> Column:
    """Number of a signature's kind: its place in ``KINDS``, or for shorter ones 100 and its bytes."""
    out = F.when(length < 1, None)
    for i, (shortest, _, _) in enumerate(KINDS):
        out = out.when(length >= shortest, i)
    return out.otherwise(100 + length).cast("int")


def _runs(kind: int) -> tuple[int, int]:
    return KINDS[kind][1:] if kind < 100 else (kind - 100, 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_minima(data: np.ndarray, kind: int) -> np.ndarray:
    """The least hash of each window of consecutive runs of bytes. Hashes of runs double in length, then the rest of a
    run's bytes is added; least hashes of windows double alike."""
    k, w = _runs(kind)
    n = len(data) - k + 1
    if n < w:
        return np.empty(0, np.uint64)
    h, span, factor = data.astype(np.uint64) + np.uint64(kind + 1), 1, 0x9E3779B97F4A7C15
    while span * 2 <= k:
        h, span, factor = h[:-span] * np.uint64(factor) + h[span:], span * 2, factor * factor % (1 << 64)
    h = h[:n]
    for j in range(span, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[j:j + n]
    h, span = _mixed(h), 1
    while span * 2 <= w:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return np.minimum(h[:len(h) - (w - span)], h[w - span:]) if w > span else h


def _pieces(texts: list[bytes | None], reach: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, bytes) of bounded groups; a text's pieces overlap by ``reach``."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for lo in range(0, len(text or b""), PIECE // 2):
            piece = text[lo:lo + PIECE // 2 + reach]
            group.append((row, piece))
            size += len(piece)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _minima(ids: pa.Array, texts: list[bytes | None], kind: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, kind, gram) of each text's distinct window minima; with ``bits`` only of those whose bit is set."""
    k, w = _runs(kind)
    for group in _pieces(texts, k + w - 2):
        least = window_minima(np.frombuffer(b"".join(t for _, t in group), np.uint8), kind)
        sizes = np.array([len(t) for _, t in group])
        begins = np.cumsum(sizes) - sizes
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[begins[begins < len(least)]] = True  # a window across two texts must not hide the next one
        at = np.nonzero(fresh)[0]
        if bits is not None:
            slot = (least[at] % np.uint64(BITS)).astype(np.int64)
            at = at[bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0]
        piece = np.searchsorted(begins, at, side="right") - 1
        inside = at + k + w - 1 <= begins[piece] + sizes[piece]
        at, row = at[inside], np.array([r for r, _ in group], np.int64)[piece[inside]]
        gram = least[at].view(np.int64)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        once = np.ones(len(row), bool)
        once[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        row, gram = row[once], gram[once]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(np.full(len(row), kind, np.int32)), pa.array(gram)], names=["id", "kind", "gram"])


def anchors(signatures: DataFrame) -> DataFrame:
    """(sig_id, kind, gram): for every signature text the window minimum that the fewest signatures have. A text that
    holds the signature has all of the signature's windows, so it has that minimum too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, texts = b.column("kind").to_numpy(), b.column("text").to_pylist()
            for kind in np.unique(kinds).tolist():
                yield from _minima(b.column("id"), [t if o == kind else None for t, o in zip(texts, kinds.tolist(), strict=True)], kind, None)

    given = signatures.select(F.col("sig_id").alias("id"), F.col("text").cast("binary").alias("text"), _kind(F.octet_length("text")).alias("kind")).where("kind IS NOT NULL")
    grams = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, kind int, gram long")
    counted = with_stats(grams, ["gram"], {"n": ("count", F.lit(1))})
    best = F.min(F.struct("n", "gram", "kind"))
    return counted.groupBy("id").agg(best.alias("a")).select(F.col("id").alias("sig_id"), "a.kind", "a.gram")


def _filters(anchored: DataFrame) -> dict[int, np.ndarray]:
    """For each kind of signature there is a bitmap of its anchors. Of fixed size, whatever the number of signatures: at
    most ten kinds of ``BITS`` bits, which also bounds what the driver receives and broadcasts."""
    slot = F.expr(f"pmod(gram, {BITS})")  # BITS divides two to the 64th, so signed and unsigned numbers agree
    words = (anchored.select("kind", slot.alias("slot")).groupBy("kind", F.shiftright("slot", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 31 AS INT))")).alias("bits")).collect())
    out: dict[int, np.ndarray] = {}
    for r in words:
        out.setdefault(r.kind, np.zeros(BITS // 32, np.uint32))[r.word] = r.bits
    return {kind: bits.view(np.uint8) for kind, bits in out.items()}


def _spoken(bodies: DataFrame, filters: dict[int, np.ndarray]) -> DataFrame:
    """(item_id, kind, gram) of the bodies' window minima that may be anchors."""
    shared = bodies.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("body").to_pylist()
            for kind, bits in shared.value.items():
                yield from _minima(b.column("item_id"), texts, kind, bits)

    given = bodies.select("item_id", F.col("body").cast("binary").alias("body"))
    return given.mapInArrow(run, f"id {given.schema['item_id'].dataType.simpleString()}, kind int, gram long").withColumnRenamed("id", "item_id")


def _same(text: str) -> Column:
    """Equal for equal texts."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def signature_match(items: DataFrame, signatures: DataFrame) -> DataFrame:
    """(item_id, sig_id, how): digest equality, or the signature's text inside the body.

    Bodies and signatures of any length meet in one way: of every window of consecutive runs of bytes only the least
    hash counts, and a signature is found by the rarest of its windows. A bitmap of fixed size keeps the hashes of
    bodies that are no anchors from leaving their task; the rest joins the anchors, by whatever join Spark picks. Copies
    of a text meet as one: pairs are of different texts, a signature's text goes to its pairs, and a body moves once
    to all of its pairs, where ``contains`` confirms them. Null bodies and empty or null signatures match nothing by
    text."""
    exact = (items.select("item_id", F.sha2("body", 256).alias("digest"))
             .join(signatures.select("sig_id", "digest"), "digest").select("item_id", "sig_id", F.lit("digest").alias("how")))
    fine_shuffles(items.sparkSession)
    told = signatures.where("text IS NOT NULL").select("sig_id", "text", _same("text").alias("same"))
    texts = kept(told.groupBy("same").agg(F.min("sig_id").alias("sig_id"), F.first("text").alias("text")))
    members = told.select("same", "sig_id").join(texts.select("same", F.col("sig_id").alias("first")), "same").drop("same")
    anchored = kept(anchors(texts))
    spoken = items.where("body IS NOT NULL").select("item_id", "body", _same("body").alias("same"))
    pairs = (_spoken(spoken.select(F.col("same").alias("item_id"), "body"), _filters(anchored)).join(anchored, ["kind", "gram"])
             .select(F.col("item_id").alias("same"), F.col("sig_id").alias("first")).distinct())
    asked = pairs.join(texts.select(F.col("sig_id").alias("first"), "text"), "first")
    hits = (spoken.join(asked, "same").where(F.contains("body", "text")).select("item_id", "first")
            .join(members, "first").select("item_id", "sig_id", F.lit("text").alias("how")))
    # A digest hit is also a text hit; the digest is named.
    return exact.unionByName(hits).groupBy("item_id", "sig_id").agg(F.min("how").alias("how"))


def signature_findings(items: DataFrame, matches: DataFrame) -> DataFrame:
    """SIGNATURE_INFECTED per item with the number of signatures and the first of them."""
    hit = matches.groupBy("item_id").agg(F.count("*").alias("n"), F.min("sig_id").alias("first"))
    return to_rows(hit, gather(finding(F.lit(True), "signature", "SIGNATURE_INFECTED", BLOCK,
                                       text(F.col("n"), " signature(s) matched, first #", F.col("first")),
                                       terminal=True)), "item_id")


# --- identity -------------------------------------------------------------------------------------
def multi_named(items: DataFrame, digest: str = "digest") -> DataFrame:
    """Append how many items have the same content. A third of all items may be copies of one: the
    count is built per slice of the copies and joined back per slice."""
    return with_stats(items, [digest], {"copies": ("count", F.lit(1))})

