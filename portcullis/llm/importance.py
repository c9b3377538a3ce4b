"""Importance resampling towards a target distribution: hashed n-gram features, gains, Gumbel top-k.

1. **Features.** Separators collapse to single spaces; one overlapped regex scan, with lookarounds as
   boundaries, then emits the span of every run of ``low`` to ``high`` words, and the span's CRC picks a bucket.
2. **Gains.** Buckets are counted over all documents and over all target texts. Each partition sums its own
   counts first, so at most ``buckets`` rows leave it, and the driver receives one row for each bucket.
3. **Draw.** A document's weight is the sum of its features' gains; noise from a hash of its id is added, and
   the highest scores are drawn. Ranks come from a prefix sum over range partitions of (score, id).

The texts are scanned twice, which costs less than to keep their features; the gains have a fixed size and are
broadcast. Only ids and numbers are shuffled.

Defined results: null and empty texts have no words and features, weight 0, and are never drawn unless
``least_words`` is 0; a null id counts as the empty text in the noise and comes last among ties; repeated rows
are drawn each, and as equal rows they take neighbouring ranks; empty documents or targets count 0 everywhere.
Only the columns named below are returned, so other columns of the input cannot clash.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import small_batches, stored, text_bytes
from portcullis.operators.prefix import with_position

LOW, HIGH, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 1, 10_000, 10, 20, 2024
#: Lower-cases A-Z, keeps digits, letters and all bytes of other characters; everything else becomes a space.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scanner(k: int) -> regex.Pattern:
    """Spans of k consecutive words of a collapsed text."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (k - 1))


def collapsed(text: bytes) -> bytes:
    return b" ".join(text.translate(_KEPT).split())


def features(text: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """Bucket of every span of a collapsed text."""
    spans = (crc32(m[0]) for p in patterns for m in p.finditer(text, overlapped=True))
    return np.fromiter(spans, np.uint32) % np.uint32(buckets)


def _patterns(low: int, high: int) -> list[regex.Pattern]:
    if not 1 <= low <= high:
        raise ValueError("n-grams need 1 <= low <= high")
    return [scanner(k) for k in range(low, high + 1)]


def bucket_counts(texts: DataFrame, text_column: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """Columns bucket and n: features of all texts in each bucket that has any."""
    patterns = _patterns(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(features(collapsed(t), patterns, buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = small_batches(texts).select(text_bytes(text_column).alias("t")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """id, n_words, n_features and weight of every row."""
    patterns, shared = _patterns(low, high), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            words, counts, weights = [], [], []
            for t in b.column(1).to_pylist():
                t = collapsed(t)
                f = features(t, patterns, len(g))
                words.append(t.count(b" ") + 1 if t else 0)
                counts.append(len(f))
                weights.append(int(g[f].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (words, counts, weights)]],
                                             names=["id", "n_words", "n_features", "weight"])

    given = small_batches(docs).select(F.col(id_column).alias("id"), text_bytes(text_column).alias("t"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` has id, n_words and weight. Adds score and rank: of the N rows with at least ``least_words`` words,
    the floor(percent * N / 100) highest scores, ties to the smaller id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    fit = F.col("n_words") >= least_words
    scored = stored(rows.withColumn("score", F.col("weight") + noise))
    drawn = scored.where(fit).count() * percent // 100
    placed = with_position(scored, [fit.desc(), F.col("score").desc(), F.col("id").asc_nulls_last()], "place")
    return placed.withColumn("rank", F.when(fit & (F.col("place") <= drawn), F.col("place"))).drop("place")


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
             low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    counts = lambda df, c: {r.bucket: r.n for r in bucket_counts(df, c, low, high, buckets).collect()}  # noqa: E731  at most ``buckets`` rows
    gain = gains(counts(docs, text_column), counts(target, target_text), buckets)
    out = draw(weighted(docs, gain, id_column, text_column, low, high), percent, least_words, seed)
    return out.select(F.col("id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")
