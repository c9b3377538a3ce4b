"""Quality classifier: votes of the nearest labelled documents in a latent semantic space.

A bounded sample of labelled rows (``sample`` rows, those with the smallest hash of doc_id) gives the
term weights, the latent directions (a truncated SVD) and the labelled vectors; all three have fixed
sizes and are broadcast. Every document is then projected in blocks, its exact cosine with every
labelled vector is one matrix product, and the labels of its ``k`` nearest vote, weighted by
similarity. Scoring shuffles nothing.

Terms of a document: its words, their shapes (runs of upper, lower, digit and each other byte) and
how often a word or a pair of words repeats. Language, source, labels and ids are not among them.

Defined results: null and empty texts, and texts without any term known to the sample, score the
share of label 1 in the sample; without labelled rows every score is 0.5. Repeated rows are scored
each; labels that disagree on one document count as their mean; a null label is no label.
Ties among the nearest go to the earlier row of the sample.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from portcullis.llm.common import by_place, crc_rest, small_batches, text_bytes, tidy

#: Bounds of what is fitted and broadcast.
SAMPLE, WORD_TERMS, SHAPE_TERMS, DIRECTIONS, NEAREST = 8192, 2048, 1024, 48, 25
TERMS = WORD_TERMS + SHAPE_TERMS
#: Power of the cosine in a vote.
SHARPNESS = 4.0
BLOCK = 128
#: Distinct words whose terms one worker remembers.
REMEMBERED = 60_000


#: Byte classes: upper case, lower case and non-ASCII, digits; every other byte stands for itself.
_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Runs of upper-case, lower-case (or non-ASCII) and digit bytes as one letter each; runs of another byte as one."""
    s = word[:64].translate(_CLASSES)
    return b"a" if not s.strip(b"a") else _RUNS.sub(rb"\1", s)[:12]


class Terms(dict):
    """Word to (hash, word term, shape term) in one integer, remembered up to a bound."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.shapes.clear()
        h, form = xxhash.xxh3_64_intdigest(word), shape(word)
        s = self.shapes.get(form)
        if s is None:
            s = self.shapes[form] = WORD_TERMS + 8 + xxhash.xxh3_64_intdigest(form) % (SHAPE_TERMS - 8)
        t = self[word] = (h >> 34) << 32 | (h % WORD_TERMS) << 16 | s
        return t


def term_counts(text: bytes, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and their weights before the sample's term weights."""
    ws = text.split()
    if not ws:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    t = np.fromiter(map(terms.__getitem__, ws), np.int64, len(ws))
    counts = np.bincount((t >> 16) & 0xFFFF, minlength=TERMS) + np.bincount(t & 0xFFFF, minlength=TERMS)
    ids = t >> 32
    same = int((ids[1:] == ids[:-1]).sum())
    pairs = ids[1:] * 1_000_003 + ids[:-1]
    again = len(pairs) - len(np.unique(pairs))
    counts[WORD_TERMS], counts[WORD_TERMS + 1] = same, again
    at = np.nonzero(counts)[0]
    return at, np.sqrt(counts[at] / len(ws)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray      # of terms
    directions: np.ndarray   # terms x latent
    vectors: np.ndarray      # labelled x latent, of length 1
    labels: np.ndarray
    prior: float
    k: int

    def vector(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        v = (w * self.weights[at]) @ self.directions[at]
        size = float(np.sqrt((v * v).sum()))
        return v / size if size > 1e-9 else np.zeros(self.directions.shape[1], np.float32)

    def scores(self, block: np.ndarray) -> np.ndarray:
        out = np.full(len(block), self.prior)
        known = np.nonzero((block * block).sum(1) > 0.5)[0]
        if not len(self.labels) or not len(known):
            return out
        k = min(self.k, len(self.labels))
        cosine = block[known] @ self.vectors.T
        cut = -np.partition(-cosine, k - 1, axis=1)[:, k - 1:k]
        near = cosine >= cut
        # ties at the cut go to the earlier rows
        over = near.sum(1) > k
        for r in np.nonzero(over)[0]:
            tie = np.nonzero(cosine[r] == cut[r])[0]
            near[r, tie[k - int((cosine[r] > cut[r]).sum()):]] = False
        vote = np.where(near, np.maximum(cosine, 0.0) ** SHARPNESS, 0.0)
        total = vote.sum(1)
        got = (vote @ self.labels + 1e-6 * self.prior) / (total + 1e-6)
        out[known] = np.clip(got, 0.0, 1.0)
        return out


def fit_model(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int = NEAREST,
              directions: int = DIRECTIONS) -> Model:
    """Term weights, latent directions and labelled vectors of the bounded sample."""
    n = len(rows)
    if not n:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0), 0.5, k)
    a = np.zeros((n, TERMS), np.float32)
    for i, (at, w) in enumerate(rows):
        a[i, at] = w
    weights = (np.log((1 + n) / (1 + (a > 0).sum(0))) + 0.3).astype(np.float32)
    a *= weights
    a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)
    rng = np.random.default_rng(7)
    d = min(directions, n, TERMS)
    q = rng.standard_normal((TERMS, min(d + 16, TERMS))).astype(np.float32)
    for _ in range(6):  # subspace iteration
        q, _ = np.linalg.qr(a.T @ (a @ q))
    u, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    v = (q @ vt.T)[:, :d].astype(np.float32)
    model = Model(weights, v, np.zeros((0, d), np.float32), labels, float(labels.mean()), k)
    model.vectors = np.stack([model.vector(at, w) for at, w in rows]).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Text and label of at most ``sample`` labelled documents outside the held-out fifth."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_rest("doc_id", 5) != 0))
              .groupBy("doc_id").agg(F.avg("quality").cast("double").alias("_label"))
              .withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample)
              .select("doc_id", "_label", "_order"))
    # at most ``sample`` rows of three numbers: a proven bound
    return (docs.select("doc_id", text_bytes().alias("_text")).join(F.broadcast(chosen), "doc_id")
            .select("_order", "doc_id", "_label", "_text"))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    schema = pa.schema([("_order", pa.int64()), ("_label", pa.float64()), ("_at", pa.binary()), ("_w", pa.binary())])
    for b in batches:
        got = [term_counts(t, terms) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("_order"), b.column("_label"), pa.array([g[0].astype(np.uint16).tobytes() for g in got], pa.binary()),
             pa.array([g[1].tobytes() for g in got], pa.binary())], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = NEAREST) -> Model:
    """Fit on the bounded sample. The driver receives at most ``sample`` rows of term counts (one row for each
    document of the sample; repeated ids are taken once)."""
    rows = (small_batches(training_rows(docs, labels, sample))
            .mapInArrow(tidy(_count_rows), "_order long, _label double, _at binary, _w binary")
            .groupBy("_order", "_label").agg(F.min(F.struct("_at", "_w")).alias("r")).orderBy("_order").limit(sample).collect())
    got = [(np.frombuffer(r.r._at, np.uint16).astype(np.int64), np.frombuffer(r.r._w, np.float32)) for r in rows]
    return fit_model(got, np.array([r._label for r in rows], np.float64), k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and, behind them, _quality_score. Columns may have any names, that one as well."""
    return _scored(docs, model).toDF(*docs.columns, "_quality_score")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``; columns may have any names."""
    return _scored(docs, model).where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` by place, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = by_place(small_batches(docs))
    schema_in = given.withColumn("t", text_bytes(f"c{docs.columns.index('text')}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = shared.value, Terms()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            got = np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, BLOCK):
                part = texts.slice(lo, BLOCK).to_pylist()
                got[lo:lo + len(part)] = m.scores(np.stack([m.vector(*term_counts(t, terms)) for t in part]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], names=[*b.schema.names[:-1], "score"])

    return schema_in.mapInArrow(tidy(run), StructType([*given.schema.fields, StructField("score", DoubleType())]))
