"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: rows are centred and projected, and a rotation is fitted so that their signs lose as
little as possible (iterative quantisation); several rotations from different starts are put side by
side into one code of ``BITS`` bits. The fit uses a bounded sample (``SAMPLE`` rows, those with the
smallest hash of their id); every row is coded and indexed.

A code is cut into substrings of 16 bits, each with a table of its own. Codes within Hamming radius
``m (a + 1) - 1`` of a query agree with it in at least one of the m substrings up to a bits, so probing all
buckets within a bits of the query's substrings finds every one of them. The radius grows until at least
``WANTED`` codes of a segment lie within it (or all rows are found), and these are reranked by their
exact distance on the original vectors. Nothing within the radius is left out, and no bucket is capped.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; a query is
compared with vectors of its own dimension and never with rows of its own id; rows that repeat a vec_id
are candidates each, queries that repeat an id are answered once (from the smallest vector); ties go to
smaller ids; a null id is no query and no candidate.
"""
from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.blocks import search
from portcullis.llm.common import stored

BITS, SUBSTRING, WANTED, SAMPLE, ROUNDS = 256, 16, 256, 4096, 25
#: Substrings that differ from a given one in exactly a bits: that one XOR each of MASKS[a].
MASKS = [np.array([sum(1 << i for i in c) for c in itertools.combinations(range(SUBSTRING), a)], np.int64) for a in range(SUBSTRING + 1)]


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    given = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return given.where("id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(fine, F.lit(False)))


class Codes:
    """Learned projections of one dimension."""

    def __init__(self, sample: np.ndarray, dims: int, bits: int = BITS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed + dims)
        self.mean = sample.mean(0) if len(sample) else np.zeros(dims)
        centred = sample - self.mean
        _, s, vt = np.linalg.svd(centred, full_matrices=False) if len(sample) > 1 else (0, np.zeros(0), np.eye(dims))
        basis = vt.T if len(vt) >= min(dims, 2) and len(sample) > 1 else np.eye(dims)
        low = centred @ basis
        parts = []
        while sum(p.shape[1] for p in parts) < bits:
            r, _ = np.linalg.qr(rng.standard_normal((basis.shape[1], basis.shape[1])))
            for _ in range(ROUNDS if len(sample) > 1 else 0):
                u, _, w = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
                r = (u @ w).T
            parts.append(basis @ r)
        self.projection = np.concatenate(parts, axis=1)[:, :bits]

    def of(self, v: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings, one row for each vector."""
        out = np.empty((len(v), self.projection.shape[1] // 8), np.uint8)
        for lo in range(0, len(v), 8192):
            out[lo:lo + 8192] = np.packbits((v[lo:lo + 8192] - self.mean) @ self.projection >= 0, axis=1)
        return out.view(np.uint16)


class Index:
    """One table for each substring: rows in the order of their substring, and where each value begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.n, self.m = codes.shape
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(self.m)]
        self.begin = [np.searchsorted(codes[o, j], np.arange((1 << SUBSTRING) + 1)).astype(np.int32) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, wanted: int) -> np.ndarray:
        """All rows within the smallest probed radius that holds ``wanted`` rows, or all rows."""
        found = np.zeros(self.n, bool)
        wide = np.ascontiguousarray(code).view(np.uint64)
        for a in range(SUBSTRING + 1):
            for j in range(self.m):
                value = MASKS[a] ^ int(code[j])
                lo = self.begin[j][value]
                size = self.begin[j][value + 1] - lo
                hit = size > 0
                lo, size = lo[hit], size[hit]
                ends = np.cumsum(size)
                if len(ends):
                    found[self.order[j][np.arange(ends[-1]) + np.repeat(lo - ends + size, size)]] = True
            rows = np.nonzero(found)[0]
            if len(rows) < min(wanted, self.n):
                continue
            distance = np.bitwise_count(self.wide[rows] ^ wide).sum(1)
            rows = rows[distance <= self.m * (a + 1) - 1]
            if len(rows) >= wanted:
                return rows
        return np.arange(self.n)


def neighbours(df: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", wanted: int = WANTED,
               sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest found."""
    rows = stored(usable(df, id_column, vector_column))
    # at most ``sample`` rows, whatever the table
    learned = [np.array(r.v) for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()]
    by_dims = {d: np.stack([v for v in learned if len(v) == d]) for d in {len(v) for v in learned}}
    fitted = rows.sparkSession.sparkContext.broadcast({d: Codes(s, d, bits) for d, s in by_dims.items()})

    def best(ids: np.ndarray, v: np.ndarray):
        dims = v.shape[1]
        codes = fitted.value.get(dims) or Codes(np.zeros((0, dims)), dims, bits)
        coded = codes.of(v)
        index = Index(coded)

        def nearest(query_id: int, q: np.ndarray) -> list[tuple[float, int]]:
            at = index.within(codes.of(q[None])[0], wanted + k)
            at = at[ids[at] != query_id]
            distance = np.sqrt(((v[at] - q) ** 2).sum(1))
            first = np.lexsort((ids[at], distance))[:k]
            return [(float(distance[i]), int(ids[at[i]])) for i in first]
        return nearest

    return search(rows, is_query, k, "f8", "double", best).withColumnRenamed("cost", "score")
