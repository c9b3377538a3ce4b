"""Exact top-k by inner product over a bit-sliced index.

Components become integers ``floor(256 * x)``; shifted to be non-negative, each attribute is stored as
slices, one bitmap for each binary digit with one bit for each row of a segment. A query's scores are
again a bit-sliced number: attribute slices are added, shifted by the digits of the query's component,
with bitmap AND, XOR and OR (carry-save addition), 64 rows with each machine word. The top rows are then
selected from the most significant slice of the sum downward: the rows that have the digit stay as long as
they are at least k. The rows above the k-th score are settled by the slices alone; among those equal to
it, the boundary, the smaller ids win.

The sums first use the leading digits of every attribute (``LEADING``). What the dropped digits can add
is bounded exactly for each query, so only rows whose leading sum is within that bound of the k-th best
remain; their scores are then resolved exactly. Nothing is approximate.

Candidates come in segments, queries in blocks; every pair of a segment and a query block is one row of work, each query keeps k rows for each segment, and a second aggregate merges these. Queries are a
stated set against all rows, in blocks.

Defined results: vectors that are null or hold null or non-finite components take no part, on either side;
a query is compared with vectors of its own dimension only; an empty vector scores 0; rows that repeat
a vec_id are candidates each, and a query never meets rows of its own id; queries that repeat an id are
answered once (from the row with the smallest vector); a null id is no query and no candidate.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.blocks import search

SCALE = 256
#: Digits of a stored attribute, from the top, that the bitmap sums use.
LEADING = 6


def quantised(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (integers) of the rows that take part."""
    x = F.col("v").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return given.select("id", x.alias("v")).where(F.coalesce(finite, F.lit(False))).select(
        "id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def packed_kind(rows: DataFrame, is_query) -> str:
    """numpy's narrowest type that holds every component. An error where an inner product may leave 64 bits."""
    weight = F.aggregate("v", F.lit(0.0), lambda total, c: total + F.abs(c.cast("double")))
    r = rows.agg(F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo"), F.max(F.when(is_query(F.col("id")), weight)).alias("most")).first()
    most = max(abs(r.hi or 0), abs(r.lo or 0))
    if most * (r.most or 0.0) >= 2.0 ** 62:
        raise OverflowError(f"components up to {most} against a query of weight {r.most:g}: an inner product may leave 64 bits")
    return next(kind for kind, bits in (("i2", 15), ("i4", 31), ("i8", 63)) if most < 1 << bits)


class Slices:
    """The index of one segment: for each attribute its least value and its bitmaps, lowest digit first."""

    def __init__(self, q: np.ndarray) -> None:
        self.n, dims = q.shape
        self.low = q.min(0) if self.n else np.zeros(dims, np.int64)
        shifted = (q - self.low).astype(np.uint64)
        self.width = [int(shifted[:, d].max()).bit_length() if self.n else 0 for d in range(dims)]
        self.words = (self.n + 63) // 64
        self.maps: list[list[np.ndarray]] = []
        for d in range(dims):
            digits = []
            for b in range(self.width[d]):
                bits = np.zeros(self.words * 64, np.uint8)
                bits[:self.n] = (shifted[:, d] >> np.uint64(b)) & np.uint64(1)
                digits.append(np.packbits(bits, bitorder="little").view(np.uint64))
            self.maps.append(digits)


class Columns(list):
    """Bitmaps by weight: column i holds bitmaps that each count 2**i. ``settled`` adds them up by full
    adders until every weight has one bitmap: the sum's own slices."""

    def put(self, weight: int, bitmap: np.ndarray) -> None:
        while len(self) <= weight:
            self.append([])
        self[weight].append(bitmap)

    def settled(self, words: int) -> list[np.ndarray]:
        out, i = [], 0
        while i < len(self):
            column = self[i]
            while len(column) > 1:
                if len(column) >= 3:
                    a, b, c = column.pop(), column.pop(), column.pop()
                    ab = a ^ b
                    column.insert(0, ab ^ c)
                    self.put(i + 1, (a & b) | (ab & c))
                else:
                    a, b = column.pop(), column.pop()
                    column.insert(0, a ^ b)
                    self.put(i + 1, a & b)
            out.append(column[0] if column else np.zeros(words, np.uint64))
            i += 1
        return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def leading_sum(index: Slices, query: np.ndarray, leading: int) -> tuple[list[np.ndarray], int, int]:
    """Slices of the leading sum, its shift to the real score, and how much the dropped digits may add. Negative factors count the complement of a slice: -w * b = w * (1 - b) - w."""
    columns, shift, slack = Columns(), int((index.low * query).sum()), 0
    ones = None
    for d, factor in enumerate(query.tolist()):
        size = abs(factor)
        if not size:
            continue
        for b, bitmap in enumerate(index.maps[d]):
            if b < index.width[d] - leading:
                slack += size << b
                shift -= size << b if factor < 0 else 0
                continue
            if factor < 0:
                if ones is None:
                    ones = np.full(index.words, 0xFFFFFFFFFFFFFFFF, np.uint64)
                bitmap = bitmap ^ ones
                shift -= size << b
            w = 0
            while size >> w:
                if size >> w & 1:
                    columns.put(b + w, bitmap)
                w += 1
    return columns.settled(index.words), shift, slack


def at_least(slices: list[np.ndarray], bound: int, alive: np.ndarray) -> np.ndarray:
    """Rows of ``alive`` whose number is ``bound`` or more, by comparing digits from the top."""
    if bound <= 0:
        return alive
    if bound.bit_length() > len(slices):
        return np.zeros_like(alive)
    equal, more = alive, np.zeros_like(alive)
    for i in range(len(slices) - 1, -1, -1):
        if bound >> i & 1:
            equal = equal & slices[i]
        else:
            more = more | (equal & slices[i])
            equal = equal & ~slices[i]
    return more | equal


def kth_largest(slices: list[np.ndarray], k: int, alive: np.ndarray) -> int:
    """The k-th largest number among the rows alive (k of them at least): from the top digit down, the
    rows that have the digit stay if they are enough, otherwise they are counted off."""
    value, left, rows = 0, k, alive
    for i in range(len(slices) - 1, -1, -1):
        with_digit = rows & slices[i]
        c = count(with_digit)
        if c >= left:
            rows, value = with_digit, value | 1 << i
        else:
            left -= c
            rows = rows & ~slices[i]
    return value


def top_rows(index: Slices, ids: np.ndarray, q: np.ndarray, query_id: int, query: np.ndarray, k: int,
             leading: int = LEADING) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a segment, ties to smaller ids."""
    alive_bits = np.zeros(index.words * 64, np.uint8)
    alive_bits[:index.n] = ids != query_id
    alive = np.packbits(alive_bits, bitorder="little").view(np.uint64)
    n = count(alive)
    if not n:
        return []
    slices, _, slack = leading_sum(index, query, leading)
    # the dropped digits of a row add between 0 and slack to its leading sum
    rows = at_least(slices, kth_largest(slices, min(k, n), alive) - slack, alive)
    at = np.nonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))[0]
    scores = q[at] @ query
    best = np.lexsort((ids[at], -scores))[:k]
    return [(int(scores[i]), int(ids[at[i]])) for i in best]


def top_k(df: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    def best(ids: np.ndarray, q: np.ndarray):
        wide = q.astype(np.int64)
        index = Slices(wide)
        return lambda query_id, query: [(-s, i) for s, i in top_rows(index, ids, wide, query_id, query.astype(np.int64), k)]

    found = search(quantised(df, id_column, vector_column), is_query, k, lambda rows: packed_kind(rows, is_query), "long", best)
    return found.select("query_id", "rank", "vec_id", (-F.col("cost")).alias("score"))
