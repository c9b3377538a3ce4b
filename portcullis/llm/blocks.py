"""A stated query set against all vectors, in blocks: packed segments of candidates meet packed blocks of
queries, and each query keeps its best few."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import stored

#: Rows of a segment, queries of a block, and queries whose best rows a task holds before it sends them on.
SEGMENT, QUERIES, HELD = 65_536, 64, 50_000
STEP = 4096


def _segments(size: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows packed into segments of one dimension."""
        def packed(ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rows[0].shape[1]], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                                               pa.array([np.concatenate(rows).tobytes()], pa.binary())], names=["dims", "ids", "v"])
        waiting: dict[int, tuple[list, list]] = {}
        for b in batches:
            ids, v = b.column("id").to_numpy(), b.column("v")
            offsets, flat = v.offsets.to_numpy(), v.values.to_numpy()
            sizes = np.diff(offsets)
            for dims in np.unique(sizes).tolist():
                at = np.nonzero(sizes == dims)[0]
                rows = flat[offsets[at][:, None] + np.arange(dims)].astype(kind)
                for lo in range(0, len(at), STEP):
                    held = waiting.setdefault(dims, ([], []))
                    held[0].append(ids[at[lo:lo + STEP]])
                    held[1].append(rows[lo:lo + STEP])
                    if sum(map(len, held[0])) > size - STEP:
                        yield packed(*waiting.pop(dims))
        for held in waiting.values():
            yield packed(*held)
    return run


def _pack_queries(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(x, np.int64).tobytes() for x in b.column("query_id").to_pylist()]
            v = [np.array(x, kind).tobytes() for x in b.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("dims"), b.column("block"), pa.array(ids, pa.binary()), pa.array(v, pa.binary())],
                                             names=["dims", "block", "query_ids", "query_v"])
    return run


def matrix(ids: bytes, v: bytes, dims: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(v, kind).reshape(len(i), dims)


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among a task's rows."""
        best: dict[int, list[tuple]] = {}
        kinds = None

        def held() -> pa.RecordBatch:
            flat = [(a, -s, -i) for a, h in best.items() for s, i in h]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in flat], kinds[j]) for j in range(3)], names=["query_id", "cost", "vec_id"])
        for b in batches:
            kinds = [c.type for c in b.columns]
            for a, s, i in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                h = best.setdefault(a, [])
                (heapq.heappush if len(h) < k else heapq.heappushpop)(h, (-s, -i))
            if len(best) > HELD:
                yield held()
        if kinds:
            yield held()
    return run


def search(rows: DataFrame, is_query: Callable, k: int, kind: str | Callable[[DataFrame], str], cost: str,
           best: Callable[[np.ndarray, np.ndarray], Callable[[int, np.ndarray], list[tuple]]], segment: int | None = None,
           block: int | None = None) -> DataFrame:
    """``rows``: id and v (an array without nulls). ``best(ids, matrix)`` indexes a segment and returns the function that
    maps (query id, query vector) to its k best (cost, id) there, cheapest first. ``kind`` is numpy's type of
    packed components, or gives it from the rows, ``cost`` Spark's type of costs. Returns query_id, rank, vec_id and cost.

    Segments are dealt to slots and query blocks to parts; each (slot, part) is one key, so the work of a
    query block is spread over all segments and none of it meets in one task."""
    rows = stored(rows)
    dtype = np.dtype(kind(rows) if callable(kind) else kind)
    segments = stored(rows.mapInArrow(_segments(segment or SEGMENT, dtype), "dims int, ids binary, v binary"))
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-queries.count() // (block or QUERIES)))
    blocks = (queries.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"))
              .groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("x"))
              .select("dims", "block", F.col("x.id").alias("query_id"), F.col("x.v").alias("query"))
              .mapInArrow(_pack_queries(dtype), "dims int, block long, query_ids binary, query_v binary"))
    slots = max(1, segments.count())
    parts = max(1, min(n_blocks, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // slots)))
    left = segments.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("long")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = blocks.withColumn("part", F.pmod("block", F.lit(parts)).cast("long")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Callable] | None = None
        cost_type = pa.int64() if cost == "long" else pa.float64()
        for b in batches:
            for r in b.to_pylist():
                if last is None or last[0] != r["ids"]:
                    last = r["ids"], best(*matrix(r["ids"], r["v"], r["dims"], dtype))
                out = [(int(a), c, i) for a, q in zip(*matrix(r["query_ids"], r["query_v"], r["dims"], dtype), strict=True) for c, i in last[1](int(a), q)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], cost_type),
                                                  pa.array([o[2] for o in out], pa.int64())], names=["query_id", "cost", "vec_id"])

    form = f"query_id long, cost {cost}, vec_id long"
    found = left.join(right, ["dims", "slot", "part"]).mapInArrow(run, form).mapInArrow(_merge(k), form)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cost")
