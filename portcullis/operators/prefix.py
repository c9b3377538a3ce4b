"""Positions and running values over a global order, by a prefix sum over range partitions.

Rows are dealt by range of their order, sorted inside each partition and numbered there in one streaming
pass. What a partition needs from those before it is one small row per partition: the driver adds these up
and hands the sums back. A group may lie across any number of partitions, so a group with a third of all
rows is as many tasks as its share of the rows, and no task holds a group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from portcullis.session import kept

#: Bits of a partition's own row numbers in Spark's increasing ids.
_ROW_BITS = 33


def _dealt(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """Range partitions of the order. Equal rows are told apart by a hash of where they were read, so that many
    of them do not meet in one partition."""
    named = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [*order, F.col("__salt")]
    dealt = named.repartitionByRange(parts, *keys) if parts else named.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop("__salt")


def _joined(at: DataFrame, part: Column, values: dict[int, list[int]], names: list[str]) -> DataFrame:
    """Append the values of each row's partition, 0 where it has none. The table has a row for each partition, which
    bounds what is broadcast."""
    rows = [(int(p), *[int(x) for x in v]) for p, v in sorted(values.items())]
    small = at.sparkSession.createDataFrame(rows, "__p long, " + ", ".join(f"{n} long" for n in names))
    out = at.join(F.broadcast(small), part == F.col("__p"), "left").drop("__p")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})


def with_position(df: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """Append the place (from 1, long) of each row in the whole order; the frame is stored once, sorted. Rows that
    tie in ``order`` take neighbouring places in an arbitrary, but stored, order."""
    at = kept(_dealt(df, order, parts).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS)
    begins, total = {}, 0
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row a partition
        begins[r.p], total = total, total + r.n
    row = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    begun = _joined(at, part, {p: [n] for p, n in begins.items()}, ["__begin"])
    return begun.withColumn(name, row + 1 + F.col("__begin")).drop("__at", "__begin")


def _runs(keys: int, lanes: int):
    """Numbers the rows of a partition group by group and accumulates each lane by exclusive or. The first columns
    are those of the group, the partition and the lanes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, segment, count = None, 0, 0
        carry = [np.int64(0)] * lanes
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            if n > 1:
                for key in b.columns[:keys]:
                    a, z = key.slice(1), key.slice(0, n - 1)
                    differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(z)), pc.fill_null(pc.not_equal(a, z), False))
                    fresh[1:] |= np.asarray(differ.to_numpy(zero_copy_only=False), bool)
            first = tuple(key[0].as_py() for key in b.columns[:keys])
            fresh[0] = last is not None and first != last
            last = tuple(key[n - 1].as_py() for key in b.columns[:keys])
            number = np.cumsum(fresh)
            starts = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            place = np.arange(n) - starts + np.where(starts < 0, count - 1, 0)
            columns = [pa.array(number + segment, pa.int64()), pa.array(place + 1, pa.int64())]
            for i in range(lanes):
                values = b.column(keys + 1 + i).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.bitwise_xor.accumulate(values)
                before = np.concatenate([[np.int64(0)], upto[:-1]])
                # less what the group's own beginning had seen, or with what earlier batches carried
                base = np.where(starts < 0, carry[i], before[np.maximum(starts, 0)])
                columns.append(pa.array(before ^ base, pa.int64()))
                carry[i] = (before ^ base)[-1] ^ values[-1]
            segment, count = int(number[-1] + segment), int(place[-1] + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *columns],
                                             names=[*b.schema.names, "__segment", "__place", *[f"__before{i}" for i in range(lanes)]])
    return run


def with_group_position(df: DataFrame, group: str | list[str], order: list[Column], name: str = "position", xor: list[str] = (),
                        parts: int | None = None) -> DataFrame:
    """Append the place (from 1) of each row in its ``group`` (one column or several; null is a group) by ``order``, and for each
    long column of ``xor`` a column ``<column>_before``: the exclusive or over the group's earlier rows. The frame
    is stored once, sorted by group and order."""
    lanes, keys = list(xor), [group] if isinstance(group, str) else list(group)
    rest = [c for c in df.columns if c not in keys and c not in lanes]
    dealt = _dealt(df.select(*keys, *lanes, *rest), [*[F.col(k).asc_nulls_first() for k in keys], *order], parts)
    lined = dealt.select(*keys, F.spark_partition_id().cast("long").alias("__part"), *lanes, *rest)
    longs = ["__segment", "__place", *[f"__before{i}" for i in range(len(lanes))]]
    schema = StructType([*lined.schema.fields, *[StructField(c, LongType()) for c in longs]])
    at = kept(lined.mapInArrow(_runs(len(keys), len(lanes)), schema))
    end = F.struct(F.col("__segment"), F.col("__place"))
    tails = [F.max_by(F.col(f"__before{i}").bitwiseXOR(F.col(x)), end).alias(f"t{i}") for i, x in enumerate(lanes)]
    summary = at.groupBy("__part").agg(
        F.min_by(F.struct(*keys), end).alias("first"), F.max_by(F.struct(*keys), end).alias("last"),
        F.max("__segment").alias("segments"), F.max_by("__place", end).alias("n"), *tails).orderBy("__part").collect()
    carried: dict[int, list[int]] = {}
    before = None
    for r in summary:  # a row a partition: what the partition's first group has had in those before it
        has = [r.n, *[r[f"t{i}"] for i in range(len(lanes))]]
        if before is not None and before[0] == r["first"]:
            carried[r["__part"]] = before[1]
            if r.segments == 0:
                has = [has[0] + before[1][0], *[a ^ b for a, b in zip(has[1:], before[1][1:], strict=True)]]
        before = (r["last"], has)
    names = [f"__carry{i}" for i in range(1 + len(lanes))]
    known = _joined(at, F.when(F.col("__segment") == 0, F.col("__part")), carried, names)
    out = [(F.col("__place") + F.col("__carry0")).alias(name)]
    out += [F.col(f"__before{i}").bitwiseXOR(F.col(f"__carry{i + 1}")).alias(f"{x}_before") for i, x in enumerate(lanes)]
    return known.select(*df.columns, *out)
