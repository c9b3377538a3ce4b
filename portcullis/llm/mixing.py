"""Mixing sources to target weights by entropy balancing.

Sources, in code point order with null last, take the weights of a repeating cycle and share a multiple
of all words. A share above twice its source's words stops there, and the excess goes to the others by
weight until none is above. Among all document rates between 0 and 2 that give every source its target,
the mix is the one closest to one copy of each document in relative entropy: rates ``min(2, exp(lambda *
size / mean size))``, tilted by one dual variable for each source. The dual is convex; each Newton
iteration is one aggregate over (source, size) cells, safeguarded by a bracket, and the cells are exact
as documents of one source and size have one rate. Rates become copies cell by cell from the longest
size down, the rounding error of each cell (in words) is carried to the next one, and inside a cell the
copies go to the documents with the smallest hashes of their id.

Cells are far fewer than rows, documents are joined to their cells, and ranks inside a cell are taken in
slices of about ``SLICE`` rows, so neither a hot source nor a hot size meets in one task.

Defined results: null and empty texts have size 0 and take 0; a source without words has target 0; null
is a source of its own; rows that share an id and a size are ordered arbitrarily but give the same
multiset of results; an empty table gives an empty result. Other columns are not returned.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import by_place, small_batches, stored, text_bytes, tidy

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Newton stops when no source misses its target by more than this share, or after so many rounds.
CLOSE, ROUNDS = 1e-10, 60
SLICE = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [len(t.split()) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(sizes, pa.int64())], names=["id", "source", "size"])


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """id, source and size (words) of every row."""
    given = small_batches(docs).select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), text_bytes(text_column).alias("_text"))
    return given.mapInArrow(tidy(_sizes), f"id {given.schema['id'].dataType.simpleString()}, source string, size long")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last: sorted by range, then counted on from
    partition to partition (the driver sees one number of rows for each partition)."""
    ordered = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    begins, total = {}, 0
    for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().orderBy("p").collect():
        begins[r.p], total = total, total + r["count"]
    if not begins:
        return ordered.withColumn("place", F.col("_at")).drop("_at")
    first = F.create_map(*[F.lit(int(x)) for pair in begins.items() for x in pair])
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + first[F.shiftright("_at", 33)]
    return ordered.withColumn("place", place).drop("_at")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` has source and words. Adds target."""
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    at = stored(numbered(sources).withColumn("weight", weight).withColumn("most", F.col("words") * F.lit(float(most))))
    total = share * (at.agg(F.sum("words")).first()[0] or 0)
    level = None
    # each round sums over the sources that stop at their bound; the level only rises
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("most")
        r = at.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"),
                   F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("n")).first()
        if not r.free or (level is not None and r.n == stopped):
            break
        stopped, level = r.n, (total - r.used) / r.free
    return at.select("source", "words", F.least("most", F.col("weight") * F.lit(level if level is not None else 0.0)).alias("target"))


def balance(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cells``: source, size, n; ``wanted``: source, words, docs, target. Adds the dual variable ``dual`` of each
    source by Newton iterations on all sources at once."""
    low, high = -float("inf"), float("inf")
    state = stored(wanted.withColumn("mean", F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9))).select(
        "source", "words", "target", "mean", F.lit(0.0).alias("dual"), F.lit(low).alias("low"), F.lit(high).alias("high"),
        # a target at twice the words needs an infinite tilt: its rates are 2 without iterating
        ((F.col("target") >= F.col("words") * (MOST - 1e-12)) | (F.col("words") == 0)).alias("done")))
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("dual") * x, F.lit(50.0))))
    for _ in range(ROUNDS):
        if state.where("NOT done").isEmpty():
            break
        sums = (cells.join(state.where("NOT done").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                .groupBy("source").agg(
                    F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                    F.sum(F.when(rate < MOST, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
                .withColumnRenamed("source", "_s"))
        j = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        miss = F.col("got") - F.col("target")
        lower = F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))
        upper = F.when(miss > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - F.try_divide(miss, F.col("slope"))
        # outside the bracket, or where no rate is free, halve or stretch it instead
        middle = (F.when(F.col("_lo") == low, F.col("_hi") * 2 - 1).when(F.col("_hi") == high, F.col("_lo") * 2 + 1)
                  .otherwise((F.col("_lo") + F.col("_hi")) / 2))
        close = F.abs(miss) <= F.col("target") * CLOSE
        state = stored(j.withColumn("_lo", lower).withColumn("_hi", upper).withColumn("_new", newton).withColumn("_close", close).select(
            "source", "words", "target", "mean",
            F.when(F.col("done") | F.col("_close"), F.col("dual"))
            .when((F.col("_new") > F.col("_lo")) & (F.col("_new") < F.col("_hi")), F.col("_new")).otherwise(middle).alias("dual"),
            F.when(F.col("done"), F.col("low")).otherwise(F.col("_lo")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.col("_hi")).alias("high"),
            (F.col("done") | F.col("_close")).alias("done")))
    else:
        if not state.where("NOT done").isEmpty():
            raise ArithmeticError(f"the tilts of some sources have not met their targets after {ROUNDS} rounds")
    return state.select("source", "words", "target", "mean", "dual")


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source, from the longest size down; the error in words is carried on.
    A source has at most as many cells as its longest text has words."""
    cells = cells.sort_values("size", ascending=False)
    out, carry = np.zeros(len(cells), np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True)):
        if size:
            want = rate * n * size + carry
            copies = min(max(round(want / size), 0), MOST * n)
            out[i], carry = copies, want - copies * size
    return cells.assign(copies=out)[["source", "size", "copies"]]


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """id, size, source_size, target, taken and copies of every row."""
    return _planned(docs, id_column, source_column, text_column).drop("source").toDF(id_column, "size", "source_size", "target", "taken", "copies")


def _planned(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """id, source, size, words, target, taken and copies of every row."""
    rows = stored(sized(docs, id_column, source_column, text_column))
    cells = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    wanted = targets(sources).withColumnRenamed("source", "_s")
    wanted = sources.join(wanted.drop("words"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = balance(cells, stored(wanted))
    tilt = F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(50.0)))
    full = F.col("target") >= F.col("words") * (MOST - 1e-12)
    rated = cells.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "n", "words", "target", F.when(full, float(MOST)).otherwise(F.least(F.lit(float(MOST)), tilt)).alias("rate"))
    rated = stored(rated)
    copies = rated.select("source", "size", "n", "rate").groupBy("source").applyInPandas(_round, "source string, size long, copies long")
    plan = (rated.drop("rate").alias("r").join(copies.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")))
            .select("r.source", "r.size", "n", "words", "target", "copies"))
    return _spread(rows, stored(plan))


def _spread(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies of a cell dealt to its documents by the rank of their hash: every document has the whole
    quotient, the first ranks one more. Slices of a cell by hash range keep the ranks out of one task."""
    from pyspark.sql import Window
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "words", "target", "copies",
                    F.ceil(F.col("n") / SLICE).alias("slices"))
    h = F.shiftrightunsigned(F.xxhash64("id"), 33)  # 31 bits
    at = rows.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        "id", "source", "size", "n", "words", "target", "copies", h.alias("h"),
        F.shiftright(h * F.col("slices"), 31).alias("slice"))
    # slices are counted first; only cells of several slices need the counts
    keys = ["source", "size", "slice"]
    counts = at.where(F.col("n") > SLICE).groupBy(*keys).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("slice").alias("_l"), before.alias("begin"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
    ranked = at.withColumn("rank", rank).join(
        begins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("slice") == F.col("_l")), "left")
    place = F.col("rank") + F.coalesce("begin", F.lit(0))
    each = F.floor(F.col("copies") / F.col("n"))
    n = each + F.when(place <= F.col("copies") - each * F.col("n"), 1).otherwise(0)
    return ranked.select("id", "source", "size", "words", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def repeated(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, whose columns may have any names, as often as the mix takes them. Rows that share an id,
    source and size share their copies as evenly as the mix dealt them."""
    place = lambda c: f"c{docs.columns.index(c)}"
    return _repeated(by_place(docs), place(id_column), place(source_column), place(text_column)).toDF(*docs.columns)


def _repeated(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    from pyspark.sql import Window
    plan = _planned(docs, id_column, source_column, text_column)
    groups = stored(plan.groupBy(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_s2")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    with_size = small_batches(docs).withColumn("_size", _words(text_bytes(text_column)))
    # every document has a row in the plan: both sides grow alike, so the join is a shuffled one at every size
    joined = with_size.join(groups.where("_copies > 0").hint("merge"), F.col(id_column).eqNullSafe(F.col("_id"))
                            & F.col(source_column).cast("string").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_s2")))
    if groups.where("_rows > 1").isEmpty():
        return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64(text_column)))
    each = F.floor(F.col("_copies") / F.col("_rows"))
    n = each + F.when(rank <= F.col("_copies") - each * F.col("_rows"), 1).otherwise(0)
    return (joined.withColumn("_n", n.cast("int")).where("_n > 0")
            .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns))


def _words(column):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(t.split())).astype("int64")
    return count(column)
