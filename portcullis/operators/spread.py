"""Group statistics and running values that survive one group holding a third of all rows.

A window over a hot group sends the whole group to one task. Statistics are therefore aggregates that are
joined back, and windows serve only where the size of groups is known to be bounded. Running values first reduce rows per (group, block), where a block is a slice of the
group's order of 65 536 places; the block rows are combined per group and joined back on (group, block).
Where numbers are sparse a block holds few rows and the block rows are as many as the group's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.operators.prefix import with_group_position
from portcullis.session import fine_shuffles, kept

BLOCK_ROWS = 65536


def block_of(order: str, size: int = BLOCK_ROWS) -> Column:
    """Slice of a whole-number order column."""
    return F.expr(f"`{order}` div {size}L")


def _join_back(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    condition = None
    for k in keys:
        c = rows[k].eqNullSafe(renamed[f"__k_{k}"])
        condition = c if condition is None else condition & c
    return rows.join(renamed, condition, "left").drop(*[f"__k_{k}" for k in keys])


def bounded_numbers(rows: DataFrame, order: str, size: int = BLOCK_ROWS) -> bool:
    """Whether all numbers lie in one block, so that a group of distinct numbers has at most ``size`` rows. A read of the
    number alone, and of no more than the statistics of its files where it is a column of a table."""
    return rows.filter((F.col(order) < 0) | (F.col(order) >= size) | F.col(order).isNull()).isEmpty()


def _apart(rows: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``size`` rows, and those of larger groups (None where there are none). Larger groups are
    at most one for every ``size`` rows, so their keys are few enough to broadcast."""
    hot = kept(rows.groupBy(*keys).count().filter(F.col("count") > size).select(*keys, F.lit(True).alias("__hot")))
    if hot.isEmpty():
        return rows, None
    flagged = _join_back(rows, F.broadcast(hot), keys)
    return flagged.filter("__hot IS NULL").drop("__hot"), flagged.filter("__hot").drop("__hot")


_AGGREGATE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def with_stats(rows: DataFrame, keys: list[str], stats: dict[str, tuple[str, Column]], near: bool = False) -> DataFrame:
    """Append group-level ``stats`` (name -> (min|max|sum|count, expression)) to every row.

    ``near`` says that groups are bounded (``bounded_numbers``): then one pass of windows over dealt rows does it.

    The statistics are one aggregate, combined before the shuffle, so a hot group sends one row from each
    task; the join that brings them back has one row a group on its small side, and Spark splits the
    large side where a group is hot (or broadcasts the small one where it is small)."""
    if near:
        over = Window.partitionBy(*keys)
        return rows.withColumns({name: _AGGREGATE[how](expr).over(over) for name, (how, expr) in stats.items()})
    merged = rows.groupBy(*keys).agg(*[_AGGREGATE[how](expr).alias(name) for name, (how, expr) in stats.items()])
    return _join_back(rows, merged, keys)


def with_ordinal(rows: DataFrame, keys: list[str], order: str, name: str,
                 counted: Column | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """Append the running count (1-based) of ``counted`` rows in the group's order."""
    fine_shuffles(rows.sparkSession)
    hit = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    if bounded_numbers(rows, order, size):
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(hit).over(upto).cast("long"))
    blocked = rows.withColumn("__hit", hit).withColumn("__block", block_of(order, size))
    partial = blocked.groupBy(*keys, "__block").agg(F.sum("__hit").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.select(*keys, "__block",
                             F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = (Window.partitionBy(*keys, "__block").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, 0))
    joined = _join_back(blocked, offsets, [*keys, "__block"])
    return (joined.withColumn(name, (F.col("__before") + F.sum("__hit").over(local)).cast("long"))
                  .drop("__hit", "__block", "__before"))


def with_carry(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: str,
               name: str, *, include_current: bool) -> DataFrame:
    """Append the last non-NULL ``value`` at or before (or strictly before) each row.

    ``order`` must be total within a group and ``block`` monotone in its first column."""
    blocked = rows.withColumn("__block", block)
    position = F.struct(*order)
    partial = blocked.groupBy(*keys, "__block").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(position.alias("at"), F.col(value).alias("v")))
              ).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = partial.select(*keys, "__block",
                             F.last("__last", ignorenulls=True).over(before)["v"].alias("__carry"))
    edge = 0 if include_current else -1
    local = (Window.partitionBy(*keys, "__block").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, edge))
    joined = _join_back(blocked, carried, [*keys, "__block"])
    return (joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(local),
                                               F.col("__carry")))
                  .drop("__block", "__carry"))


def ordered_entries(rows: DataFrame, keys: list[str], order: str | list[str], value: Column, name: str) -> DataFrame:
    """(keys, ordinal, name): one row an entry with its place (from 1) in the group's order, ties by value.

    The input is computed once and stored with only these columns. Groups of at most ``BLOCK_ROWS`` rows are numbered by
    a window; larger ones by a prefix sum over range partitions, so no row, task or window holds a hot group."""
    narrow, by = _entries(rows, keys, order, value, name)
    near, far = _apart(narrow, keys, BLOCK_ROWS)
    out = near.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long").alias("ordinal"), name)
    if far is not None:
        out = out.unionByName(with_group_position(far, keys, [F.col(b) for b in by], "ordinal").select(*keys, "ordinal", name))
    return out


def _entries(rows: DataFrame, keys: list[str], order: str | list[str], value: Column, name: str) -> tuple[DataFrame, list[str]]:
    """The stored rows with only the columns that a list needs, and their order."""
    fine_shuffles(rows.sparkSession)
    places = [order] if isinstance(order, str) else list(order)
    marks = [f"__order{i}" for i in range(len(places))]
    narrow = kept(rows.select(*keys, *[F.col(o).alias(m) for o, m in zip(places, marks, strict=True)], value.alias(name)))
    return narrow, [*marks, name]


def paged_lists(rows: DataFrame, keys: list[str], order: str | list[str], value: Column, name: str,
                page: int = 4096) -> DataFrame:
    """The entries of ``ordered_entries`` as lists, in pages of bounded length: (keys, page, pages, total, name).

    A group up to one page long is one row, collected and sorted as such; a longer one is numbered first and stays whole
    over several rows."""
    narrow, by = _entries(rows, keys, order, value, name)
    near, far = _apart(narrow, keys, page)
    whole = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*by))).alias("__l")).select(
        *keys, F.lit(0).alias("page"), F.lit(1).alias("pages"), F.size("__l").cast("long").alias("total"),
        F.transform("__l", lambda e: e[name]).alias(name))
    if far is None:
        return whole
    entries = with_group_position(far, keys, [F.col(b) for b in by], "ordinal").select(*keys, "ordinal", name).withColumn(
        "page", F.floor((F.col("ordinal") - 1) / page).cast("int"))
    lists = entries.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", name))).alias("__l"))
    totals = entries.groupBy(*keys).agg(F.max("ordinal").alias("total"))
    return whole.unionByName(_join_back(lists, totals, keys).select(
        *keys, "page", F.ceil(F.col("total") / page).cast("int").alias("pages"), "total",
        F.transform("__l", lambda e: e[name]).alias(name)))


def with_flag_from(rows: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Append whether ``other`` has a row of the same group."""
    there = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return _join_back(rows, there, keys).withColumn(name, F.coalesce(name, F.lit(False)))
