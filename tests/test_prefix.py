import random
from functools import reduce
from operator import xor

from pyspark.sql import functions as F

from portcullis.operators.prefix import with_group_position, with_position


def test_positions_of_the_whole_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    out = with_position(df, [F.col("k").desc_nulls_last(), F.col("v")], parts=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.k, r.v) for r in sorted(out, key=lambda r: r.position)] == want
    assert sorted(r.position for r in out) == list(range(1, 3001))
    assert with_position(df.limit(0), [F.col("k")]).count() == 0


def test_equal_rows_spread_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"))
    out = with_position(df, [F.col("k")], parts=8)
    assert sorted(r.position for r in out.collect()) == list(range(1, 20001))
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 20000 / 3


def test_group_positions_and_running_xor(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "b", f"x{i % 50}"]), i, rng.getrandbits(62), rng.getrandbits(62)) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v long, a long, b long").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        out = with_group_position(df, "g", [F.col("v")], xor=["a", "b"], parts=9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.g, r.v): (r.position, r.a_before, r.b_before) for r in out}
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        for i, (v, _, _) in enumerate(own):
            assert got[g, v] == (i + 1, reduce(xor, [r[1] for r in own[:i]], 0), reduce(xor, [r[2] for r in own[:i]], 0))
    assert with_group_position(df.limit(0), "g", [F.col("v")]).count() == 0


def test_groups_of_several_columns(spark):
    rows = [(i % 3 or None, "hot" if i % 2 else f"s{i % 7}", (i * 37) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, s string, v long").repartition(5)
    out = with_group_position(df, ["k", "s"], [F.col("v")], parts=8)
    got = {(r.k, r.s, r.v): r.position for r in out.collect()}
    groups = {}
    for k, s, v in sorted(rows, key=lambda r: r[2]):
        groups.setdefault((k, s), []).append(v)
    assert got == {(k, s, v): i for (k, s), own in groups.items() for i, v in enumerate(own, 1)}
    parts = out.withColumn("p", F.input_file_name()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts < 5000 / 4  # the hot groups lie over many tasks
