"""Hot groups: block-wise statistics give what a window over the whole group gives."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from portcullis.operators import spread as S
from portcullis.operators import verdict as A
from portcullis.operators.signatures import signature_match
from portcullis.operators.verify import compare_parts, pair_parts


def hot(spark, n=3000):
    """A third of the rows in one group, the rest spread; order with gaps, NULL keys included."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 101 == 0, None).otherwise(F.concat(F.lit("g"), (i % 97).cast("string"))).alias("k"), (i * 7 % 5003).alias("o"),
        F.when(i % 4 == 0, i).alias("v"))


def same(a, b, cols):
    rows = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=repr)
    assert rows(a) == rows(b)


def test_stats_ordinals_and_carry(spark):
    df, w = hot(spark), Window.partitionBy("k")
    got = S.with_stats(df, ["k"], {"lo": ("min", F.col("v")), "n": ("count", F.col("v")), "s": ("sum", F.col("o")), "hi": ("max", F.struct("o", "v"))})
    want = df.withColumns({"lo": F.min("v").over(w), "n": F.count("v").over(w), "s": F.sum("o").over(w), "hi": F.max(F.struct("o", "v")).over(w)})
    same(got, want, ["k", "o", "lo", "n", "s", "hi"])
    run = w.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    same(S.with_ordinal(df, ["k"], "o", "r", size=64), df.withColumn("r", F.count("*").over(run)), ["k", "o", "r"])
    before = w.orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    for current, frame in ((True, run), (False, before)):
        got = S.with_carry(df, ["k"], ["o"], S.block_of("o", 64), "v", "c", include_current=current)
        same(got, df.withColumn("c", F.last("v", ignorenulls=True).over(frame)), ["k", "o", "c"])


def test_partitioning_changes_nothing(spark):
    df = hot(spark)
    one = S.with_ordinal(df.repartition(1), ["k"], "o", "r", size=64)
    many = S.with_ordinal(df.repartition(16), ["k"], "o", "r", size=64)
    same(one, many, ["k", "o", "r"])


def test_pages_keep_everything(spark):
    pages = S.paged_lists(hot(spark), ["k"], "o", F.col("o"), "l", page=100)
    flat = pages.filter("k = 'hot'").orderBy("page").collect()
    assert len(flat) == 10 and all(len(p.l) == 100 and p.pages == 10 and p.total == 1000 for p in flat)
    joined = [x for p in flat for x in p.l]
    assert joined == sorted(joined)


def test_flag_from_other_table(spark):
    df = hot(spark)
    other = df.filter("v > 2900").select("k")
    want = {r.k for r in other.distinct().collect()}
    for r in S.with_flag_from(df, other, ["k"], "f").select("k", "f").distinct().collect():
        assert r.f == (r.k in want)


def test_pairs_of_a_hot_item(spark):
    i = F.col("id")
    src = spark.range(2000).select(F.when(i < 900, "hot").otherwise(F.concat(F.lit("x"), (i % 50).cast("string"))).alias("item_id"), F.lit("audio").alias("type"), i.alias("idx"),
                                   F.sha2(i.cast("string"), 256).alias("raw_hash"), F.lit("c").alias("canon_hash"), F.lit(True).alias("same_family"))
    assert {r.status for r in compare_parts(pair_parts(src, src)).select("status").distinct().collect()} == {"packet"}


def test_report_pages(spark):
    found = spark.range(1000).select(F.lit("hot").alias("item_id"), F.lit(1).alias("stage"), F.col("id").cast("int").alias("seq"), F.lit("X").alias("code"),
                                     F.lit(1).alias("severity"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit(None).cast("string").alias("detail"))
    judged = spark.createDataFrame([("hot", "/h", 1), ("calm", "/c", 0)], "item_id string, path string, verdict int")
    lines = A.report_lines(judged, found, page=300).collect()
    assert len([l for l in lines if l.item_id == "hot"]) == 4
    calm = [l.line for l in lines if l.item_id == "calm"][0]
    assert '"findings":[]' in calm and '"info":{}' in calm and "null" not in calm


def test_signatures_against_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    body = lambda n: " ".join(words[(n * k) % 5] for k in range(1, 12))
    bodies = [(i, body(i)) for i in range(40)] + [(100, "one alpha beta gamma delta eps two"), (101, "xalpha betay"), (102, None), (103, "same")]
    sigs = [(1, "pha beta gamma del"), (2, "alpha"), (3, "ha bet"), (4, "beta gamma delta eps alpha"), (5, "zz yy xx ww"), (6, "same")]
    import hashlib
    items = spark.createDataFrame(bodies, "item_id long, body string")
    table = spark.createDataFrame([(i, t, hashlib.sha256(t.encode()).hexdigest()) for i, t in sigs], "sig_id long, text string, digest string")
    want = {(i, s, "digest" if b == t else "text") for i, b in bodies for s, t in sigs if b and t in b}
    assert {tuple(r) for r in signature_match(items, table).collect()} == want


def test_small_groups_are_numbered_without_a_global_order(spark):
    """Groups under the bound are numbered where they are; only a hot one is dealt by ranges."""
    asked = []
    given = S.with_group_position
    S.with_group_position = lambda df, *a, **k: asked.append(df.count()) or given(df, *a, **k)
    try:
        calm = spark.range(900).select((F.col("id") % 300).alias("k"), F.col("id").alias("o"))
        assert {r.ordinal for r in S.ordered_entries(calm, ["k"], "o", F.col("o"), "e").collect()} == {1, 2, 3}
        assert {r.total for r in S.paged_lists(calm, ["k"], "o", F.col("o"), "l").collect()} == {3}
        assert asked == []
        pages = S.paged_lists(hot(spark), ["k"], "o", F.col("o"), "l", page=100).collect()
        assert asked == [1000] and sum(len(p.l) for p in pages) == 3000
        S.BLOCK_ROWS, size = 500, S.BLOCK_ROWS
        try:
            w = Window.partitionBy("k").orderBy("o")
            same(S.ordered_entries(hot(spark), ["k"], "o", F.col("o"), "e"),
                 hot(spark).select("k", F.row_number().over(w).alias("ordinal"), F.col("o").alias("e")), ["k", "ordinal", "e"])
        finally:
            S.BLOCK_ROWS = size
        assert asked == [1000, 1000]
    finally:
        S.with_group_position = given


def test_shuffles_begin_with_many_partitions(spark):
    from portcullis.session import FINE
    spark.conf.unset(FINE)
    test_pairs_of_a_hot_item(spark)
    assert int(spark.conf.get(FINE)) >= 1024
