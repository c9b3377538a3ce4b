"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

Turns are numbered in each conversation, and rebuilt conversations are cut into blocks of ``WIDTH`` turns. A row
of a block has one column for each position's turn id and the key of the node where the block begins, so
``GROUP BY block, key, ROLLUP (t1, ..., t8)`` aggregates every prefix at once, ``grouping_id()`` tells its depth,
and a long conversation goes on in the next block under its last node's key. A second ROLLUP, over the nodes,
sums each subtree inside its block; what lies in blocks further down is first added to the nodes where they
begin, by doubling the distance looked down (as many rounds as the logarithm of the longest conversation).

A turn id is the MD5 of role and text with the text's number of words. A node's key is the exclusive or of the
hashes of its (position, turn id) pairs, in two 64-bit lanes, so the keys of all blocks of all conversations are
one running value and need no walk. Numbers and keys come from prefix sums over range partitions: a conversation
or a node may hold any share of the rows. The ids that end at a node are packed in runs of ``RUN`` before they
meet, and are hashed as a stream.

Defined results: rows without a conversation id belong to none; null turns come first, turns that tie are ordered
by their ids, and equal rows are turns each; null roles and texts are empty; a rebuilt conversation without turns
is a member of the root alone; an empty table has no nodes. Only the named columns are read, and only the columns
of a node are returned, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import crc_rest, small_batches, stored
from portcullis.operators.prefix import with_group_position

#: Positions of a block, ids of a run.
WIDTH, RUN = 8, 4096
#: Conversations of one group take their beginning from its first one.
GROUP, LONGEST_BEGINNING = 20, 4
_IDS = [f"t{i}" for i in range(1, WIDTH + 1)]
_KEY = ["key_a", "key_b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 1) and t (turn id) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    t = F.concat(digest, F.unhex(F.lpad(F.hex(words), 16, "0")))
    given = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), t.alias("t"))
    # stored first: the range partitions are sampled, and texts are read once
    return with_group_position(stored(given), "conv_id", [F.col("turn").asc_nulls_first(), F.col("t")], "p").select("conv_id", "p", "t")


def words_of(t: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(t, 17, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, n, t, longest) of the rebuilt conversations, and those (c) that have none. The first h turns come from
    the group's first conversation, the rest from the conversation itself."""
    h = crc_rest("conv_id", LONGEST_BEGINNING)
    size = numbered.groupBy("conv_id").agg(F.max("p").alias("n"))
    own = stored(size.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP))
    first = own.select(F.col("conv_id").alias("b"), F.col("n").alias("has"))
    taken = F.least("h", F.coalesce("has", F.lit(0)))
    convs = stored(own.join(first, F.col("base") == F.col("b"), "left").select(
        F.col("conv_id").alias("c"), "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("longest")))
    begin = (numbered.where(F.col("p") < LONGEST_BEGINNING).join(convs.where("k > 0"), (F.col("conv_id") == F.col("base")) & (F.col("p") <= F.col("k")))
             .select("c", F.col("p").alias("n"), "t", "longest"))
    rest = (numbered.where(F.col("p") > h).join(convs, F.col("conv_id") == F.col("c"))
            .select("c", (F.col("p") - F.col("h") + F.col("k")).alias("n"), "t", "longest"))
    return begin.unionByName(rest), convs.where("longest = 0").select("c")


def _hashed(lane: int, place: Column, t: Column) -> Column:
    """One lane of the hash of a turn id at its place."""
    return F.xxhash64(F.lit(lane), place.cast("long"), t)


def keyed(given: DataFrame) -> DataFrame:
    """Rebuilt turns with the node key before each (a_before, b_before) and its own part of the key (a, b)."""
    lanes = given.select("*", _hashed(1, F.col("n"), F.col("t")).alias("a"), _hashed(2, F.col("n"), F.col("t")).alias("b"))
    return with_group_position(lanes, "c", [F.col("n")], "n_again", xor=["a", "b"]).drop("n_again")


def blocks(sequence: DataFrame, empty: DataFrame) -> DataFrame:
    """One row for each block of each conversation: c, block, prior_a, prior_b, longest, t1 to t8."""
    slot = (F.col("n") - 1) % WIDTH
    at = sequence.withColumn("block", F.expr(f"(n - 1) div {WIDTH}"))
    first = lambda c: F.max(F.when(slot == 0, F.col(c)))
    rows = at.groupBy("c", "block").agg(first("a_before").alias("prior_a"), first("b_before").alias("prior_b"), F.max("longest").alias("longest"),
                                        *[F.max(F.when(slot == i, F.col("t"))).alias(x) for i, x in enumerate(_IDS)])
    none = empty.selectExpr("c", "0L AS block", "0L AS prior_a", "0L AS prior_b", "0L AS longest", *[f"CAST(NULL AS BINARY) AS {x}" for x in _IDS])
    return rows.unionByName(none)


#: Depth of a prefix in its block, from the grouping bits of the rolled-up columns.
_LEVEL = f"{WIDTH} - bit_count(grouping_id())"
#: Prefixes that exist: the root, and those whose last position has a turn.
_THERE = " OR ".join(["(grouping_id() = {} AND block = 0)".format((1 << WIDTH) - 1),
                      *[f"(grouping_id() = {(1 << (WIDTH - i - 1)) - 1} AND {x} IS NOT NULL)" for i, x in enumerate(_IDS)]])
_ROLLED = f"GROUP BY block, prior_a, prior_b, ROLLUP ({', '.join(_IDS)}) HAVING {_THERE}"


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    return rows.sparkSession.sql(f"SELECT block, prior_a, prior_b, {', '.join(_IDS)}, CAST({_LEVEL} AS INT) AS level, {aggregates} FROM {{rows}} {_ROLLED}", rows=rows)


def _with_keys(nodes: DataFrame) -> DataFrame:
    """Adds depth, the node's key, its parent's key and the words of its last text."""
    ids = F.array(*[F.col(x) for x in _IDS])
    last = F.get(ids, F.col("level") - 1)
    out = nodes.withColumn("depth", F.col("block") * WIDTH + F.col("level")).withColumn("words", words_of(last))
    for lane, (key, prior, parent) in enumerate([("key_a", "prior_a", "parent_a"), ("key_b", "prior_b", "parent_b")], 1):
        value = F.col(prior)
        for i, x in enumerate(_IDS):
            value = value.bitwiseXOR(F.when(F.col(x).isNotNull(), _hashed(lane, F.col("block") * WIDTH + i + 1, F.col(x))).otherwise(F.lit(0)))
        own = F.when(last.isNotNull(), _hashed(lane, F.col("depth"), last)).otherwise(F.lit(0))
        out = out.withColumn(key, value).withColumn(parent, F.col(key).bitwiseXOR(own))
    return out


def _on(left: list[Column], right: list[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & (a == F.col(b))
    return condition


def below_blocks(nodes: DataFrame) -> DataFrame:
    """For each node where a further block begins: its children there, and leaves and saved tokens of all that lies
    below it. Each round adds the sums of the blocks that begin twice as far down."""
    local = (nodes.where("block > 0").groupBy("prior_a", "prior_b").agg(
        F.sum((F.col("level") == 1).cast("long")).alias("kids"), F.sum("leaves").alias("s_leaves"), F.sum("saved").alias("s_saved")))
    above = nodes.where(f"level = {WIDTH}").select(
        *_KEY, F.when(F.col("block") > 0, F.struct(F.col("prior_a").alias("a"), F.col("prior_b").alias("b"))).alias("up"))
    state = stored(local.join(above, _on([F.col("prior_a"), F.col("prior_b")], _KEY)).select(
        F.struct(F.col("prior_a").alias("a"), F.col("prior_b").alias("b")).alias("at"), "kids", "s_leaves", "s_saved", "up"))
    while not state.where("up IS NOT NULL").isEmpty():
        more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("m_at")).agg(F.sum("s_leaves").alias("m_leaves"), F.sum("s_saved").alias("m_saved"))
        next_up = state.select(F.col("at").alias("u_at"), F.col("up").alias("u_up"))
        state = stored(state.join(more, F.col("at") == F.col("m_at"), "left").join(next_up, F.col("up") == F.col("u_at"), "left").select(
            "at", "kids", (F.col("s_leaves") + F.coalesce("m_leaves", F.lit(0))).alias("s_leaves"),
            (F.col("s_saved") + F.coalesce("m_saved", F.lit(0))).alias("s_saved"), F.col("u_up").alias("up")))
    return state.select(F.col("at.a").alias("r_a"), F.col("at.b").alias("r_b"), "kids", "s_leaves", "s_saved")


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one node as runs of packed ids."""
    names = ["e_depth", "e_a", "e_b", "first", "ids"]
    for b in batches:
        depth, a, z, c = (b.column(i).to_numpy() for i in range(4))
        if not len(c):
            continue
        edge = np.nonzero((depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1]))[0] + 1
        ends = np.concatenate([edge, [len(c)]])
        begins = np.concatenate([[0], edge])
        cuts = np.concatenate([np.arange(lo, hi, RUN) for lo, hi in zip(begins, ends, strict=True)])
        stops = np.minimum(np.concatenate([cuts[1:], [len(c)]]), ends[np.searchsorted(ends, cuts, side="right")])
        ids = [c[lo:hi].astype("<i8").tobytes() for lo, hi in zip(cuts, stops, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[cuts]) for x in (depth, a, z, c)] + [pa.array(ids, pa.binary())], names=names)


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, joined by commas, over its runs in order."""
    now, digest = None, None
    for b in batches:
        done = []
        for d, a, z, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            text = ",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode()
            if (d, a, z) == now:
                digest.update(b"," + text)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (d, a, z), hashlib.sha256(text)
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(*now, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["e_depth", "e_a", "e_b", "ends_sha256"])


def ends(sequence: DataFrame, empty: DataFrame) -> DataFrame:
    """e_depth, e_a, e_b and ends_sha256 of every node at which a conversation ends."""
    last = sequence.where(F.col("n") == F.col("longest")).select(
        F.col("n").cast("long").alias("e_depth"), F.col("a_before").bitwiseXOR(F.col("a")).alias("e_a"), F.col("b_before").bitwiseXOR(F.col("b")).alias("e_b"), "c")
    rows = last.unionByName(empty.selectExpr("0L AS e_depth", "0L AS e_a", "0L AS e_b", "c"))
    at = ["e_depth", "e_a", "e_b"]
    runs = (small_batches(rows).repartitionByRange(*at, "c").sortWithinPartitions(*at, "c")
            .mapInArrow(_packed_runs, "e_depth long, e_a long, e_b long, first long, ids binary"))
    return runs.repartition(*at).sortWithinPartitions(*at, "first").mapInArrow(_hashed_runs, "e_depth long, e_a long, e_b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    given, none = rebuilt(turns(conversations))
    sequence = keyed(given)
    found = _rolled(blocks(sequence, none), "count(*) AS n_convs, min(c) AS conv_id, max(longest) AS longest")
    leaf = (F.col("longest") == F.col("depth")).cast("long")
    nodes = stored(_with_keys(found).withColumn("leaves", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("longest", "words", "parent_a", "parent_b"))
    deeper = nodes.join(below_blocks(nodes), (F.col("level") == WIDTH) & (F.col("key_a") == F.col("r_a")) & (F.col("key_b") == F.col("r_b")), "left")
    summed = _rolled(deeper.withColumnsRenamed({"level": "own_level"}), ", ".join(
        ["max(n_convs) AS n_convs", "min(conv_id) AS conv_id", "sum(leaves + coalesce(s_leaves, 0)) AS n_leaves", "sum(saved + coalesce(s_saved, 0)) AS saved_tokens",
         *[f"count_if(own_level = {i}) AS at{i}" for i in range(1, WIDTH + 1)], "sum(kids) AS kids"]))
    children = F.when(F.col("level") == WIDTH, F.coalesce("kids", F.lit(0))).otherwise(F.get(F.array(*[F.col(f"at{i}") for i in range(1, WIDTH + 1)]), F.col("level")))
    whole = stored(_with_keys(summed).withColumn("n_children", children).select(
        "depth", *_KEY, "parent_a", "parent_b", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    parents = whole.select((F.col("depth") + 1).alias("p_depth"), F.col("key_a").alias("p_a"), F.col("key_b").alias("p_b"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(parents, _on([F.col("depth"), F.col("parent_a"), F.col("parent_b")], ["p_depth", "p_a", "p_b"]), "left")
    out = out.join(ends(sequence, none), _on([F.col("depth"), F.col("key_a"), F.col("key_b")], ["e_depth", "e_a", "e_b"]), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
