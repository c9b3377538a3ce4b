"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct shingles (five words, or the whole of a shorter text); two sets link
when their Jaccard similarity reaches 3/4. Documents with equal sets form a class, and everything below
works on classes.

1. **Frequencies.** Shingle hashes travel as packed, sorted blocks by hash range, each with the classes
   that hold them, so a shuffled row is a block and not a shingle. Only shingles of two or more classes
   come back to their classes. Shingles of a large share of all documents would make one range hot: they
   are found first (their number is bounded by that share), and go straight to their classes.
2. **Prefixes.** In each of three global orders (rare first, ties and near-ties by different hashes) a set
   can only link with one that shares a token of its prefix, the first ``n - ceil(3n/4) + 1`` tokens. A set
   whose prefix has only tokens of its own drops out, which most do.
3. **Hubs.** In each bucket of the first order the most central class is the hub; every class is verified
   against the hubs it meets most. The links found give first components.
4. **The rest, exactly.** Only pairs of different components are still open. Buckets of at most
   ``SMALL_BUCKET`` classes give them as pairs. Larger buckets are cut into blocks of one component or of
   several small ones; blocks that share a bucket are compared, in memory, for the pairs between components
   only. A pair is verified only if its prefixes meet in all three orders.

Steps 3 and 4 give components without all links. ``link_counts`` verifies every pair of classes whose
prefixes meet in all three orders: pairs of small buckets as rows, classes of larger ones in blocks of a
family (classes that large buckets connect), each pair of blocks compared once, in memory, and only numbers
of links leave it.

No bucket is capped: whatever is not settled by its hub goes through step 4. Hashes have 48 bits inside a
set and 64 bits for a class; two texts are confused with a chance below 1e-8 a pair.

Defined results: null and empty texts and texts without words have no shingles, component_id is their own
doc_id and they link with nothing; repeated rows are rows of one class; a null doc_id never names a
component unless all of its rows are null. Other columns of the input are not returned.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import (WordHashes, by_place, distinct, grams, mix, pack, pack_sorted, runs, small_batches, stored, text_bytes, tidy, tidy_group,
                                   unpack, unpack_sorted, words)
from portcullis.llm.components import components

SHINGLE = 5
#: Links need LINK_NUM / LINK_DEN of the union.
LINK_NUM, LINK_DEN = 3, 4
#: Shingles one worker sorts at a time, and shingles in one hash range.
CHUNK, RANGE = 750_000, 750_000
#: A shingle in at least this share of the documents, or in this many, travels apart.
HEAVY_SHARE, HEAVY_COUNT = 64, 2_000_000
SMALL_BUCKET, BLOCK = 32, 256
HUBS = 2
HEAVY = np.uint64(1 << 40)


def shingle_set(text: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    h = hashes.of(words(text))
    return distinct(grams(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(s).tobytes())


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def need(n):
    """Shared tokens without which a set of n cannot link."""
    return -(-LINK_NUM * n // LINK_DEN)


def linked(shared: int, a: int, b: int) -> bool:
    return shared > 0 and LINK_DEN * shared >= LINK_NUM * (a + b - shared)


def _chunks(batches: Iterator[pa.RecordBatch], hashes: WordHashes) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(class, size, 48-bit tokens) of the distinct sets of a bounded run of texts."""
    found, seen, size = [], set(), 0
    for b in batches:
        for t in b.column("_text").to_pylist():
            s = shingle_set(t, hashes)
            if not len(s) or (k := set_key(s)) in seen:
                continue
            seen.add(k)
            found.append((k, len(s), distinct(s >> np.uint64(16))))
            size += len(s)
            if size >= CHUNK:
                yield found
                found, seen, size = [], set(), 0
    if found:
        yield found


def _describe(share: int):
    """Rows of documents (class and size) and, for each chunk, its frequent tokens with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        tokens: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            if tokens:
                t, c = np.unique(np.concatenate(tokens), return_counts=True)
                keep = c * 2 * share >= max(len(tokens), 4 * share)
                if keep.any():
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                                      pa.array(t[keep].astype(np.int64)), pa.array(c[keep].astype(np.int64))], names=names)
            tokens.clear()
            seen.clear()

        names = ["id", "k", "n", "token", "docs"]
        ids = pa.int64()
        for b in batches:
            ids = b.column("id").type
            ks: list[int | None] = []
            ns: list[int] = []
            for t in b.column("_text").to_pylist():
                s = shingle_set(t, hashes)
                ns.append(len(s))
                if not len(s):
                    ks.append(None)
                    continue
                k = set_key(s)
                ks.append(signed(k))
                if k not in seen:
                    seen.add(k)
                    tokens.append(distinct(s >> np.uint64(16)))
                    size += len(s)
                    if size >= CHUNK:
                        yield from frequent()
                        size = 0
            m = len(ns)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ks, pa.int64()), pa.array(ns, pa.int64()),
                                              pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
        yield from frequent()
    return run


_BLOCK_ROWS = "bucket int, t binary, d binary, k binary, n binary"
_BLOCK_NAMES = ["bucket", "t", "d", "k", "n"]
_BLOCK_TYPES = pa.schema([("bucket", pa.int32()), ("t", pa.binary()), ("d", pa.binary()), ("k", pa.binary()), ("n", pa.binary())])


def _split(ranges: int, class_ranges: int, heavy):
    """Blocks of tokens by hash range; heavy tokens by the range of their class, under negative numbers."""
    def rows(bucket: np.ndarray, tokens: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray, ascending: bool):
        made = []
        for lo, hi in runs(bucket):
            used, at = np.unique(doc[lo:hi], return_inverse=True)
            made.append((int(bucket[lo]), pack_sorted(tokens[lo:hi]) if ascending else pack(tokens[lo:hi]),
                         pack(at), pack(keys[used]), pack(sizes[used])))
            if len(made) == 64 or hi == len(bucket):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _BLOCK_TYPES, strict=True)],
                                                 schema=_BLOCK_TYPES)
                made = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = heavy.value
        for found in _chunks(batches, WordHashes()):
            keys = np.array([f[0] for f in found], np.uint64)
            sizes = np.array([f[1] for f in found], np.uint64)
            tokens = np.concatenate([f[2] for f in found])
            doc = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f[2]) for f in found])
            del found
            if len(common):
                apart = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
                if apart.any():
                    t, d = tokens[apart], doc[apart]
                    to = _class_range(keys, class_ranges)[d]
                    order = np.argsort(to, kind="stable")
                    yield from rows(-1 - to[order], t[order], d[order], keys, sizes, False)
                    tokens, doc = tokens[~apart], doc[~apart]
            order = np.argsort(tokens)
            tokens, doc = tokens[order], doc[order]
            bucket = ((tokens * np.uint64(ranges)) >> np.uint64(48)).astype(np.int64)
            if len(tokens):
                yield from rows(bucket, tokens, doc, keys, sizes, True)
    return run


def _class_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


_COUNTED = pa.schema([("bucket", pa.int32()), ("t", pa.binary()), ("df", pa.binary()), ("k", pa.binary()), ("n", pa.binary()), ("c", pa.binary())])


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ts, ks, ns = [], [], []
    ascending = table.column("bucket")[0].as_py() >= 0
    for t, d, k, n in zip(*(table.column(c).to_pylist() for c in ("t", "d", "k", "n")), strict=True):
        at = unpack(d).astype(np.int64)
        ts.append(unpack_sorted(t) if ascending else unpack(t))
        ks.append(unpack(k)[at])
        ns.append(unpack(n)[at].astype(np.uint32))
    return np.concatenate(ts), np.concatenate(ks), np.concatenate(ns)


def _count(class_ranges: int):
    """Tokens of one hash range that two or more classes hold, grouped by class."""
    def run(table: pa.Table) -> pa.Table:
        heavy = table.column("bucket")[0].as_py() < 0
        t, k, n = _gather(table)
        if not heavy:
            order = np.argsort(t)
            u = t[order]
            twice = np.zeros(len(u), bool)
            same = u[1:] == u[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            order = order[twice]
            t, k, n = t[order], k[order], n[order]
        order = np.lexsort((k, t))
        t, k, n = t[order], k[order], n[order]
        df = np.empty(0, np.uint64)
        if len(t):
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k, n = t[fresh], k[fresh], n[fresh]
            start = np.nonzero(np.concatenate([[True], t[1:] != t[:-1]]))[0]
            df = np.repeat(np.diff(np.append(start, len(t))), np.diff(np.append(start, len(t)))).astype(np.uint64)
            if heavy:
                df[:] = HEAVY
            keep = df > 1
            t, k, n, df = t[keep], k[keep], n[keep], df[keep]
        order = np.argsort(k, kind="stable")
        t, k, n, df = t[order], k[order], n[order], df[order]
        to = _class_range(k, class_ranges)
        out = []
        for lo, hi in runs(to):
            uk, first, c = np.unique(k[lo:hi], return_index=True, return_counts=True)
            out.append((int(to[lo]), pack(t[lo:hi]), pack(df[lo:hi]), pack_sorted(uk), pack(n[lo:hi][first]), pack(c)))
        columns = zip(*out, strict=True) if out else [[] for _ in _COUNTED]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)
    return run


_SETS = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("central", pa.float64()), ("t", pa.binary()), ("p1", pa.list_(pa.int64())),
                   ("p2", pa.binary()), ("p3", pa.binary())])
_SETS_SQL = "k long, n long, central double, t binary, p1 array<bigint>, p2 binary, p3 binary"


def prefixes(t: np.ndarray, df: np.ndarray, count: int) -> list[np.ndarray]:
    """The first ``count`` tokens in each global order: rare first, ties by a hash; the third order only
    looks at the magnitude of the frequency."""
    keys = [(mix(t, 1), df), (mix(t, 2), df), (mix(t, 3), np.floor(np.log2(df.astype(np.float64))))]
    return [np.sort(t[np.lexsort(key)[:count]]) for key in keys]


def _assemble(table: pa.Table) -> pa.Table:
    """The shared tokens of each class of one range, where they are enough for a link."""
    ts, dfs, ks, ns = [], [], [], []
    for t, df, k, n, c in zip(*(table.column(x).to_pylist() for x in ("t", "df", "k", "n", "c")), strict=True):
        times = unpack(c).astype(np.int64)
        ts.append(unpack(t))
        dfs.append(unpack(df))
        ks.append(np.repeat(unpack_sorted(k), times))
        ns.append(np.repeat(unpack(n), times).astype(np.int64))
    t, df, k, n = np.concatenate(ts), np.concatenate(dfs), np.concatenate(ks), np.concatenate(ns)
    order = np.lexsort((t, k))
    t, df, k, n = t[order], df[order], k[order], n[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    t, df, k, n = t[fresh], df[fresh], k[fresh], n[fresh]
    out = []
    for lo, hi in runs(k):
        size, m = int(n[lo]), int(hi - lo)
        if m < need(size):
            continue
        p = prefixes(t[lo:hi], df[lo:hi], m - need(size) + 1)
        out.append((signed(int(k[lo])), size, float(np.minimum(df[lo:hi], 1 << 20).sum()) / size, pack_sorted(t[lo:hi]),
                    p[0].astype(np.int64), pack_sorted(p[1]), pack_sorted(p[2])))
    columns = zip(*out, strict=True) if out else [[] for _ in _SETS]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SETS, strict=True)], schema=_SETS)


def meet(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = b.to_pydict()
        keep = []
        for i in range(b.num_rows):
            if not meet(unpack_sorted(columns["p2a"][i]), unpack_sorted(columns["p2b"][i])) \
                    or not meet(unpack_sorted(columns["p3a"][i]), unpack_sorted(columns["p3b"][i])):
                continue
            shared = meet(unpack_sorted(columns["ta"][i]), unpack_sorted(columns["tb"][i]))
            if linked(shared, columns["na"][i], columns["nb"][i]):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("t").alias(f"t{x}"), F.col("p2").alias(f"p2{x}"),
                           F.col("p3").alias(f"p3{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(_verify_pairs), "a long, b long")


def _near(a: str, b: str) -> F.Column:
    """Sizes of a pair that can link."""
    return (F.col(a) * LINK_DEN >= F.col(b) * LINK_NUM) & (F.col(b) * LINK_DEN >= F.col(a) * LINK_NUM)


class _Stack:
    """Several ascending arrays laid end to end, to count what each has in common with another one."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.all = np.concatenate(arrays)
        self.ends = np.cumsum([len(a) for a in arrays])

    def meet(self, a: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(len(self.ends), np.int64)
        hit = np.concatenate([[0], np.cumsum(a[np.minimum(np.searchsorted(a, self.all), len(a) - 1)] == self.all)])
        return np.diff(hit[np.concatenate([[0], self.ends])])


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components of two blocks; once two components are linked, their other
    pairs are skipped."""
    for b in batches:
        left, right = [], []
        for xs, ys in zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), strict=True):
            parent: dict[int, int] = {}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            size = np.array([y["n"] for y in ys])
            orders = [_Stack([np.array(y["p1"], np.uint64) for y in ys]), _Stack([unpack_sorted(y["p2"]) for y in ys]),
                      _Stack([unpack_sorted(y["p3"]) for y in ys])]
            whole = [unpack_sorted(y["t"]) for y in ys]
            for x in xs:
                mine = [np.array(x["p1"], np.uint64), unpack_sorted(x["p2"]), unpack_sorted(x["p3"])]
                may = (LINK_DEN * size >= LINK_NUM * x["n"]) & (LINK_DEN * x["n"] >= LINK_NUM * size)
                for order, p in zip(orders, mine, strict=True):
                    if not may.any():
                        break
                    may &= order.meet(p) > 0
                if not may.any():
                    continue
                t = unpack_sorted(x["t"])
                for j in np.nonzero(may)[0]:
                    y = ys[j]
                    cx, cy = root(x["comp"]), root(y["comp"])
                    if cx != cy and linked(meet(t, whole[j]), x["n"], y["n"]):
                        parent[max(cx, cy)] = min(cx, cy)
                        left.append(x["k"])
                        right.append(y["k"])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def candidate_sets(given: DataFrame, described: DataFrame) -> DataFrame:
    """Stored sets (k, n, central, t, p1, p2, p3) of the classes that may link; ``given`` has _text (bytes)."""
    spark = given.sparkSession
    counts = described.where("k IS NOT NULL").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    documents, tokens = counts.docs or 0, counts.tokens or 0
    at_least = max(32, min(documents // (2 * HEAVY_SHARE), HEAVY_COUNT // 2))
    # at most tokens / at_least rows: a bound that holds for every input
    heavy = sorted(r.token for r in described.where("token IS NOT NULL").groupBy("token").agg(F.sum("docs").alias("c"))
                   .where(F.col("c") >= at_least).select("token").collect())
    shared = spark.sparkContext.broadcast(np.array(heavy, np.uint64))
    ranges = int(max(64, tokens // RANGE))
    class_ranges = max(64, ranges // 4)
    blocks = given.select("_text").mapInArrow(tidy(_split(ranges, class_ranges, shared)), _BLOCK_ROWS)
    counted = blocks.groupBy("bucket").applyInArrow(tidy_group(_count(class_ranges)), "bucket int, t binary, df binary, k binary, n binary, c binary")
    return stored(counted.groupBy("bucket").applyInArrow(tidy_group(_assemble), _SETS_SQL))


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes that together connect all that link."""
    postings = sets.select("k", "n", "central", F.explode("p1").alias("token"))
    hubs = (postings.groupBy("token").agg(F.count("*").alias("c"), F.max(F.struct("central", "k", "n")).alias("hub")).where("c > 1")
            .select("token", F.col("hub.k").alias("hub"), F.col("hub.n").alias("hub_n")))
    met = postings.join(hubs, "token").where((F.col("k") != F.col("hub")) & _near("n", "hub_n"))
    # a class meets at most as many hubs as its prefix has tokens
    pairs = (met.groupBy("k", "hub").agg(F.count("*").alias("votes")).groupBy("k")
             .agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "hub")), asc=False), 1, HUBS).alias("top"))
             .select(F.col("k").alias("a"), F.explode("top.hub").alias("b")))
    first = stored(verify(pairs, sets))
    component = components(first).select(F.col("node").alias("k"), "label")
    placed = postings.join(component, "k", "left").select("token", "k", "n", F.coalesce("label", "k").alias("comp"))
    buckets = (placed.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .where("lo < hi").select("token", "c"))
    still_open = stored(placed.join(buckets, "token"))

    small = still_open.where(F.col("c") <= SMALL_BUCKET).drop("c")
    other = small.toDF("token", "k2", "n2", "comp2")
    second = verify(small.join(other, "token").where((F.col("comp") < F.col("comp2")) & _near("n", "n2"))
                    .select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct(), sets)

    large = still_open.where(F.col("c") > SMALL_BUCKET).drop("c")
    if large.isEmpty():
        return stored(first.union(second))
    return stored(first.union(second).union(_large_buckets(large, sets)))


def _large_buckets(large: DataFrame, sets: DataFrame) -> DataFrame:
    heads = large.groupBy("token").agg(F.min("k").alias("head"))
    family = components(large.join(heads, "token").select(F.col("k").alias("a"), F.col("head").alias("b")))
    members = (large.groupBy("k").agg(F.min("comp").alias("comp"))
               .join(family.select(F.col("node").alias("k"), F.col("label").alias("family")), "k"))
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("c"))
    # components of many members have blocks of their own, the others share blocks
    kept = sizes.select("family", "comp", F.when(F.col("c") >= BLOCK // 4, F.col("comp")).alias("own"), "c")
    slices = kept.groupBy("family", "own").agg(F.ceil(F.sum("c") / BLOCK).alias("slices"))
    # the place of a component among all of its family: small tables, joined by their keys
    where = kept.alias("x").join(slices.alias("y"), (F.col("x.family") == F.col("y.family")) & F.col("x.own").eqNullSafe(F.col("y.own"))
                                 ).select("x.family", "x.comp", "x.own", "slices")
    block = F.xxhash64("family", F.coalesce("own", F.lit(0)), F.col("own").isNull(), F.pmod(F.xxhash64("k"), "slices"))
    placed = stored(members.join(where, ["family", "comp"]).select("k", "comp", "own", block.alias("block")))
    blocks = stored(placed.join(sets, "k").groupBy("block").agg(F.collect_list(F.struct("k", "comp", "n", "t", "p1", "p2", "p3")).alias("xs")))
    at = large.select("token", "k").join(placed.select("k", "own", "block"), "k").select("token", "own", "block").distinct()
    also = at.toDF("token", "own2", "block2")
    pairs = (at.join(also, "token").where((F.col("block") <= F.col("block2")) & (F.col("own").isNull() | F.col("own2").isNull()
                                                                               | (F.col("own") != F.col("own2"))))
             .select("block", "block2").distinct())
    both = pairs.join(blocks, "block").join(blocks.toDF("block2", "ys"), "block2").select("xs", "ys")
    return both.mapInArrow(tidy(_compare_blocks), "a long, b long")


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of links that each class has in pairs of two blocks, or of a block with itself."""
    for b in batches:
        for xs, ys, same in zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), b.column("same").to_pylist(), strict=True):
            size, key = np.array([y["n"] for y in ys]), np.array([y["k"] for y in ys])
            orders = [_Stack([unpack_sorted(y[p]) for y in ys]) for p in ("p1", "p2", "p3")]
            whole = [unpack_sorted(y["t"]) for y in ys]
            links: dict[int, int] = {}
            for x in xs:
                may = (LINK_DEN * size >= LINK_NUM * x["n"]) & (LINK_DEN * x["n"] >= LINK_NUM * size)
                if same:
                    may &= key > x["k"]
                for order, p in zip(orders, ("p1", "p2", "p3"), strict=True):
                    if not may.any():
                        break
                    may &= order.meet(unpack_sorted(x[p])) > 0
                if not may.any():
                    continue
                t = unpack_sorted(x["t"])
                for j in np.nonzero(may)[0]:
                    if linked(meet(t, whole[j]), x["n"], ys[j]["n"]):
                        for k in (x["k"], ys[j]["k"]):
                            links[k] = links.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64())], names=["k", "links"])


def _pack_p1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p1 = pa.array([pack_sorted(np.array(p, np.uint64)) for p in b.column("p1").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([p1 if c == "p1" else b.column(c) for c in b.schema.names], names=b.schema.names)


def link_counts(sets: DataFrame) -> DataFrame:
    """k and links, the number of other classes it links with, of every class that has a link."""
    postings = sets.select("k", "n", F.explode("p1").alias("token"))
    buckets = postings.groupBy("token").agg(F.count("*").alias("c"), F.min("k").alias("head")).where("c > 1")
    shared = stored(postings.join(buckets, "token"))
    small = shared.where(F.col("c") <= SMALL_BUCKET)
    other = small.select("token", F.col("k").alias("b"), F.col("n").alias("nb"))
    pairs = small.join(other, "token").where((F.col("k") < F.col("b")) & _near("n", "nb")).select(F.col("k").alias("a"), "b").distinct()
    large = shared.where(F.col("c") > SMALL_BUCKET)
    counts = None
    if not large.isEmpty():
        family = components(large.select(F.col("k").alias("a"), F.col("head").alias("b")))
        family = stored(family.select(F.col("node").alias("k"), F.col("label").alias("family")))
        slices = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
        placed = stored(family.join(slices, "family").select("k", F.xxhash64("family", F.pmod(F.xxhash64("k"), "slices")).alias("block")))
        # tokens of the same blocks count once
        at = large.select("token", "k").join(placed, "k").groupBy("token").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
        met = stored(at.select("blocks", F.explode("blocks").alias("block")).select("block", F.explode("blocks").alias("block2"))
                     .where("block <= block2").distinct())
        blocks = stored(placed.join(sets.drop("central").mapInArrow(_pack_p1, "k long, n long, t binary, p1 binary, p2 binary, p3 binary"), "k")
                        .groupBy("block").agg(F.collect_list(F.struct("k", "n", "t", "p1", "p2", "p3")).alias("xs")))
        both = met.join(blocks, "block").join(blocks.toDF("block2", "ys"), "block2").select("xs", "ys", (F.col("block") == F.col("block2")).alias("same"))
        counts = both.mapInArrow(tidy(_count_blocks), "k long, links long")
        # pairs whose blocks are compared are counted there
        place = placed.select(F.col("k").alias("_k"), "block")
        pairs = (pairs.join(place.toDF("_a", "x"), F.col("a") == F.col("_a"), "left").join(place.toDF("_b", "y"), F.col("b") == F.col("_b"), "left")
                 .join(met, (F.least("x", "y") == F.col("block")) & (F.greatest("x", "y") == F.col("block2"))
                       & F.col("x").isNotNull() & F.col("y").isNotNull(), "left_anti").select("a", "b"))
    found = verify(pairs, sets).select(F.explode(F.array("a", "b")).alias("k"), F.lit(1).cast("long").alias("links"))
    return (found if counts is None else found.union(counts)).groupBy("k").agg(F.sum("links").alias("links"))


def _classified(docs: DataFrame, id_column: str, text_column: str, count_links: bool = False) -> DataFrame:
    """id, n, k (class), label (component of classes), component_id and class_id of every row; with
    ``count_links`` also links, from all pairs."""
    given = small_batches(docs).select(F.col(id_column).alias("id"), text_bytes(text_column).alias("_text"))
    kind = given.schema["id"].dataType.simpleString()
    described = stored(given.mapInArrow(tidy(_describe(HEAVY_SHARE)), f"id {kind}, k long, n long, token long, docs long"))
    rows = described.where("n IS NOT NULL").select("id", "k", "n")
    classes = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("class_id"))
    sets = candidate_sets(given, described)
    label = components(links(sets))
    joined = stored(label.select(F.col("node").alias("k"), "label").join(classes, "k"))
    named = joined.join(joined.groupBy("label").agg(F.min("class_id").alias("component_id")), "label").select("k", "label", "component_id")
    every = classes.join(named, "k", "left").select("k", F.coalesce("label", "k").alias("label"), "class_id",
                                                    F.when(F.col("label").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"))
    with_words = rows.where("k IS NOT NULL").join(every, "k").select("id", "n", "k", "label", "component_id", "class_id")
    nothing = F.lit(None).cast("long")
    without = rows.where("k IS NULL").select("id", "n", nothing.alias("k"), nothing.alias("label"), F.col("id").alias("component_id"),
                                             F.col("id").alias("class_id"))
    if not count_links:
        return with_words.union(without)
    counted = stored(link_counts(sets)).withColumnRenamed("k", "_k")
    return (with_words.join(counted, F.col("k") == F.col("_k"), "left").select(*with_words.columns, F.coalesce("links", F.lit(0)).alias("links"))
            .union(without.withColumn("links", F.lit(0).cast("long"))))


def linked_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``near_duplicates`` and n_links, the number of other classes (different sets) that the row's
    class links with, over all pairs."""
    return _classified(docs, id_column, text_column, count_links=True).select("id", "n", "component_id", "class_id", "links").toDF(
        id_column, "n_shingles", "component_id", "class_id", "n_links")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id and class_id (smallest id with an equal set) of every row."""
    return _classified(docs, id_column, text_column).select("id", "n", "component_id", "class_id").toDF(
        id_column, "n_shingles", "component_id", "class_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, whose columns may have any names, without near duplicates: of each component the row with the smallest id (null
    last) stays, of its repeated rows one; rows without words all stay. Texts are joined to the removed
    ids only; rows with a null or repeated id are matched by their set as well."""
    place = lambda c: f"c{docs.columns.index(c)}"
    return _one_of_each(by_place(docs), place(id_column), place(text_column)).toDF(*docs.columns)


def _one_of_each(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    info = stored(_classified(docs, id_column, text_column).select("id", "k", "label"))
    with_words = info.where("k IS NOT NULL")
    chosen = with_words.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("r")).select("r.id", "r.k")
    unclear = stored(info.groupBy("id").count().where("count > 1 OR id IS NULL").select("id"))
    removed = with_words.join(chosen.toDF("_id", "_k"), (F.col("k") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    removed = removed.select(F.col("id").alias("_id")).where("_id IS NOT NULL")
    if unclear.isEmpty():
        return docs.join(stored(removed.distinct()), docs[id_column] == F.col("_id"), "left_anti")
    drop = stored(removed.union(unclear.where("id IS NOT NULL").toDF("_id")).distinct())
    plain = docs.where(F.col(id_column).isNotNull()).join(drop, F.col(id_column) == F.col("_id"), "left_anti")
    marked = docs.join(unclear.toDF("_id"), F.col(id_column).eqNullSafe(F.col("_id")), "left_semi")
    at = marked.select(F.struct(*marked.columns).alias("row"), F.col(id_column).alias("_id"), text_bytes(text_column).alias("_text"))
    keyed = at.withColumn("_k", _key_of(F.col("_text")))
    kept = keyed.join(chosen.toDF("_i", "_c"), (F.col("_k") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi").dropDuplicates(["_id", "_k"])
    return plain.unionByName(kept.select("row.*")).unionByName(keyed.where("_k IS NULL").select("row.*"))


def _key_of(column):
    @F.pandas_udf("long")
    def keys(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        sets = (shingle_set(t, hashes) for t in texts)
        return pd.Series([signed(set_key(s)) if len(s) else None for s in sets], dtype="Int64")
    return keys(column)
