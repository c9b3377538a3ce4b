"""Language model scoring with a weighted backoff automaton.

The model: n-grams of the training texts, smoothed by a Dirichlet prior of the next shorter model,
``P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu)``, down to add-one unigrams; each context begins with a
start mark, each text ends with an end token. As an automaton: a state for every context seen in
training, an arc for every n-gram seen, weighted log10 P, and a failure arc to the shorter context,
weighted log10 mu / (c(h) + mu). One traversal from left to right carries the state: it follows the arc of
the token, or takes failure arcs until there is one, and adds up the weights.

The model of a corpus grows with it and is never in one place. Texts are packed once into stored chunks
of word numbers. Every chunk asks for the n-grams it holds, as sorted hashes by hash range with its own
training counts; each range adds up the counts of all chunks and answers every chunk in the order of its
question; a chunk with its answers is the part of the automaton that its texts can visit. All texts of a
chunk are traversed in step, one token at a time, with a vector of states and arcs in sorted arrays. A long
text goes in pieces: the last n-1 tokens settle a state of n-grams, so a piece that begins n-1 tokens early, in the
empty context and without counting these, is in the state of the whole traversal. The number of
training words and of distinct ones come from the chunks' own vocabularies, by hash range. The ranges are
asked in ``PASSES`` turns: only the answers of a turn are stored, its questions leave the disk.

Hot words and n-grams are counted per chunk before they travel, so a range receives each n-gram at most
once from a chunk. A word's hash has 63 bits, an n-gram's 56.

Defined results: null and empty texts consist of the end token; repeated rows count and are scored each;
a null doc_id is hashed as the empty text; without training texts N = V = 0 and all words are unknown.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import PLACES, WordHashes, distinct, mix, pack, pack_sorted, runs, small_batches, stored, text_bytes, unpack, unpack_sorted, words

#: Length of the n-grams, 2 or 3.
ORDER = 3
#: Prior weight of the shorter model, for contexts of one and of two words.
MU = (8.0, 24.0)
#: Tokens of a chunk, and n-grams of a hash range.
CHUNK, RANGE = 600_000, 1_500_000
#: Turns in which the ranges are asked: so many times less of the questions is on disk at once.
PASSES = 3
#: Tokens of a piece: texts are traversed in pieces, all pieces of a chunk in step.
PIECE = 256
#: Hashes of the marks; no word hashes to them, as words are hashed to even numbers.
START, END = np.uint64(1), np.uint64(3)

_CHUNKS = pa.schema([("chunk", pa.int64()), ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("lengths", pa.binary()),
                     ("training", pa.binary()), ("ids", pa.binary()), ("ids_null", pa.binary())])
_CHUNKS_SQL = "chunk long, vocabulary binary, tokens binary, lengths binary, training binary, ids binary, ids_null binary"


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers into the chunk's own vocabulary (of word hashes), with their lengths."""
    hashes = WordHashes()
    ids: list[int | None] = []
    training: list[bool] = []
    parts: list[np.ndarray] = []
    size, chunk = 0, 0

    def packed() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        null = np.array([i is None for i in ids], np.uint8)
        row = [chunk, pack_sorted(vocabulary), pack(tokens), pack(np.array([len(p) for p in parts], np.uint64)),
               np.array(training, np.uint8).tobytes(), np.array([0 if i is None else i for i in ids], np.int64).tobytes(), null.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

    for b in batches:
        for i, t, learn in zip(b.column("id").to_pylist(), b.column("_text").to_pylist(), b.column("training").to_pylist(), strict=True):
            h = hashes.of(words(t)) & np.uint64(0xFFFFFFFFFFFFFFFE)
            parts.append(np.append(h, END))
            ids.append(i)
            training.append(learn)
            size += len(h) + 1
            if size >= CHUNK:
                yield packed()
                ids, training, parts, size, chunk = [], [], [], 0, chunk + 1
    if parts:
        yield packed()


def word_key(h: np.ndarray) -> np.ndarray:
    """56-bit key of a word in questions."""
    return mix(h, 101) >> np.uint64(8)


class Chunk:
    """The unpacked texts of a chunk."""

    def __init__(self, row: dict) -> None:
        self.vocabulary = unpack_sorted(row["vocabulary"])
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.training = np.frombuffer(row["training"], np.uint8).astype(bool)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ids_null = np.frombuffer(row["ids_null"], np.uint8).astype(bool)
        self.ends = np.cumsum(self.lengths)
        self.learned = np.repeat(self.training, self.lengths)

    def ngrams(self, k: int) -> np.ndarray:
        """Hash of the k-gram that ends at each token; the start mark stands once before each text, and
        longer runs that would begin before it are 0."""
        h = self.vocabulary[self.tokens]
        if k == 1:
            return word_key(h)
        n = len(h)
        begin = np.zeros(n, np.int64)
        begin[self.ends[:-1]] = 1
        at = np.arange(n) - np.repeat(self.ends - self.lengths, self.lengths)  # place inside the text
        out = np.zeros(n, np.uint64)
        for j in range(k):  # the token j places back
            back = np.empty(n, np.uint64)
            back[j:] = h[:n - j]
            back[:j] = 0
            token = np.where(at >= j, back, START)
            out += token * PLACES[j]
        return np.where(at >= k - 2, mix(out, 100 + k) >> np.uint64(8), np.uint64(0))

    def all_ngrams(self, order: int) -> list[np.ndarray]:
        return [self.ngrams(k) for k in range(1, order + 1)]

    def questions(self, order: int, ranges: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys in the ranges of one turn, and their counts in the training texts."""
        found, learned = [], []
        for k in range(1, order + 1):
            g = self.ngrams(k)
            used = (g != 0) & (_range_of(g, ranges) % PASSES == turn)
            found.append(g[used])
            learned.append(self.learned[used])
        if turn == 0:  # how often each text is begun; the mark lies in the first range
            found.append(np.full(len(self.lengths), START))
            learned.append(self.training)
        keys, at = np.unique(np.concatenate(found), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(learned), minlength=len(keys)).astype(np.uint64)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(24)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _ask(order: int, ranges: int, turn: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, counts = Chunk(row).questions(order, ranges, turn)
                to = _range_of(keys, ranges)
                out = [(int(to[lo]), row["chunk"], pack_sorted(keys[lo:hi]), pack(counts[lo:hi])) for lo, hi in runs(to)]
                for lo in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo:lo + 64], strict=True), schema, strict=True)], schema=schema)
    return run


_ANSWERS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("totals", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one hash range, in the order in which each chunk asked."""
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    counts = [unpack(c) for c in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, at, np.concatenate(counts))
    answers, lo = [], 0
    for k in keys:
        answers.append(pack(total[at[lo:lo + len(k)]]))
        lo += len(k)
    return pa.Table.from_arrays([table.column("bucket").combine_chunks(), table.column("chunk").combine_chunks(), pa.array(answers, pa.binary())],
                                schema=_ANSWERS)


class Automaton:
    """The states and arcs that a chunk's texts can visit. States: 0 the empty context, 1 the start mark,
    then words, then pairs of a context and a word. An arc's key is its state and token, in ascending order."""

    def __init__(self, chunk: Chunk, grams: list[np.ndarray], totals: np.ndarray, n: int, v: int, mu: tuple[float, ...]) -> None:
        # n-grams of all orders meet their totals, which are those of the ascending distinct hashes but 0
        _, at = np.unique(np.concatenate([*grams, np.array([np.uint64(0), START])]), return_inverse=True)
        found = np.append(np.int64(0), totals.astype(np.int64))[at]
        counts = np.split(found, np.cumsum([len(g) for g in grams]))
        self.order, self.size = len(grams), len(chunk.vocabulary)
        tokens, size = chunk.tokens, self.size
        first = np.zeros(len(tokens), bool)
        first[chunk.ends - chunk.lengths] = True
        c1 = np.zeros(size, np.int64)
        c1[tokens] = counts[0]
        begins = int(counts[-1][1])
        self.known = c1 > 0
        p1 = (c1 + 1) / (n + v + 1)
        self.base = np.log10(p1)
        # arcs of the empty context, one for each word
        arcs, weights, after = [np.arange(size)], [self.base], [np.where(c1 > 0, np.arange(size) + 2, 0)]
        # failure arcs of the start mark and of words
        c_word = np.concatenate([[0, begins], c1])
        self.fail_weight = np.log10(mu[0] / (c_word + mu[0]))
        self.fail_state = np.zeros(size + 2, np.int64)
        previous = np.where(first, 1, np.roll(tokens, 1) + 2)
        c2 = counts[1]
        p2 = (c2 + mu[0] * p1[tokens]) / (c_word[previous] + mu[0])
        arc2 = previous * size + tokens
        used = np.nonzero(c2 > 0)[0]
        seen, at, pair = np.unique(arc2[used], return_index=True, return_inverse=True)
        where = used[at]
        arcs.append(seen)
        weights.append(np.log10(p2[where]))
        after.append(np.arange(len(seen)) + size + 2 if self.order > 2 else tokens[where] + 2)
        if self.order > 2:
            self.fail_weight = np.append(self.fail_weight, np.log10(mu[1] / (c2[where] + mu[1])))
            self.fail_state = np.append(self.fail_state, tokens[where] + 2)
            state = np.zeros(len(tokens), np.int64)  # of the pair that ends at a token
            state[used] = pair + size + 2
            c3 = counts[2]
            used = np.nonzero(c3 > 0)[0]
            arc3, at = np.unique(state[used - 1] * size + tokens[used], return_index=True)
            where = used[at]
            arcs.append(arc3)
            weights.append(np.log10((c3[where] + mu[1] * p2[where]) / (c2[where - 1] + mu[1])))
            after.append(state[where])
        self.arcs, self.weights, self.after = np.concatenate(arcs), np.concatenate(weights), np.concatenate(after)

    def scores(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text (word numbers with the end token) in one traversal, all texts in step."""
        starts = np.cumsum(lengths) - lengths
        pieces = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), pieces)
        place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text] + place * PIECE
        size = np.minimum(begin + PIECE, (starts + lengths)[text]) - begin
        later = place > 0
        at, size = begin - later * (self.order - 1), size + later * (self.order - 1)
        by_size = np.argsort(-size, kind="stable")  # those under way are always the first ones
        at, later = at[by_size], later[by_size]
        running = len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), side="right")
        state, total = np.where(later, 0, 1), np.zeros(len(size))
        for step, m in enumerate(running.tolist()):
            if step == self.order - 1:
                total[later] = 0.0
            w = tokens[at[:m] + step]
            left = np.arange(m)
            while len(left):  # the empty context has every arc, so this ends there
                s = state[left]
                key = s * self.size + w[left]
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[arc] == key
                to, arc = left[hit], arc[hit]
                total[to] += self.weights[arc]
                state[to] = self.after[arc]
                left, s = left[~hit], s[~hit]
                total[left] += self.fail_weight[s]
                state[left] = self.fail_state[s]
        whole = np.empty(len(size))
        whole[by_size] = total
        return np.bincount(text, weights=whole, minlength=len(lengths))


def _traverse(order: int, mu: tuple[float, ...], n: int, v: int):
    kinds = pa.schema([("id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True))
        for row in left.to_pylist():
            chunk = Chunk(row)
            totals = np.concatenate([unpack(answers[b]) for b in sorted(answers)])
            auto = Automaton(chunk, chunk.all_ngrams(order), totals, n, v, mu)
            starts = chunk.ends - chunk.lengths
            base = np.add.reduceat(auto.base[chunk.tokens], starts)
            known = np.add.reduceat(auto.known[chunk.tokens].astype(np.int64), starts)
            scores = auto.scores(chunk.tokens, chunk.lengths)
            ids = pa.array(chunk.ids, pa.int64(), mask=chunk.ids_null)
            out.append(pa.Table.from_arrays([ids, pa.array(chunk.training), pa.array(chunk.lengths), pa.array(known), pa.array(base), pa.array(scores)],
                                            schema=kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()
    return run


_WORDS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("n", pa.int64())])


def _training_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct training words of each chunk by hash range, and its number of training tokens."""
        for b in batches:
            for row in b.to_pylist():
                chunk = Chunk(row)
                learned = chunk.vocabulary[np.bincount(chunk.tokens[chunk.learned], minlength=len(chunk.vocabulary)) > 0]
                bucket = (learned >> np.uint64(64 - bits)).astype(np.int64)
                out = [(int(bucket[lo]), pack_sorted(learned[lo:hi]), 0) for lo, hi in runs(bucket)]
                out.append((0, pack_sorted(learned[:0]), int(chunk.learned.sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _WORDS, strict=True)], schema=_WORDS)
    return run


def _distinct_words(table: pa.Table) -> pa.Table:
    words = [unpack_sorted(w) for w in table.column("words").to_pylist()]
    return pa.table({"v": pa.array([len(distinct(np.concatenate(words)))], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


def score(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER,
          mu: tuple[float, ...] = MU) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score and score of every row; the rows where
    ``training`` holds are learned from."""
    given = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("_text"), F.coalesce(training, F.lit(False)).alias("training"))
    numbered = given.mapInArrow(_pack_chunks, _CHUNKS_SQL)
    # partition and place name a chunk; they are stored with it
    chunks = stored(numbered.withColumn("chunk", F.monotonically_increasing_id()))
    bits = min(20, max(6, (chunks.count() // 8).bit_length()))  # some eight chunks' words in a range
    totals = (chunks.mapInArrow(_training_words(bits), "bucket int, words binary, n long").groupBy("bucket")
              .applyInArrow(_distinct_words, "v long, n long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first())
    n, v = totals.n or 0, totals.v or 0
    ranges = int(max(64, n * order // RANGE))
    answered = None
    for turn in range(PASSES):
        asked = chunks.mapInArrow(_ask(order, ranges, turn), "bucket int, chunk long, keys binary, counts binary")
        part = stored(asked.groupBy("bucket").applyInArrow(_answer, "bucket int, chunk long, totals binary"))
        answered = part if answered is None else answered.union(part)
    out = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        _traverse(order, mu, n, v), "id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_column), "training", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
