"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input is the embedding of its hash and the mean embedding of its character trigrams (with both ends
marked). Two gated recurrent units read a window of ``WINDOW`` words in both directions, attention pools their
states, and a logistic unit scores the window. All overlapping windows of a text (a new one every ``STRIDE``
words, and one that ends with the text) are scored; the text's score is that of its worst window, calibrated.

Training is plain numpy on the driver, on a bounded sample: at most ``SAMPLE`` labelled documents of each class
(those with the smallest hashes of doc_id) whose text has at most ``SAMPLE_BYTES`` bytes. First every window
carries its document's label, then, in rounds, only the worst windows do. A fifth of the sample calibrates.
The model has a fixed size and is broadcast; scoring shuffles nothing. As a word's part of the gates does not
depend on its place, it is computed once for each distinct word of a piece of text, and long texts are
scored in pieces of ``PIECE`` words that overlap by a window. Labels, language, source and ids are no inputs.

Defined results: null and empty texts, and texts without any word, score the share of label 1 in the sample;
without labels of both classes every score is that share (0.0 without any label). Repeated rows are scored
each; labels that disagree on one document count as toxic if half of them are; a null label is no label.
``score`` returns only the id (which may be null) and the score, so other columns cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import crc_rest, small_batches

#: Bounds of what is fitted and broadcast.
SAMPLE, SAMPLE_BYTES = 1500, 16_384
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN, HEADS = 4096, 8192, 12, 8, 8
WINDOW, STRIDE = 24, 12
#: Words of a long text, and windows, that are in memory at a time.
PIECE, BLOCK = 1 << 16, 4096
#: Lower-case text: digits, letters and bytes of other characters stay, the rest separates words.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEPT).split()


def word_inputs(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word, trigram buckets of all words, and where each word's trigrams begin."""
    buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_BUCKETS for w in distinct), np.int64, len(distinct))
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    # each word between marks; a trigram is centred on each of the word's bytes
    line = np.frombuffer(b"\x02" + b"\x03\x02".join(distinct) + b"\x03", np.uint8).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(int(sizes.sum())) + np.repeat(1 + 2 * np.arange(len(sizes)), sizes)
    h = line[at - 1] * _GRAM[0] ^ line[at] * _GRAM[1] ^ line[at + 1] * _GRAM[2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return buckets, ((h ^ (h >> np.uint32(13))) % np.uint32(GRAM_BUCKETS)).astype(np.int64), begins


def _mean_of(table: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.concatenate([begins, [len(grams)]]))
    return np.add.reduceat(table[grams], begins, axis=0) / sizes[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of n words: every stride, and one that ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


@dataclass
class Network:
    """Parameters by name; ``d`` is 0 (forwards) or 1 (backwards)."""
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"word": normal(WORD_BUCKETS, WIDTH, scale=0.1), "gram": normal(GRAM_BUCKETS, WIDTH, scale=0.3),
             "attend": normal(2 * HIDDEN, HEADS, scale=0.3), "attend_b": np.zeros(HEADS, np.float32), "focus": normal(HEADS, scale=0.3),
             "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32)}
        for d in "01":
            p |= {"in" + d: normal(2 * WIDTH, 3 * HIDDEN, scale=0.3), "bias" + d: np.zeros(3 * HIDDEN, np.float32), "again" + d: normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
        return cls(p)

    def inputs(self, distinct: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray | None = None) -> np.ndarray:
        """Word and character embedding of each distinct word; ``keep`` masks word embeddings in training."""
        word = self.p["word"][distinct[0]]
        return np.hstack([word if keep is None else word * keep, _mean_of(self.p["gram"], *distinct[1:])])

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Each distinct word's part of the gates of both directions, with a last row of zeros for padding."""
        return [np.vstack([x @ self.p["in" + d] + self.p["bias" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "01"]

    def forward(self, ids: np.ndarray, gates: list[np.ndarray], trace: list | None = None) -> np.ndarray:
        """Logit of each window. ``ids``: windows x WINDOW numbers of distinct words, -1 where there is none.
        ``trace`` gets what the backward pass needs."""
        n, H = len(ids), HIDDEN
        there = ids >= 0
        whole = bool(there.all())
        states = np.zeros((WINDOW, n, 2 * H), np.float32)
        steps: list[list] = [[], []]
        for d in (0, 1):
            u, h = self.p[f"again{d}"], np.zeros((n, H), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g, hu = gates[d][ids[:, t]], h @ u
                zr = _sigmoid(g[:, :2 * H] + hu[:, :2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(g[:, 2 * H:] + r * hu[:, 2 * H:])
                if not whole:
                    z = z * there[:, t, None]
                if trace is not None:
                    steps[d].append((t, h, z, r, c, hu[:, 2 * H:]))
                h = h + z * (c - h)
                states[t, :, d * H:(d + 1) * H] = h
        a = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        e = a @ self.p["focus"]
        if not whole:
            e = np.where(there.T, e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnk->nk", w, states)
        if trace is not None:
            trace.extend([steps, states, a, w, pooled])
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def backward(self, ids: np.ndarray, x: np.ndarray, distinct, keep: np.ndarray, trace: list, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of every parameter, given those of the logits."""
        steps, states, a, w, pooled = trace
        p, H, grad = self.p, HIDDEN, {}
        grad["out"], grad["out_b"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("tnk,nk->tn", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(0))
        grad["focus"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[:, :, None] * p["focus"] * (1 - a * a)
        grad["attend"], grad["attend_b"] = np.einsum("tnk,tnj->kj", states, d_a), d_a.sum((0, 1))
        d_states = d_states + d_a @ p["attend"].T
        d_x = np.zeros((len(x) + 1, 2 * WIDTH), np.float32)
        for d in (0, 1):
            u, d_h = p[f"again{d}"], np.zeros((len(ids), H), np.float32)
            d_u, d_gates = np.zeros_like(u), np.zeros((len(x) + 1, 3 * H), np.float32)
            rows, values = [], []
            for t, h, z, r, c, hu in reversed(steps[d]):
                d_h = d_h + d_states[t, :, d * H:(d + 1) * H]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * z * (1 - z)
                d_r = d_c * hu * r * (1 - r)
                d_hu = np.hstack([d_z, d_r, d_c * r])
                d_u += h.T @ d_hu
                rows.append(ids[:, t])
                values.append(np.hstack([d_z, d_r, d_c]))
                d_h = d_h * (1 - z) + d_hu @ u.T
            rows, values = np.concatenate(rows), np.concatenate(values)
            for k in range(3 * H):
                d_gates[:, k] = np.bincount(rows % (len(x) + 1), values[:, k], len(x) + 1)
            d_gates[-1] = 0
            grad[f"again{d}"], grad[f"in{d}"], grad[f"bias{d}"] = d_u, x.T @ d_gates[:-1], d_gates.sum(0)
            d_x += d_gates @ p[f"in{d}"].T
        buckets, grams, begins = distinct
        sizes = np.diff(np.concatenate([begins, [len(grams)]]))
        d_word, d_gram = d_x[:-1, :WIDTH] * keep, np.repeat(d_x[:-1, WIDTH:] / sizes[:, None], sizes, axis=0)
        grad["word"] = np.stack([np.bincount(buckets, d_word[:, k], WORD_BUCKETS) for k in range(WIDTH)], 1)
        grad["gram"] = np.stack([np.bincount(grams, d_gram[:, k], GRAM_BUCKETS) for k in range(WIDTH)], 1)
        return grad


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-6)


@dataclass
class Model:
    network: Network
    prior: float          # share of label 1 in the sample
    scale: float = 1.0    # calibration of the worst window's logit
    shift: float = 0.0
    trained: bool = False


class _Numbers(dict):
    """Number of each distinct word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _windows(ids: np.ndarray) -> np.ndarray:
    """All windows of one text's word numbers; -1 fills a text shorter than a window."""
    if len(ids) < WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)), constant_values=-1)[None, :] if len(ids) else np.empty((0, WINDOW), np.int64)
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[window_starts(len(ids))]


def logits(network: Network, texts: list[str | None]) -> np.ndarray:
    """Logit of the worst window of each text; -inf for texts without words."""
    out = np.full(len(texts), -np.inf)
    owners, parts, numbers, held = [], [], _Numbers(), 0

    def flush() -> None:
        nonlocal numbers, held
        if parts:
            ids, owner = np.concatenate(parts), np.concatenate(owners)
            gates = network.gates(network.inputs(word_inputs(list(numbers))))
            # windows with gaps go together, so the others need no mask
            gaps = ids[:, -1] < 0
            for chosen in (np.nonzero(~gaps)[0], np.nonzero(gaps)[0]):
                for lo in range(0, len(chosen), BLOCK):
                    at = chosen[lo:lo + BLOCK]
                    np.maximum.at(out, owner[at], network.forward(ids[at], gates))
        owners.clear()
        parts.clear()
        numbers, held = _Numbers(), 0

    for i, text in enumerate(texts):
        ws = words(text)
        for lo in range(0, len(ws), PIECE):
            # the next piece begins where this one's last window could still reach
            piece = ws[lo:lo + PIECE + WINDOW]
            w = _windows(np.fromiter(map(numbers.__getitem__, piece), np.int64, len(piece)))
            parts.append(w)
            owners.append(np.full(len(w), i))
            held += len(piece)
            if held >= PIECE:
                flush()
    flush()
    return out


def calibrated(model: Model, worst: np.ndarray) -> np.ndarray:
    if not model.trained:
        return np.full(len(worst), model.prior)
    return np.where(np.isneginf(worst), model.prior, _sigmoid(model.scale * np.where(np.isneginf(worst), 0, worst) + model.shift))


def _train_step(network: Network, adam: _Adam, ids: np.ndarray, distinct, label: np.ndarray, weight: np.ndarray, rng) -> None:
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    if used[0] < 0:
        at, used = at - 1, used[1:]
    buckets, grams, begins = distinct
    stops = np.concatenate([begins[1:], [len(grams)]])
    sizes = stops[used] - begins[used]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = (buckets[used], grams[np.arange(int(sizes.sum())) + np.repeat(begins[used] - starts, sizes)], starts)
    # a word's own embedding is left out half of the time, so that its characters count as well
    keep = (rng.random((len(used), 1)) < 0.5).astype(np.float32)
    x, trace = network.inputs(own, keep), []
    logit = network.forward(at, network.gates(x), trace)
    slope = ((_sigmoid(logit) - label) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
    adam.step(network.p, network.backward(at, x, own, keep, trace, slope * 8))


def fit_model(texts: list[str], labels: np.ndarray, seed: int = 11, steps: int = 420, rounds: int = 5, batch: int = 384) -> Model:
    """Train on whole sampled texts: passes over all windows until ``steps`` batches are reached (at least two passes, at
    most twenty), then ``rounds`` over the worst ones."""
    model = Model(Network.fresh(seed), float(labels.mean()) if len(labels) else 0.0)
    tokens = [words(t) for t in texts]
    there = [i for i, ws in enumerate(tokens) if ws]
    if len({bool(labels[i]) for i in there}) < 2:
        return model
    rng, numbers = np.random.default_rng(seed), _Numbers()
    parts = [_windows(np.fromiter(map(numbers.__getitem__, tokens[i]), np.int64, len(tokens[i]))) for i in there]
    owner = np.repeat(np.arange(len(there)), [len(w) for w in parts])
    ids, y = np.concatenate(parts), (labels[there] > 0.5).astype(np.float32)
    distinct = word_inputs(list(numbers))
    # every fifth document is kept for the calibration, if there are enough
    check = np.arange(len(there)) % 5 == 0 if min(y.sum(), len(y) - y.sum()) >= 20 else np.zeros(len(there), bool)
    rate = np.where(y > 0, 0.5 / max(y[~check].sum(), 1), 0.5 / max((1 - y)[~check].sum(), 1))  # both classes weigh the same
    count = np.bincount(owner)
    adam = _Adam(model.network.p, 0.02)

    def all_logits() -> np.ndarray:
        gates = model.network.gates(model.network.inputs(distinct))
        return np.concatenate([model.network.forward(ids[lo:lo + BLOCK], gates) for lo in range(0, len(ids), BLOCK)])

    def epoch(chosen: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), batch):
            at = order[lo:lo + batch]
            _train_step(model.network, adam, ids[chosen[at]], distinct, label[at], weight[at], rng)

    training = np.nonzero(~check[owner])[0]
    for _ in range(min(max(2, -(-steps * batch // len(training))), 20)):
        epoch(training, y[owner[training]], (rate / count)[owner[training]])
    for r in range(rounds):
        adam.rate = 0.01 * 0.7 ** r
        value = all_logits()
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        # the worst window of a toxic document; the worst three and some others of a clean one
        toxic = y[owner[order]] > 0
        take = np.where(toxic, place < 1, (place < 3) | (rng.random(len(order)) < 0.05)) & ~check[owner[order]]
        chosen = order[take]
        for _ in range(3):
            epoch(chosen, y[owner[chosen]], rate[owner[chosen]])
    value = all_logits()
    worst = np.full(len(there), -np.inf)
    np.maximum.at(worst, owner, value)
    on = check if check.any() else np.ones(len(there), bool)
    model.scale, model.shift = _calibrate(worst[on], y[on])
    model.trained = True
    return model


def _calibrate(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (kept near 1) and shift of a logistic fit, classes weighed equally; Newton steps that are halved until
    the loss falls."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def loss(v: np.ndarray) -> float:
        x = v[0] * worst + v[1]
        return float((weight * (np.logaddexp(0, x) - y * x)).sum() + 0.005 * (v[0] - 1) ** 2 + 0.0005 * v[1] ** 2)

    v = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(v[0] * worst + v[1])
        g = np.array([(weight * (q - y) * worst).sum() + 0.01 * (v[0] - 1), (weight * (q - y)).sum() + 0.001 * v[1]])
        c = weight * q * (1 - q)
        step = np.linalg.solve(np.array([[(c * worst * worst).sum() + 0.01, (c * worst).sum()], [(c * worst).sum(), c.sum() + 0.001]]), g)
        while loss(v - step) > loss(v) and np.abs(step).max() > 1e-9:
            step = step / 2
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return float(v[0]), float(v[1])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """_order, _text and _label of at most ``sample`` labelled documents of each class outside the held-out fifth."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_rest("doc_id", 5) != 0))
             .groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("_label")).withColumn("_order", F.xxhash64("_id")))
    first = lambda label: known.where(F.col("_label") == label).orderBy("_order", "_id").limit(sample)
    # at most twice ``sample`` rows of three numbers: a proven bound
    chosen = F.broadcast(first(1).unionByName(first(0)))
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select(F.col("doc_id").alias("_doc"), text.alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
            .join(chosen, F.col("_doc") == F.col("_id")).groupBy("_order", "_id", "_label").agg(F.min("_text").alias("_text")).select("_order", "_text", "_label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The driver receives at most twice ``sample`` texts of at most ``SAMPLE_BYTES`` bytes."""
    rows = training_rows(docs, labels, sample).orderBy("_order").limit(2 * sample).collect()
    return fit_model([r._text for r in rows], np.array([r._label for r in rows], np.float64))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = calibrated(m, logits(m.network, b.column(1).to_pylist())) if m.trained else np.full(b.num_rows, m.prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["id", "score"])

    given = small_batches(docs).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double")
