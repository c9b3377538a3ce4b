import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from portcullis.operators import signatures as G


def matches(spark, bodies, sigs):
    items = spark.createDataFrame(bodies, "item_id long, body string").repartition(3)
    table = spark.createDataFrame([(i, t, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in sigs], "sig_id long, text string, digest string")
    return {tuple(r) for r in G.signature_match(items, table).collect()}


def brute(bodies, sigs):
    return {(i, s, "digest" if b == t else "text") for i, b in bodies for s, t in sigs if b and t and t in b}


def test_signatures_of_every_length(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "ß", " ", "\n", "xy", "common"]
    bodies = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 20, 80, 300])))) for i in range(60)] + [(900, None)]
    sigs, n = [], 0
    for length in [*range(1, 20), 30, 45, 46, 47, 48, 60, 120]:
        for _ in range(3):
            body = rng.choice([b for _, b in bodies if b and len(b) >= length])
            at = rng.randrange(len(body) - length + 1)
            sigs.append((n, body[at:at + length]))
            sigs.append((n + 1, body[at:at + length][:-1] + "Q"))
            n += 2
    sigs += [(5000, bodies[8][1]), (5001, None), (5002, "zzzz" * 40)]
    assert matches(spark, bodies, sigs) == brute(bodies, sigs)


def test_a_common_middle_word_and_shared_beginnings(spark):
    bodies = [(i, " ".join(f"w{i}x{j} the v{j}" for j in range(30))) for i in range(200)]
    sigs = [(i, f"w{i}x3 the v3") for i in range(0, 200, 7)] + [(1000 + i, f"the same long beginning of many signatures, number {i}") for i in range(50)]
    bodies += [(500, f"so: {sigs[-1][1]}.")]
    want = brute(bodies, sigs)
    assert (500, 1049, "text") in want and matches(spark, bodies, sigs) == want


def test_long_bodies_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    sigs = [(i, body[i * 61:i * 61 + length]) for i, length in enumerate([50, 200, 47, 16, 9, 8, 3] * 10)]
    whole = G.window_minima(np.frombuffer(body.encode(), np.uint8), 0)
    monkeypatch.setattr(G, "PIECE", 300)
    got = [g for b in G._minima(pa.array([7, 8, 9]), [body.encode(), None, b"x" * 70], 0, None) for i, g in zip(b.column("id").to_pylist(), b.column("gram").to_numpy().view("u8").tolist(), strict=True) if i == 7]
    assert set(got) == set(whole.tolist())
    assert matches(spark, [(1, body)], sigs) == brute([(1, body)], sigs)


@pytest.mark.parametrize("bodies, sigs", [([], [(1, "a")]), ([(1, "a")], []), ([(1, "")], [(1, "")])])
def test_empty_sides(spark, bodies, sigs):
    got = matches(spark, bodies, sigs)
    assert got == ({(1, 1, "digest")} if bodies and sigs else set())


def test_signature_copies_meet_once(spark, monkeypatch):
    """Copies of a signature are one anchor, yet each is reported for each copy of a body."""
    from portcullis.operators import signatures as G
    seen, given = [], G.anchors
    monkeypatch.setattr(G, "anchors", lambda s: seen.append(s.count()) or given(s))
    items = spark.createDataFrame([(i, "say alpha beta gamma now") for i in range(20)], "item_id long, body string")
    sigs = spark.createDataFrame([(i, "alpha beta gamma", "-") for i in range(15)] + [(99, None, "-")], "sig_id long, text string, digest string")
    assert {tuple(r) for r in G.signature_match(items, sigs).collect()} == {(i, s, "text") for i in range(20) for s in range(15)}
    assert seen == [1]
