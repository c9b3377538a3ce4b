import hashlib
import random

import numpy as np
import pytest

from portcullis.llm import bpe as E

ALPHABET = [*"abcdefghijklmnopqrstuvwxyz'' .,!?$&%#|0123456789ABCDE\n\t\r\x0b\x0c\x1c\x85\xa0", *"éèçßäñİıſÀµªº²½Σς中🙂",
            "é", "​", " ", "　", "<|endoftext|>", "<|startoftext|>", "<|", "'S", "'ll"]


@pytest.fixture(scope="module")
def tables():
    return E.opened(E.word_vocabulary())


def same(tables, text):
    ids = np.frombuffer(tables.encode(text), "<u4")
    want = tables.library.encode(text, add_special_tokens=False).ids
    assert list(ids) == want, text[:200]
    assert tables.decode(ids).decode() == tables.library.decode(want, skip_special_tokens=False)


def test_equals_the_library(tables):
    rng = random.Random(11)
    for _ in range(1500):
        same(tables, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 2, 5, 40, 150]))))
        same(tables, "".join(rng.choice("thesinaroedlg") for _ in range(rng.choice([3, 9, 17, 80]))))
    for text in ["", " ", "a" * 3000, "ab" * 2000, "the " * 20000, "<|endoftext|>" * 3, "'''''s"]:
        same(tables, text)


def test_backtracking_equals_plain_merges(tables):
    """Against the definition: apply the oldest merge first, leftmost first."""
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aeinorstlh") for _ in range(rng.randint(1, 25)))
        s = word[:-1] + tables.lifted[word[-1]]
        parts = [tables.whole[c] for c in s]
        while True:
            found = [(tables.merged[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in tables.merged]
            if not found:
                break
            token, i = min(found)
            parts[i:i + 2] = [token]
        assert tables.encode_symbols(s) == parts


def test_rows(spark, tables):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "Hello  world's", 7), (3, "Hello  world's", 7), (None, "x " * 300000, 8)],
                                 "doc_id long, text string, n int").toDF("doc_id", "text", "doc_id")
    out = [tuple(r) for r in E.digests(docs).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert out[0] == (1, 7, 0, empty, empty) and out[1][2:] == out[0][2:] and out[2] == out[3] and out[4][2] == 300000
    encoded = E.encode(docs)
    assert encoded.columns == ["doc_id", "doc_id", "_ids", "_n_tokens"]
    assert [r[-1] for r in E.decode(encoded).collect()][2] == "hello</w> world</w> 's</w>"
    assert E.digests(docs.limit(0)).count() == 0
