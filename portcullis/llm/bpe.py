"""BPE encoding by backtracking and decoding by an offset table, for vocabularies with word ends.

The vocabulary file (a parameter, never copied) must number its tokens as letters, letters at a word's
end, then merges in order. A piece is a run of letters, each one symbol; an Aho-Corasick automaton over
the tokens finds every token inside the piece in one pass. The encoder goes from left to right, tries
the longest token at its place and takes it if it may follow the token before: a table of compatible
pairs, filled on demand, tells whether the merges would leave the two apart. Where nothing fits it steps
back and never returns to a dead place, so the work is linear, and the result is exactly that of the
merges.

Texts within Latin letters are normalised and split here; others are split by the library's own
normaliser and splitter, whose character tables then decide. Special tokens in a text are taken whole.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows are
encoded each; other columns, clashing names included, are kept.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from portcullis.llm.common import small_batches, tidy

#: Pieces whose tokens one worker remembers, and their longest length in characters.
REMEMBERED_PIECES, REMEMBERED_LENGTH = 120_000, 40
_NOT_LATIN = regex.compile(r"[^\x00-ɏ]")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xA0  -     　\p{L}\p{N}]+")
NO_LIMIT = 1 << 60
LIFT = 0x1000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Tables of one vocabulary file and the memory of pieces seen."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        # a piece is written in the letters of its bytes; the last one is lifted out of their range
        self.lifted = {c: chr(ord(c) + LIFT) for c in letters}
        self.letters = {i: c for i, c in enumerate(letters)}

        def symbols(token: str) -> str:
            if token.endswith(end) and len(token) > len(end):
                body = token[:-len(end)]
                return body[:-1] + self.lifted[body[-1]]
            return token

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.first_merge = len(vocab) - len(merges)
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(vocab))]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t != self.first_merge + rank:
                raise ValueError("tokens are not numbered in the order of their merges")
            self.split[t] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = t
        automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        size: list[int] = [0] * len(vocab)
        for token, i in vocab.items():
            s = symbols(token)
            size[i] = len(s)
            self.whole[s] = i
            automaton.add_word(s, i)
        automaton.make_automaton()
        self.automaton, self.size = automaton, size
        # the longest token that a token begins with
        self.shorter = [-1] * len(vocab)
        for s, i in self.whole.items():
            self.shorter[i] = next((t for n in range(len(s) - 1, 0, -1) if (t := self.whole.get(s[:n])) is not None), -1)
        self.compatible: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # decoding: all tokens, each with the blank that follows it, and where each begins
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.starts = np.cumsum([0, *map(len, parts)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the memories, which would stay in the worker; the tables of the vocabulary stay."""
        self.pieces.clear()
        self.compatible.clear()

    def may_follow(self, left: int, right: int) -> bool:
        """True if the merges leave ``left`` and ``right`` as they are side by side; remembered."""
        if len(self.compatible) > 500_000:
            self.compatible.clear()
        known = self.compatible[left << 20 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undo the younger of the two tokens step by step; a merge across the seam that is older than
        the step undone would have come first."""
        limit = NO_LIMIT
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def encode_symbols(self, s: str) -> list[int]:
        """Tokens of one piece, given as symbols with the last one at a word's end."""
        whole = self.whole.get(s)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(s), self.size, self.shorter, self.compatible.get
        longest = [0] * n
        for end, token in self.automaton.iter(s):  # by end, so the longest token of a place comes last
            longest[end + 1 - size[token]] = token
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                if alive[pos + size[token]]:
                    if before < 0:
                        break
                    fits = known(before << 20 | token)
                    if fits or (fits is None and self.may_follow(before, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += size[token]
                if pos == n:
                    return out
                before, token = token, longest[pos]
            else:
                alive[pos] = 0
                back = out.pop()
                pos -= size[back]
                before, token = out[-1] if out else -1, shorter[back]

    def piece(self, text: str) -> bytes:
        """Token numbers of a piece of normalised text as little-endian 32-bit integers."""
        s = text if text.isascii() and text.isprintable() else text.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.letters)
        ids = self.packed(s)
        if len(text) <= REMEMBERED_LENGTH:
            if len(self.pieces) >= REMEMBERED_PIECES:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def packed(self, letters: str) -> bytes:
        """The same for a piece whose bytes are already written as letters."""
        ids = self.encode_symbols(letters[:-1] + self.lifted[letters[-1]])
        return pack("<%dI" % len(ids), *ids)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _NOT_LATIN.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join([self.packed(p) for p, _ in pieces if p])
        known = self.pieces.get
        return b"".join([known(p) or self.piece(p) for p in _PIECE.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self._plain(text)
        return b"".join(int(self.special[p]).to_bytes(4, "little") if p in self.special else self._plain(p)
                        for p in self.special_pattern.split(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the tokens, with a blank between them, gathered from the offset table."""
        if not len(ids):
            return b""
        starts = self.starts[ids]
        sizes = self.starts[ids + 1] - starts
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)][:-1].tobytes()


@lru_cache(maxsize=2)
def opened(path: str) -> Bpe:
    """One table for each Python worker."""
    return Bpe(path)


def word_vocabulary() -> str:
    import public_tokenizers
    return os.environ.get("PORTCULLIS_WORD_BPE") or public_tokenizers.path("word_bpe_49k.json")


def _mapped(docs: DataFrame, column: str, path: str, fields: list[StructField],
            fn: Callable[[Bpe, bytes], tuple]) -> DataFrame:
    """``docs`` without ``column``, and the fields that ``fn`` makes of its text."""
    rest = [i for i, c in enumerate(docs.columns) if c != column]
    inner = small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    inner = inner.select(*[f"c{i}" for i in rest], F.coalesce(f"c{docs.columns.index(column)}", F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 512):  # bounded output, whatever the texts
                part = b.slice(lo, 512)
                made = [fn(bpe, t) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [pa.array([m[i] for m in made], f) for i, f in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=names)
        bpe.forget()

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*[f"c{i}" for i in rest], *[f"n{i}" for i in range(len(fields))]]
    kept = [f for f in inner.schema.fields if f.name != "t"]
    out = inner.mapInArrow(tidy(run), StructType([*kept, *[StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]]))
    return out.toDF(*[docs.columns[i] for i in rest], *[f.name for f in fields])


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Every other column of ``docs``, and _ids (token numbers, packed little-endian) and _n_tokens."""
    from pyspark.sql.types import BinaryType

    def one(bpe: Bpe, text: bytes) -> tuple:
        ids = bpe.encode(text.decode("utf-8", "surrogateescape"))
        return ids, len(ids) // 4
    return _mapped(docs, column, path or word_vocabulary(), [StructField("_ids", BinaryType()), StructField("_n_tokens", LongType())], one)


def decode(encoded: DataFrame, path: str | None = None, column: str = "_ids") -> DataFrame:
    """Every other column of ``encoded``, and _decoded."""
    def one(bpe: Bpe, ids: bytes) -> tuple:
        return (bpe.decode(np.frombuffer(ids, "<u4")).decode(),)
    return _mapped(encoded, column, path or word_vocabulary(), [StructField("_decoded", StringType())], one)


def digests(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Encode and decode in one pass: every other column, n_tokens and the SHA-256 of numbers and decoded text."""
    def one(bpe: Bpe, text: bytes) -> tuple:
        ids = bpe.encode(text.decode("utf-8", "surrogateescape"))
        back = bpe.decode(np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
    return _mapped(docs, column, path or word_vocabulary(), [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], one)
