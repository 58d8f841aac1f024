"""Byte-level BPE encoding and decoding by a rank table.

A text is cut by the tokenizer's pattern and each match is encoded separately. A
match that is itself a token is that token. Else its bytes are read as Latin-1, so
that a pyahocorasick automaton over the vocabulary finds the longest token at a
position, and the encoder backtracks from longest matches: a token may follow
another only if the two, merged alone by rank, stay as they are. A sequence of
tokens in which every neighbouring pair is stable in that sense is the one that
merging by rank gives, so no merge loop runs over the match itself. Pair answers are
memoised, positions that led nowhere are marked, hence each position is left behind
once and the time is linear in the match's length.

Encoders are built once per Python worker from the rank file's bytes, which the
driver broadcasts after checking their size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE_LIMIT = 64 << 20
WORD_CACHE, PAIR_CACHE, CACHED_LENGTH = 1 << 19, 1 << 20, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from a file of ``base64 rank`` lines."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.latin = {i: t.decode("latin-1") for i, t in self.tokens.items()}
        self.by_text = {t: i for i, t in self.latin.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter_of: dict[int, int | None] = {}
        # only tokens that merging can reach take part inside a match; the rest stand alone
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1 or self.merge(token) == [i]:
                self.automaton.add_word(self.latin[i], i)
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Merge ``data`` by rank, lowest first, leftmost of equals: the definition, for short inputs."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives just these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int | None:
        """The longest reachable token that is a proper prefix of this one."""
        if token not in self.shorter_of:
            text = self.latin[token]
            self.shorter_of[token] = next((self.by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.automaton), None)
        return self.shorter_of[token]

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        longest = self.longest_from(text)
        out, ends, dead = [], [0], bytearray(n + 1)
        token = longest(0)
        while ends[-1] < n or token is not None:
            at = ends[-1]
            end = at + len(self.latin[token])
            if not dead[end] and (not out or self.stable(out[-1], token)):
                out.append(token)
                ends.append(end)
                if end == n:
                    return out
                token = longest(end)
            else:
                token = self.shorter(token)
            while token is None:  # nothing fits here: this position is dead, go back one token
                dead[ends.pop()] = 1
                token = self.shorter(out.pop())
        return out

    def longest_from(self, text: str) -> Callable[[int], int]:
        automaton = self.automaton

        def longest(at: int) -> int:
            # every single byte is a token, so the leftmost longest match begins at ``at``
            return next(automaton.iter_long(text, at))[1]

        return longest

    def encode(self, text: str) -> list[int]:
        known, out = self.words, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                known = self.words
            out += ids
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a match not among the recent ones; two generations bound the memory."""
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.encode_match(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            if len(self.words) >= WORD_CACHE:
                self.words, self.older = {}, self.words
            self.words[piece] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(data), pattern)


def _rank_bytes(df: DataFrame, path: str):
    """The rank file, read where the driver runs, at most RANK_FILE_LIMIT bytes, as a broadcast."""
    with open(path, "rb") as f:
        data = f.read(RANK_FILE_LIMIT + 1)
    if len(data) > RANK_FILE_LIMIT:
        raise ValueError(f"{path} is over {RANK_FILE_LIMIT} bytes: not a rank table to broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col`` array<int>: the ids of the whole text. Null and empty texts: no ids. Other columns stay."""
    ranks = _rank_bytes(docs, path)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _encoder(ranks.value, pattern)
        for texts in batches:
            yield pa.array([bpe.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out_col, F.arrow_udf(encode, "array<int>")(F.col(text_col)))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` binary: the bytes of the ids. Null ids: empty. An id outside the vocabulary raises."""
    ranks = _rank_bytes(df, path)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _encoder(ranks.value, pattern)
        for ids in batches:
            yield pa.array([bpe.decode(x or []) for x in ids.to_pylist()], pa.binary())

    return df.withColumn(out_col, F.arrow_udf(decode, "binary")(F.col(ids_col)))


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; ids are decoded again in the same pass.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers. Null and
    empty texts: 0 tokens, both digests of no bytes. Repeated rows give repeated rows;
    a null id stays null; extra columns are not read.
    """
    ranks = _rank_bytes(docs, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks.value, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(_little_endian(ids)).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _little_endian(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, "<u4").tobytes()
