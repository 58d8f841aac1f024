"""Substring dedup: remove words covered by a repeated fixed-length word window.

Rabin-Karp hashes of every window of ``window`` words are counted over the corpus,
and the repeated windows of a document merge into maximal removal intervals.

Shape of the job (three shuffles, none holding a row per window):

1. documents are dealt by a hash of their row into chunks of bounded bytes, repeated
   rows as one with their number (counted per batch before the shuffle, then summed);
2. each chunk sends every hash bucket one packed, duplicate-free list of its window
   hashes (10 bytes a window: 64 + 16 bits of two independent hashes; a flag marks
   those that occur twice inside the chunk), so a window that a third of all rows
   share reaches its bucket once per chunk, not once per row;
3. a bucket marks what more than one chunk sent, and answers each chunk with one
   bit per hash; chunks are grouped again with their answers and cut their texts,
   and a row comes out as often as it went in.

The chunk of a row and the order in a chunk depend on the row's hash alone, so
recomputed tasks send and read the same lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, row_slices, text_buffer, window_hashes, word_hashes

_BASE_1, _BASE_2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_SALT = np.uint64(0xA0761D6478BD642F)
_BLOCK = 4096


def _windows(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of each window inside a row, its first word, and the rows' word offsets."""
    h1, h2, at, rows, base = [], [], [], [np.zeros(1, np.int64)], 0
    for a, b in row_slices(offs):
        words, r = word_hashes(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
        x = window_hashes(words, k, _BASE_1)
        y = window_hashes(mix(words ^ _SALT), k, _BASE_2)
        # a window that starts in the last k - 1 words of a row would leave it
        stop = np.repeat(r[1:], np.diff(r))[:len(x)]
        ok = np.flatnonzero(np.arange(len(x)) + k <= stop)
        h1.append(x[ok])
        h2.append((y[ok] >> np.uint64(48)).astype(np.uint16))
        at.append(ok + base)
        rows.append(r[1:] + base)
        base += len(words)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(h1, np.uint64), join(h2, np.uint16), join(at, np.int64), np.concatenate(rows)


def _distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, which ordered entries are the first of their value, and the value's number of each."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first, np.cumsum(first) - 1


def _bounds(h1: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the ordered hashes begins; buckets are equal hash ranges."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64)) // buckets
    return np.concatenate([[0], np.searchsorted(h1, edges.astype(np.uint64)), [len(h1)]])


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                    chunk_chars: int = 12 << 20, bucket_windows: int = 2 << 20) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept`` intervals and ``kept_text``.

    A word goes when a window of ``window`` words over it also starts anywhere else
    in the input, the same document included; all windows are judged on the input.
    ``removed`` lists the maximal removed word intervals as [start, end) pairs.
    Null and empty texts have no words, kept_text ''; texts shorter than the window
    lose nothing; repeated rows count as separate documents, though a task holds each
    row once; extra columns are not read.
    ``chunk_chars`` and ``bucket_windows`` bound what one task holds; their counts
    follow the input, so nothing is capped.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    chunks = max(1, -(-chars // chunk_chars))
    buckets = max(1, -(-chars // (6 * bucket_windows)))
    kind = docs.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by(["id", "text"]).aggregate([([], "count_all")])
            yield from once.rename_columns({"count_all": "times"}).select(["id", "text", "times"]).to_batches()

    # dealt by chunk alone, which both the sum and the groups below accept: one shuffle of the texts
    dealt = docs.mapInArrow(counted, f"id {kind}, text string, times long").withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    dealt = dealt.repartition("chunk").groupBy("chunk", "id", "text").agg(F.sum("times").alias("times"))

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("id", "ascending"), ("text", "ascending")])

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        table = ordered(table)
        h1, h2, at, rows = _windows(*text_buffer(table["text"]), window)
        order, first, number = _distinct(h1, h2)
        twice = np.bincount(number, minlength=int(first.sum())) > 1
        repeated = np.repeat(table["times"].to_numpy() > 1, np.diff(rows))[at]
        twice[number[repeated[order]]] = True
        a, b = h1[order][first], h2[order][first]
        edges = _bounds(a, buckets)
        sent = [(i, a[p:q].tobytes(), b[p:q].tobytes(), np.packbits(twice[p:q]).tobytes())
                for i, (p, q) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if q > p]
        return pa.table({"bucket": pa.array([r[0] for r in sent], pa.int64()),
                         "chunk": pa.array([chunk] * len(sent), pa.int64()),
                         "h1": pa.array([r[1] for r in sent], pa.binary()),
                         "h2": pa.array([r[2] for r in sent], pa.binary()),
                         "twice": pa.array([r[3] for r in sent], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in table["h1"]]
        h1 = np.concatenate(lists)
        h2 = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table["h2"]])
        repeated = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:len(y)]
                                   for x, y in zip(table["twice"], lists, strict=True)]).astype(bool)
        order, first, number = _distinct(h1, h2)
        n = np.bincount(number)
        repeated[order] |= n[number] > 1
        ends = np.cumsum([len(x) for x in lists])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, ends)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, answers = ordered(table), answers.sort_by("bucket")
        buf, offs = text_buffer(table["text"])
        h1, h2, at, rows = _windows(buf, offs, window)
        order, first, number = _distinct(h1, h2)
        edges = _bounds(h1[order][first], buckets)
        marked = np.zeros(int(first.sum()), bool)
        for i, bits in zip(answers["bucket"].to_pylist(), answers["bits"], strict=True):
            p, q = edges[i], edges[i + 1]
            marked[p:q] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8))[:q - p]
        starts = at[order[marked[number]]] if len(number) else at
        change = np.zeros(rows[-1] + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        data, kept, spans = buf.tobytes(), [], []
        for r in range(len(table)):
            words = data[offs[r]:offs[r + 1]].split()
            p, q = rows[r], rows[r + 1]
            lost = gone[p:q]
            if lost.any():
                words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                flips = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                spans.append(flips.reshape(-1, 2).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        n = np.diff(rows)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[rows])
        return pa.table({"id": table["id"], "n_words": pa.array(n.astype(np.int64)),
                         "n_removed": pa.array(removed.astype(np.int64)),
                         "removed": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                         "kept_text": pa.array(kept, pa.string()), "times": table["times"]})

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, h1 binary, h2 binary, twice binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, bits binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        cut, f"id {kind}, n_words long, n_removed long, removed array<array<int>>, kept_text string, times long")
    # each row as often as it was there, in blocks so that no array grows with the number
    last = F.col("times") - 1
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(_BLOCK).cast("long"))))
    out = out.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + (_BLOCK - 1), last))))
    return out.drop("times", "block", "copy").withColumnRenamed("id", id_col)


def brute_force(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) per text, straight from the definition."""
    words = [[] if t is None else t.encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
