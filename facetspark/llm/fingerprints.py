"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (stretches of words ended by a line break or by a word chosen by
its hash, so that long lines are cut where their content says) are digested to 64
bits; the j-th repeat of a digest counts as a digest of its own. The sketch adds each
digest to one cell in each of three parts: a count, a sum of digests and a sum of
their checks. Subtracting two sketches leaves the differing digests only, and peeling
cells that hold a single one recovers them. If cells are left over, the pair is tried
again with sketches four times as large, until everything is recovered; likeness is
then the exact Jaccard similarity of the two digest sets.

All pairs of a batch are subtracted and peeled together in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, row_slices, text_buffer, word_hashes, word_spans

PARTS, CELLS, GROW = 3, 24, 4
_CUT = np.uint64(8)  # a line is cut after one word in eight, by hash
_BASE = np.uint64(0x5851F42D4C957F2D)
_SEEDS = mix(np.arange(1, PARTS + 1, dtype=np.uint64))
_CHECK, _REPEAT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_AT_ONCE = 1 << 20  # cells handled together
_ALL, _STORED = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFF)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts, and the n + 1 offsets of the texts among them."""
    buf, offs = text_buffer(pa.array(texts, pa.large_string()))
    keys, owner = [], []
    for a, b in row_slices(offs):
        part, o = buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        words, rows = word_hashes(part, o)
        if not len(words):
            continue
        start, _, _ = word_spans(part, o)
        breaks = np.cumsum(part == 10)
        first = np.zeros(len(words), bool)
        first[rows[:-1][rows[:-1] < len(words)]] = True
        first[1:] |= (breaks[start[1:]] != breaks[start[:-1]]) | (words[:-1] % _CUT == 0)
        at = np.flatnonzero(first)
        place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), _BASE)]))
        keys.append(mix(np.add.reduceat(words * power[place], at)))
        owner.append(np.searchsorted(rows, at, "right") - 1 + a)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    k, o = key[order], own[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    repeat = (np.arange(len(k)) - np.repeat(at, np.diff(np.append(at, len(k))))).astype(np.uint64)
    return mix(k + repeat * _REPEAT), np.searchsorted(o, np.arange(len(texts) + 1))


def _cells_of(keys: np.ndarray, size: int) -> np.ndarray:
    each = np.uint64(size // PARTS)
    return np.stack([(mix(keys ^ s) % each).astype(np.int64) + i * (size // PARTS) for i, s in enumerate(_SEEDS)])


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums: n sketches of ``size`` cells, flat."""
    count, total, check = np.zeros(n * size, np.int64), np.zeros(n * size, np.uint64), np.zeros(n * size, np.uint64)
    at = (_cells_of(keys, size) + owner * size).ravel()
    np.add.at(count, at, 1)
    np.add.at(total, at, np.tile(keys, PARTS))
    np.add.at(check, at, np.tile(mix(keys ^ _CHECK), PARTS))
    return count, total, check


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, n: int, size: int, mask: np.uint64 = _ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Empty subtracted sketches in place: the recovered digests, their signs and owners, and which sketches came out empty.

    ``mask`` says which bits of the check sums there are.
    """
    keys, signs, owners = [], [], []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        sign = count[look]
        key = total[look] * sign.astype(np.uint64)
        pure = (mix(key ^ _CHECK) * sign.astype(np.uint64) ^ check[look]) & mask == 0
        key, sign, own = key[pure], sign[pure], look[pure] // size
        if not len(key):
            break
        order = np.lexsort((key, own))
        key, sign, own = key[order], sign[order], own[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        key, sign, own = key[new], sign[new], own[new]
        at = (_cells_of(key, size) + own * size).ravel()
        s = sign.astype(np.uint64)
        np.subtract.at(count, at, np.tile(sign, PARTS))
        np.subtract.at(total, at, np.tile(key * s, PARTS))
        np.subtract.at(check, at, np.tile(mix(key ^ _CHECK) * s, PARTS))
        keys.append(key)
        signs.append(sign)
        owners.append(own)
        at = np.unique(at)
        look = at[np.abs(count[at]) == 1]
    empty = ((count == 0) & (total == 0) & (check & mask == 0)).reshape(n, size).all(axis=1)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(keys, np.uint64), join(signs, np.int64), join(owners, np.int64), empty


def _take(keys: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = offs[rows + 1] - offs[rows]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    at = np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(offs[rows], length)
    return keys[at], np.repeat(np.arange(len(rows)), length)


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the digests only in a and only in b, recovered from subtracted sketches."""
    n = len(a[1]) - 1
    out: list = [None] * n
    left, size = np.arange(n), cells
    while len(left):
        again = []
        step = max(1, _AT_ONCE // size)
        for i in range(0, len(left), step):
            rows = left[i:i + step]
            x, y = (sketch(*_take(*side, rows), len(rows), size) for side in (a, b))
            keys, signs, owners, empty = peel(x[0] - y[0], x[1] - y[1], x[2] - y[2], len(rows), size)
            order = np.lexsort((signs, owners))
            keys, signs, owners = keys[order], signs[order], owners[order]
            edge = np.searchsorted(owners, np.arange(len(rows) + 1))
            for j in np.flatnonzero(empty).tolist():
                k, s = keys[edge[j]:edge[j + 1]], signs[edge[j]:edge[j + 1]]
                cut = int(np.searchsorted(s, 0))
                out[rows[j]] = (k[cut:], k[:cut])
            again.append(rows[~empty])
        left, size = np.concatenate(again), size * GROW
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity of the digest sets; two empty sets are alike."""
    both = np.diff(a[1]) + np.diff(b[1])
    apart = np.array([len(x) + len(y) for x, y in differences(a, b)], np.int64)
    return np.where(both == 0, 1.0, (both - apart) / np.maximum(1, both + apart))


def fingerprint(digests: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketch of each row as text: counts (16 bits), digest sums (64) and check sums (32) in base64."""
    n = len(digests[1]) - 1
    count, total, check = sketch(*_take(*digests, np.arange(n)), n, cells)
    packed = np.concatenate([count.astype("<i2").view(np.uint8).reshape(n, -1), total.astype("<u8").view(np.uint8).reshape(n, -1),
                             check.astype("<u4").view(np.uint8).reshape(n, -1)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in packed]


def decoded(texts: list[str | None], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums of stored fingerprints, flat, and which of them are fingerprints of that size."""
    raw = np.zeros((len(texts), cells * 14), np.uint8)
    good = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        try:
            data = base64.b64decode(t or "", validate=True)
        except ValueError:
            continue
        if len(data) == cells * 14:
            raw[i], good[i] = np.frombuffer(data, np.uint8), True
    cut = lambda a, b, kind: np.ascontiguousarray(raw[:, a * cells:b * cells]).view(kind).ravel()
    return cut(0, 2, "<i2").astype(np.int64), cut(2, 10, "<u8").astype(np.uint64), cut(10, 14, "<u4").astype(np.uint64), good


def stored_differences(a: list[str | None], b: list[str | None], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each pair of stored fingerprints the digests only in a and only in b; None where they do not peel, or are none."""
    x, y = decoded(a, cells), decoded(b, cells)
    count = (x[0] - y[0]).astype(np.int16).astype(np.int64)  # counts wrap at 16 bits
    keys, signs, owners, empty = peel(count, x[1] - y[1], x[2] - y[2], len(a), cells, _STORED)
    out: list = []
    order = np.argsort(owners, kind="stable")
    edge = np.searchsorted(owners[order], np.arange(len(a) + 1))
    for i in range(len(a)):
        if not (empty[i] and x[3][i] and y[3][i]):
            out.append(None)
            continue
        at = order[edge[i]:edge[i + 1]]
        out.append((np.sort(keys[at][signs[at] > 0]), np.sort(keys[at][signs[at] < 0])))
    return out


_DIFFERENCE = "peeled boolean, only_a array<long>, only_b array<long>"


def _difference_rows(found: list) -> pa.Array:
    lists = [pa.array([None if f is None else f[k].view(np.int64).tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1)]
    return pa.StructArray.from_arrays([pa.array([f is not None for f in found], pa.bool_()), *lists], names=["peeled", "only_a", "only_b"])


def fingerprint_difference(a: Column, b: Column, cells: int = CELLS) -> Column:
    """Struct ``peeled, only_a, only_b`` of two stored fingerprints: the paragraph digests that one version has and the other has not.

    ``peeled`` is false, with null lists, where more differ than the sketches can tell (surely beyond
    their number of cells, seldom below half of it), and where either is null or no fingerprint:
    :func:`version_difference` of the texts recovers those. Digests are signed 64-bit integers, ascending as unsigned.
    """
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield _difference_rows(stored_differences(x.to_pylist(), y.to_pylist(), cells))

    return F.arrow_udf(find, _DIFFERENCE)(a, b)


def version_difference(a: Column, b: Column, cells: int = CELLS) -> Column:
    """The same from two versions' texts (null: empty), with sketches ``GROW`` times larger until the pair peels: always whole."""
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            own, other = (paragraph_digests([t or "" for t in s.to_pylist()]) for s in (x, y))
            yield _difference_rows([(np.sort(p), np.sort(q)) for p, q in differences(own, other, cells)])

    return F.arrow_udf(find, _DIFFERENCE)(a, b)


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def _fingerprinted(ids: list, texts: list[str], after: list[str]) -> tuple[list, ...]:
    changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
    own, other, following = paragraph_digests(texts), paragraph_digests(changed), paragraph_digests(after)
    return (ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            fingerprint(own), fingerprint(other), likeness(own, other).tolist(), likeness(own, following).tolist())


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 16 << 20, max_parts: int = 1 << 14) -> DataFrame:
    """One row per input row: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one after in descending id; after the last comes the
    first. Null ids come last; rows with one id follow each other by text hash.
    A null text is empty; two texts without words have likeness 1. A single row is
    followed by itself. Extra columns are not read.

    Rows are range-dealt by id at bounds from a sample of ids (which affects only how
    even the parts are) and sorted inside a part; the first row of each part also
    goes to the part before it, so neighbours meet with one shuffle of the texts.
    Parts are streamed: memory follows the Arrow batch, not the part.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    seen = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("chars")).first()
    parts = min(max_parts, max(1, -(-(seen.chars or 0) // part_chars)))
    every = max(1, seen.n // (parts * 64))
    sample = docs.select("id").where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0))
    sample = sorted(r[0] for r in sample.distinct().collect()) if parts > 1 else []
    # ascending bounds; part numbers run against the ids, so they follow the order asked for
    bounds = pa.array(sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if len(sample) > parts else [], pa.from_numpy_dtype(np.int64) if kind in ("bigint", "int") else None)
    high = len(bounds)
    sorted_bounds = bounds.to_numpy(zero_copy_only=False) if high else np.zeros(0)

    def number(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in ids:
            there = np.asarray(x.is_valid())
            part = np.full(len(x), high + 1, np.int64)
            if there.any():
                part[there] = high - np.searchsorted(sorted_bounds, x.drop_null().to_numpy(zero_copy_only=False), "right") if high else 0
            yield pa.array(part)

    part_of = F.arrow_udf(number, "long")
    heads = docs.select("id").withColumn("part", part_of("id")).groupBy("part").agg(F.max("id").alias("head")).orderBy("part").collect()
    order = [r.part for r in heads]
    place = {p: i for i, p in enumerate(order)}
    head_ids = pa.array([r.head for r in heads], pa.large_string() if kind == "string" else None)

    def send(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # a part's own rows, and where its first row goes besides: to the part before, the very first to the last
        for x in ids:
            part = next(number(iter([x])))
            at = np.array([place[p] for p in part.to_pylist()], np.int64)
            first = pc.fill_null(pc.equal(x, head_ids.take(pa.array(at)).cast(x.type)), False)
            first = pc.or_(first, pc.is_null(x))
            to = pa.array(np.array([*order, *order[:1]], np.int64)).take(pa.array((at - 1) % len(order)))
            yield pa.StructArray.from_arrays([part, pc.if_else(first, to, pa.scalar(None, pa.int64()))], names=["part", "besides"])

    own = F.struct(F.col("place.part").alias("part"), F.lit(0).alias("copy"))
    besides = F.struct(F.col("place.besides").alias("part"), F.lit(1).alias("copy"))
    placed = docs.withColumn("place", F.arrow_udf(send, "struct<part:long,besides:long>")("id"))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("place.besides").isNotNull(), F.array(own, besides)).otherwise(F.array(own))))
    dealt = dealt.select("to.part", "to.copy", "id", "text").repartition("part").sortWithinPartitions(
        "part", "copy", F.col("id").desc_nulls_last(), F.xxhash64("text"))

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, pa.Array | None] = ([], [], [], None)
        for batch in batches:
            ids = batch["id"] if held[3] is None else pa.concat_arrays([held[3], batch["id"]])
            part, copy = held[0] + batch["part"].to_pylist(), held[1] + batch["copy"].to_pylist()
            text = held[2] + batch["text"].to_pylist()
            size = np.concatenate([[0], np.cumsum([len(t) for t in text])])
            own = [i for i in range(len(text) - 1) if not copy[i] and part[i] == part[i + 1]]
            for a, b in row_slices(size[np.append(own, own[-1] + 1)] if own else np.zeros(1, np.int64)):
                at = own[a:b]
                cols = _fingerprinted(at, [text[i] for i in at], [text[i + 1] for i in at])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:], strict=True))], names=names)
            held = (part[-1:], copy[-1:], text[-1:], ids.slice(len(ids) - 1)) if len(ids) else held

    return dealt.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
