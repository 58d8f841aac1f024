"""N-gram Jaccard join: count-vector R-trees over word-shingle sets.

Shingles of a document are hashed into ``groups`` groups; the counts are a point. The
overlap of two sets is at most the sum of their coordinate minima, and that of a set
and an R-tree node at most the sum of minima with the node's upper corner, so a
search descends only where the bound can reach the overlap that the threshold asks
for. Pairs that survive are verified on the exact sets.

An R-tree over the whole corpus cannot be dealt to tasks: unrelated documents of one
length have nearly the same low-dimensional point, so every shard would have to be
searched for every document. The corpus is therefore first cut into parts that no
link crosses: each distinct set gets ``tables`` keys of ``rows`` min-hashes, sets that
share a key are joined transitively, and the R-trees work inside these parts. Two sets
of similarity s share no key with probability (1 - s**rows)**tables: 5e-14 at s = 0.75
with the defaults (56 keys of 3), less above.

Equal sets are one class first (any number of copies is one entry). Inside a task a
found link merges its ends, and pairs whose ends are already merged are not verified
again, so a group of near copies costs about one verification per member. A part
beyond ``tile_shingles`` is cut into tiles and searched in three rounds: every tile by
itself; the smallest member of each group found, against each other; and then only the
members outside the part's largest group against the tiles they are not in. Two
members of the largest group need no test, as they are joined already, so a part that
is one large group of near copies is read about twice, not once per pair of tiles, and
every pair that could still join two groups is tested. No task grows with a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import mix, row_slices, text_buffer, window_hashes, word_hashes
from .storage import stored

_BASE = 0x5851F42D4C957F2D
LEAF = 16


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's k-word shingles; a shorter row is one shingle of its own length."""
    out = []
    for a, b in row_slices(offs):
        words, rows = word_hashes(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], fold=True)
        grams = window_hashes(words, k, _BASE)
        for p, q in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if q - p >= k:
                out.append(np.unique(grams[p:q - k + 1]))
            elif q > p:
                out.append(mix(window_hashes(words[p:q], q - p, _BASE) + np.uint64(q - p)))
            else:
                out.append(grams[:0])
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_digests(texts: DataFrame, text_col: str = "text", words: int = 5) -> DataFrame:
    """``(text, n, digest)`` of each row: its text, and the size and digest of its set, as ``jaccard_components`` marks them."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(text_buffer(batch["text"])[1]):
                part = batch["text"].slice(a, b - a)
                sets = shingle_sets(*text_buffer(part), words)
                yield pa.RecordBatch.from_arrays([part, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())],
                                                 names=["text", "n", "digest"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(digested, "text string, n long, digest binary")


class CountVectorTree:
    """A bulk-loaded R-tree over count vectors, packed by set size and then by the widest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        wide = np.argsort(-points.var(axis=0), kind="stable")[:2] if n > LEAF else np.zeros(2, int)
        slab = np.empty(n, np.int64)
        slab[np.argsort(sizes, kind="stable")] = np.arange(n) // (LEAF * max(1, int((n / LEAF) ** 0.5)))
        self.order = np.lexsort((points[:, wide[1]], points[:, wide[0]], slab))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose bound reaches similarity num/den with a set of ``size``, and their bounds."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(corner, point).sum(axis=1)
            keep = (bound * (num + den) >= num * (size + low)) & (high * den >= num * size) & (low * num <= den * size)
            at, bound = at[keep], bound[keep]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at], bound


def _points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    shift = np.uint64(64 - groups.bit_length() + 1)
    return np.stack([np.bincount((s >> shift).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)


def search_links(sets: list[np.ndarray], sides: np.ndarray, merged: np.ndarray, num: int, den: int, groups: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) that connect whatever links connect, beyond what ``merged`` (a label for each) joins already.

    Side 0 asks side 1, or all ask each other if there is one side only.
    """
    points, sizes, merged = _points(sets, groups), np.array([len(s) for s in sets], np.int64), merged.copy()
    cross = sides.min() != sides.max()
    indexed = np.flatnonzero(sides == 1) if cross else np.arange(len(sets))
    tree = CountVectorTree(points[indexed], sizes[indexed])
    for i in np.flatnonzero(sides == 0) if cross else range(len(sets)):
        found, bound = tree.search(points[i], int(sizes[i]), num, den)
        found = indexed[found]
        other = merged[found] != merged[i]
        found = found[other][np.argsort(-bound[other], kind="stable")]
        while len(found):
            j, found = int(found[0]), found[1:]
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                yield int(i), j
                merged[merged == merged[j]] = merged[i]
                found = found[merged[found] != merged[i]]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       num: int = 75, den: int = 100, groups: int = 128, tables: int = 56, rows: int = 3,
                       tile_shingles: int = 1 << 18, marks: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``.

    Sets are distinct ``words``-word shingles of the text with A-Z lower-cased (fewer
    words: the whole sequence; none or null: empty). Two documents link when
    den * |A and B| >= num * |A or B|; component_id is the smallest id reachable.
    Empty sets link with nothing. Rows with a null id link like others, and others
    through them, but name no component: a group of such rows only gets null. For
    this, a set that no id names goes by its digest. Repeated rows are copies; rows
    that share an id but not a text are separate, except that classes whose smallest
    ids are equal count as one. Ties cannot occur: ids are compared only for the
    minimum. Extra columns are not read. With ``marks`` two more columns: ``digest``
    of the set, and ``leads``, true for one set of each group that no id names.
    """
    g = np.gcd(num, den)
    num, den = int(num // g), int(den // g)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rng = mix(np.arange(1, 2 * tables * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flips, factors = rng[::2], rng[1::2] | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few MB of text at a time: a batch of long documents stays small
            for a, b in row_slices(text_buffer(batch["text"])[1]):
                yield sketched(batch.slice(a, b - a))

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_buffer(batch["text"]), words)
        size = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        keys = np.zeros((len(full), tables), np.uint64)
        if full:
            flat = np.concatenate(full)
            at = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
            for t in range(tables):
                key = np.full(len(full), t + 1, np.uint64)
                for r in range(t * rows, (t + 1) * rows):
                    key = mix(key ^ np.minimum.reduceat((flat ^ flips[r]) * factors[r], at))
                keys[:, t] = key
        ends = np.cumsum(np.where(size > 0, tables, 0))
        return pa.RecordBatch.from_arrays([
            batch["id"], pa.array(size),
            pa.array([_digest(s) for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
        ], names=["id", "n", "digest", "keys"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # repeated rows of a batch as one, so that no id is hot in the join of the texts
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(["id", "text"]).aggregate([]).select(["id", "text"]).to_batches()

    sketches = stored(docs.mapInArrow(sketch, f"id {kind}, n long, digest binary, keys array<long>"), "sketches")
    classes = sketches.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes, "classes")
    nameless = not classes.where("rep IS NULL").isEmpty()
    if nameless:
        name = F.hex("rep") if kind == "binary" else F.col("rep").cast("string")
        node, node_kind = F.coalesce(F.concat(F.lit("i"), name), F.concat(F.lit("d"), F.hex("digest"))), "string"
    else:
        node, node_kind = F.col("rep"), kind
    keyed = classes.select(node.alias("rep"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    # stored, so that the join's sides are plain shuffles and Spark can split a hot key's rows
    shared = stored(shared.select("key", "low"), "shared-keys")
    edges = keyed.join(shared, "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    parts = connected_components(edges)

    members = parts.join(classes.groupBy(node.alias("node")).agg(F.sum("n").alias("n")), "node")
    none = F.lit(None)
    texts = docs.where("id IS NOT NULL").mapInArrow(once, f"id {kind}, text string")
    texts = texts.select(F.col("id").alias("rep"), none.cast("binary").alias("digest"), "text")
    if nameless:
        unnamed = set_digests(docs.where("id IS NULL"), words=words).groupBy("digest").agg(F.min("text").alias("text"))
        texts = texts.union(unnamed.select(none.cast(kind), "digest", "text"))
    found = _grouped(texts.select(node.alias("node"), "text"), stored(members, "members"), node_kind, words, num, den, groups, tile_shingles)
    classed = classes.select("digest", "rep", node.alias("own")).join(found, F.col("own") == F.col("node"), "left").select(
        "digest", "rep", "own", F.coalesce("component", "own").alias("component"))
    # stored, and so are the steps of the rounds below: a plan runs all its scans and shuffles at once, and each takes
    # some MB of the driver's heap for what it sends to the executors
    classed = stored(classed, "classed")
    if nameless:
        classed = classed.join(classed.groupBy("component").agg(F.min("rep").alias("name")), "component")
    else:
        classed = classed.withColumn("name", F.col("component"))
    leads = F.col("name").isNull() & (F.col("component") == F.col("own"))
    out = sketches.select("id", "n", "digest").join(classed.select("digest", "name", leads.alias("leads")), "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"),
        "digest", F.coalesce("leads", F.lit(False)).alias("leads"))
    return out if marks else out.drop("digest", "leads")


def _tiled(members: DataFrame, tile_shingles: int, salt: int) -> DataFrame:
    """Adds ``tiles``, the number of tiles of the member's part, and ``tile``, the member's own."""
    tiles = stored(members.groupBy("component").agg(F.ceil(F.sum("n") / tile_shingles).alias("tiles")), "tiles")
    return members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("tiles")))


def _grouped(docs: DataFrame, members: DataFrame, kind: str, words: int, num: int, den: int, groups: int, tile_shingles: int) -> DataFrame:
    """``(node, component)``: the linked groups of the members ``(node, component, n)`` of each part, in the rounds described above.

    ``docs`` has the texts as ``(node, text)``.
    """

    def link(table: pa.Table) -> pa.Table:
        """Rounds 1 and 2: each node and the smallest of its group here. Round 3: pairs of labels that a link joins."""
        table = table.sort_by([("component", "ascending"), ("node", "ascending")])
        part, node, side, label = (table[c].to_numpy() for c in ("component", "node", "side", "label"))
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        across = table["rounds"][0].as_py() == 3
        a, b = [], []
        for p, q in zip(cut[:-1], cut[1:], strict=True):
            if across and side[p:q].min() == side[p:q].max():
                continue
            sets = shingle_sets(*text_buffer(table["text"].slice(p, q - p)), words)
            merged = np.unique(label[p:q], return_inverse=True)[1]
            first = np.arange(q - p)
            for i, j in search_links(sets, side[p:q], merged, num, den, groups):
                if across:
                    a.append(label[p + i])
                    b.append(label[p + j])
                else:
                    low, high = sorted((first[i], first[j]))
                    first[first == high] = low
            if not across:
                a.extend(node[p:q])
                b.extend(node[p + first])
        return pa.table({"a": pa.array(a, table.schema.field("node").type), "b": pa.array(b, table.schema.field("node").type)})

    def search(rows: DataFrame, rounds: int) -> DataFrame:
        found = rows.select(*placed, "text").withColumn("rounds", F.lit(rounds)).groupBy("part", "x", "y").applyInArrow(link, f"a {kind}, b {kind}")
        return stored(found.distinct(), "linked")

    none = F.lit(0).cast("long")
    placed = ("node", "component", "part", "x", "y", "side", "label")
    whole = members.agg(F.sum("n").alias("n")).first().n or 0
    bins = max(1, -(-whole // tile_shingles))
    # a shuffle join at every size: the members grow with the input, so they are not for broadcasting;
    # a repeated row once, so that a tile holds what its part's sizes counted
    tagged = _tiled(members, tile_shingles, 0)
    held = stored(docs.join(tagged.hint("shuffle_merge"), "node").distinct(), "member-texts")
    small = F.col("tiles") == 1
    own = held.withColumns({"part": F.when(small, none).otherwise(F.xxhash64("component")), "y": none, "side": F.lit(0), "label": F.col("node"),
                            "x": F.when(small, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("tile"))})
    first = search(own, 1)
    large = held.where(~small)
    if large.isEmpty():
        return first.select(F.col("a").alias("node"), F.col("b").alias("component"))

    texts = large.select("node", "text")
    with_text = lambda rows: rows.join(texts, "node")
    now = large.select("node", "component", "n", "tiles", "tile").distinct().join(first.select(F.col("a").alias("node"), F.col("b").alias("label")), "node")
    now = stored(now, "labels")
    firsts = _tiled(now.where("node = label").select("node", "component", "n"), tile_shingles, 1)
    firsts = firsts.withColumns({"part": F.xxhash64("component"), "x": F.col("tile"), "y": none, "side": F.lit(0), "label": F.col("node")})
    second = search(with_text(firsts), 2)
    now = now.join(second.select(F.col("a").alias("label"), F.col("b").alias("joined")), "label").drop("label").withColumnRenamed("joined", "label")
    now = stored(now, "labels")

    weight = now.groupBy("component", "label").agg(F.sum("n").alias("w"))
    main = weight.groupBy("component").agg(F.max_by("label", F.struct("w", "label")).alias("main"))
    left = stored(now.join(main, "component").where("label <> main").drop("main"), "left")
    blocks = stored(left.groupBy("component").agg(F.ceil(F.sum("n") / tile_shingles).alias("blocks")), "blocks")
    upto = lambda n: F.sequence(none, F.col(n) - 1)
    asks = left.join(blocks, "component").withColumn("y", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")))
    asks = asks.withColumn("x", F.explode(F.filter(upto("tiles"), lambda x: x != F.col("tile")))).withColumn("side", F.lit(0))
    told = now.join(blocks, "component").withColumn("y", F.explode(upto("blocks"))).withColumns({"x": F.col("tile"), "side": F.lit(1)})
    cols = ("node", "component", F.xxhash64("component").alias("part"), "x", "y", "side", "label")
    third = connected_components(search(with_text(asks.select(*cols).union(told.select(*cols))), 3))
    joined = now.join(third.select(F.col("node").alias("label"), F.col("component").alias("low")), "label", "left")
    return first.join(large.select(F.col("node").alias("a")), "a", "left_anti").union(
        joined.select("node", F.coalesce("low", "label"))).toDF("node", "component")


def brute_force(rows: list[tuple[int, str | None]], words: int = 5, num: int = 75, den: int = 100) -> dict[int, tuple[int, int]]:
    """{id: (set size, component)} straight from the definition, all pairs."""
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(fold).split()
        sets[i] = {tuple(w[p:p + words]) for p in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and (both := len(sets[x] & sets[y])) and den * both >= num * len(sets[x] | sets[y]):
                low, high = sorted((label[x], label[y]))
                label = {i: low if v == high else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}
