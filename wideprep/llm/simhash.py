"""SimHash near-duplicates: fingerprints, exact tiled comparison, connected classes.

``fingerprints`` gives each text 64 majority bits over its word-shingle hashes.
``links`` compares all distinct fingerprints with all, exactly, tile by tile: fingerprints are put in order of the
population counts of their ``PARTS`` equal parts and cut into tiles, none across a change of these counts.  Two
fingerprints differ in at least as many bits as the counts of their parts differ in all, so a pair of tiles whose counts
differ by more than the radius is skipped; every other pair is compared in full by numpy exclusive-or and bit counts.
Which cells of counts are near each other is found on a table of one row per cell, by equality with the neighbouring counts.
A tile pair emits a spanning forest of its links (fewer than its fingerprints), never all pairs.
``near_duplicates`` joins the classes back to the rows.

Equal fingerprints meet in one row before any comparison, so a group of copies of any size costs
one fingerprint.  Null text has no words and fingerprint 0, as has an empty text.  A null ``doc_id``
belongs to its fingerprint's class but never names it; a class of null ids only has a null id.
Repeated rows and extra columns pass through; a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideprep.llm.arrow_text import slices
from wideprep.llm.components import connected_components
from wideprep.session import checkpoint_dir, shuffle_partitions

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints a tile holds at most: 8 KB, and 1 million comparisons a tile pair.
TILE = 1024
#: Equal parts of a fingerprint whose population counts order the tiles, and the bits that hold one count in a cell's number.
PARTS = 4
PART_BITS = 7


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``words`` words (fewer words: of the whole sequence; none: no hash).

    ``bytes.lower`` and ``bytes.split`` change and split ASCII only: A-Z, and the blanks
    0x20 and 0x09-0x0D.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    begins = [0, *[e + 1 for e in ends[:len(parts) - words]]]
    return [digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1:])]


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of hashes ``offsets[i]:offsets[i + 1]``: the bits set in over half of them."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    # Four 16-bit counters a word: pieces of at most 2**15 hashes cannot overflow them.
    piece = 1 << 15
    begins = [np.arange(offsets[r], offsets[r + 1], piece) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(b) for b in begins])
    begins = np.concatenate(begins)
    first = np.searchsorted(owner, np.arange(len(rows)))
    lanes = np.uint64(0x0001000100010001)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, begins)
        for lane in range(4):
            counts = np.add.reduceat((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), first)
            set_ = 2 * counts > n[rows].astype(np.uint64)
            out[rows[set_]] |= np.uint64(1) << np.uint64(bit + 16 * lane)
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS,
                 seed: int = SEED, name: str = "fp") -> DataFrame:
    """The rows of ``docs`` without their text, plus the fingerprint as a long."""
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [shingle_hashes(t, words, seed) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int64)
            flat = np.fromiter((x for h in found for x in h), np.uint64, int(offsets[-1]))
            bits = majority_bits(flat, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(bits)], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def _views(blocks: int, radius: int) -> list[int]:
    """The 64-bit masks of every choice of ``blocks - radius`` of the ``blocks`` bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``i`` with those of ``j`` (class label: its smallest index)."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, hi, lo)
        while (nxt := parent[parent]).tobytes() != parent.tobytes():
            parent = nxt
        labels = parent[labels]


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (u, v) of all fingerprints of tile ``a`` and tile ``b`` (None: within ``a``)
    that differ in at most ``radius`` bits."""
    both = a if b is None else np.concatenate([a, b])
    labels, shift = np.arange(len(both)), 0 if b is None else len(a)
    right = a if b is None else b
    rows = max(1, (1 << 18) // max(1, len(right)))
    for lo in range(0, len(a), rows):
        near = np.bitwise_count(a[lo:lo + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i += lo
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            labels = _merge(labels, i, j + shift)
    moved = np.flatnonzero(labels != np.arange(len(both)))
    return both[moved], both[labels[moved]]


_TILE_SCHEMA = "view int, block long, pop_min int, pop_max int, first long, fps binary, u long, v long"


def _tiles(radius: int, tile: int):
    """Cut each sorted run of one bucket into tiles.  A run's links inside a tile leave at once; the
    tile itself leaves only if its bucket has, or may have in another partition, more tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(view, block, fps, alone):
            u, v = compare_tiles(fps, None, radius) if len(fps) > 1 else (fps[:0], fps[:0])
            n = len(u)
            cols = {"view": [view] * n, "block": [block] * n, "pop_min": [None] * n, "pop_max": [None] * n,
                    "first": [None] * n, "fps": [None] * n, "u": u.view(np.int64).tolist(), "v": v.view(np.int64).tolist()}
            if not alone:
                pops = np.bitwise_count(fps)
                tail = [view, block, int(pops.min()), int(pops.max()), int(fps[:1].view(np.int64)[0]), fps.tobytes(), None, None]
                for c, x in zip(cols, tail):
                    cols[c].append(x)
            return cols

        types = dict(view=pa.int32(), block=pa.int64(), pop_min=pa.int32(), pop_max=pa.int32(), first=pa.int64(),
                     fps=pa.binary(), u=pa.int64(), v=pa.int64())
        out = {c: [] for c in types}

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))
            for c in out:
                out[c] = []
            return got

        def add(key, fps, alone):
            for c, x in made(*key, fps, alone).items():
                out[c].extend(x)

        key, held, held_n, seen, cut = None, [], 0, 0, False   # the open run, of which ``cut`` tells if tiles have left
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            view, block = batch.column("view").to_numpy(), batch.column("block").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            turn = np.flatnonzero((view[1:] != view[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), n]):
                here = (int(view[lo]), int(block[lo]))
                if here != key:
                    if key is not None and (held_n > 1 or cut or seen == 1):
                        add(key, np.concatenate(held), alone=seen > 1 and not cut)
                    key, held, held_n, seen, cut = here, [], 0, seen + 1, False
                while lo < hi:
                    if held_n == tile:
                        add(key, np.concatenate(held), alone=False)
                        held, held_n, cut = [], 0, True
                    take = min(hi - lo, tile - held_n)
                    held.append(fps[lo:lo + take])
                    held_n, lo = held_n + take, lo + take
            if len(out["u"]) > 20_000:
                yield flush()
        if key is not None:
            add(key, np.concatenate(held), alone=False)   # the last run may go on in the next partition
        yield flush()

    return run


def _pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column("fps").to_pylist(), batch.column("fps2").to_pylist()):
                u, v = compare_tiles(np.frombuffer(a, np.uint64), None if b is None else np.frombuffer(b, np.uint64), radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (us, vs)], names=["u", "v"])

    return run


def _indexed_links(distinct: DataFrame, radius: int, tile: int, blocks: int) -> DataFrame:
    """``links`` by an index: a pair within ``radius`` bits agrees in ``blocks - radius`` of the ``blocks`` bit blocks.
    ``radius + 1`` blocks give the fewest copies of each fingerprint; more blocks give longer keys."""
    spark = distinct.sparkSession
    masks = [_signed(m) for m in _views(blocks, radius)]
    views = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("view", "block")) \
        .withColumn("pop", F.bit_count("fp").cast("int"))
    keys = ["view", "block", "pop", "fp"]
    tiles = views.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys) \
        .mapInArrow(_tiles(radius, tile), _TILE_SCHEMA).checkpoint()
    inside = tiles.where("u is not null").select("u", "v")
    whole = tiles.where("fps is not null")
    meta = whole.select("view", "block", "pop_min", "pop_max", "first")
    right = meta.toDF("view", "block", "pop_min2", "pop_max2", "first2")
    pairs = meta.join(right, ["view", "block"]).where(
        ((F.col("pop_min") < F.col("pop_min2")) | ((F.col("pop_min") == F.col("pop_min2")) & (F.col("first") < F.col("first2"))))
        & (F.col("pop_min2") - F.col("pop_max") <= radius))
    load = whole.select("view", "block", "first", "fps")
    across = pairs.select("view", "block", "first", "first2").join(load, ["view", "block", "first"]) \
        .join(load.toDF("view", "block", "first2", "fps2"), ["view", "block", "first2"]) \
        .select("fps", "fps2").mapInArrow(_pairs(radius), "u long, v long")
    return inside.union(across).distinct()


def _cut(tile: int):
    """Runs of rows with one ``cell``, sorted by it, as tiles ``(cell, first, fps)`` of at most ``tile`` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fps = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            at = [(lo, min(lo + tile, hi)) for s, hi in zip(starts.tolist(), ends.tolist()) for lo in range(s, hi, tile)]
            first = [lo for lo, _ in at]
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(fps[first]), pa.array([fps[lo:hi].tobytes() for lo, hi in at], pa.binary())],
                                             names=["cell", "first", "fps"])

    return run


def _steps(radius: int, parts: int = PARTS) -> list[int]:
    """The differences, from 0 up, of two cells whose population counts differ by ``radius`` in all."""
    found = [(0, 0)]
    for k in range(parts):
        found = [(step + (d << PART_BITS * k), used + abs(d)) for step, used in found for d in range(used - radius, radius - used + 1)]
    return sorted(step for step, _ in found if step >= 0)


def cell_of(fp: Column, parts: int = PARTS) -> Column:
    """The population counts of the ``parts`` equal parts of ``fp``, as one long."""
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(_signed((1 << width) - 1)))).cast("long") for k in range(parts)]
    out = F.lit(0).cast("long")
    for k, n in enumerate(counts):
        out = out + F.shiftleft(n, PART_BITS * k)
    return out


def tile_pairs(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The tiles ``(cell, first, fps)`` of all fingerprints, and the pairs ``(first, fps, first2, fps2)`` that are not skipped, a tile
    with itself included.  A tile holds fingerprints of one cell, so a pair's counts differ by one number, known from the cells."""
    spark = distinct.sparkSession
    tiles = distinct.select(cell_of(F.col("fp")).alias("cell"), "fp").repartitionByRange(shuffle_partitions(spark), "cell", "fp") \
        .sortWithinPartitions("cell", "fp").mapInArrow(_cut(tile), "cell long, first long, fps binary").checkpoint()
    # Only (cell, first) is compared with the cells near by; the fingerprints follow for the pairs found.
    cells = tiles.groupBy("cell").agg(F.count("*").alias("n"))
    near = cells.select("cell", F.explode(F.transform(F.lit(_steps(radius)), lambda d: F.col("cell") + d)).alias("cell2")) \
        .join(cells.select(F.col("cell").alias("cell2")), "cell2")
    right = tiles.toDF("cell2", "first2", "fps2")
    pairs = tiles.join(near, "cell").join(right, "cell2").where((F.col("cell") < F.col("cell2")) | (F.col("first") <= F.col("first2")))
    return tiles, pairs.select("first", "fps", "first2", "fps2")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links ``(u, v)`` between the distinct longs ``fp`` of ``distinct``: a set whose connected
    classes are those of all pairs within ``radius`` bits.

    All tiles are compared with all tiles but the pairs skipped for their population counts.  ``blocks`` takes candidates from
    an index of that many bit blocks instead (see the module's text): the same classes, with work that stays near the number
    of fingerprints where tiles grow with its square.
    """
    checkpoint_dir(distinct.sparkSession)
    if blocks is not None:
        return _indexed_links(distinct, radius, tile, blocks)
    _, pairs = tile_pairs(distinct, radius, tile)
    return pairs.select("fps", F.when(F.col("first") != F.col("first2"), F.col("fps2")).alias("fps2")) \
        .mapInArrow(_pairs(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    seed: int = SEED, radius: int = RADIUS, fp: str = "fp", component: str = "component_id",
                    root: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with its fingerprint and the smallest ``doc_id`` of its class.

    ``root`` names a further column for the class itself (its smallest fingerprint, never null).
    """
    checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, text, words, seed, "__fp").checkpoint()
    classes = marked.groupBy("__fp").agg(F.min(F.col(f"`{doc_id}`")).alias("__rep"))
    distinct = classes.select(F.col("__fp").alias("fp"))
    found = connected_components(links(distinct, radius).toDF("u", "v"))
    rooted = classes.join(found.toDF("__fp", "__root"), "__fp", "left") \
        .withColumn("__root", F.coalesce("__root", "__fp"))
    least = rooted.groupBy("__root").agg(F.min("__rep").alias("__least"))
    names = rooted.join(least, "__root").select("__fp", "__root", "__least")
    out = marked.join(names, "__fp")
    extra = [F.col("__root").alias(root)] if root else []
    given = [F.col(f"`{c}`") for c in marked.columns if c not in ("__fp", fp, component, root)]
    return out.select(*given, F.col("__fp").alias(fp),
                      F.col("__least").alias(component), *extra)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """One row of each class with all its columns: the smallest ``doc_id`` (null last); rows that
    share it count as one, of which the one with the smallest text hash stays."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    found = near_duplicates(slim, "id", "text", root="root", **kwargs)
    key = lambda id_: [id_.isNull().alias("__none"), F.coalesce(id_.cast("string"), F.lit("")).alias("__id")]
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")) \
        .select(*key(F.col("best.id")), F.col("best.text_hash").alias("__h")).distinct()
    mine = docs.select("*", *key(F.col(f"`{doc_id}`")), F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return mine.join(best, ["__none", "__id", "__h"], "left_semi").groupBy("__none", "__id", "__h") \
        .agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")).select("row.*")
