"""Ranked lexical search by bit-sliced Bloom signatures.

``build`` turns documents into an index.  A document's signatures are Bloom filters of its terms, one for each level of
``LEVELS``: the terms that it holds once at least, twice at least, four times at least.  Documents with similar numbers of terms form
a block, whose signatures are stored as bit slices: slice b is a bitmap of the documents that have bit b set.  The intersection
of a term's few slices is a bitmap of documents that overestimates where the term is.

``rank`` scores whole documents for each item of a stated query set.  One pass counts the document frequencies of the query
terms.  Over the index, the bitmaps of an item's terms, weighted and summed, bound the score of every document of a block from
above: a term of a level counts as often as that level allows, or as the document's commonest term.  The ``top`` documents with the
highest bounds of each item are scored exactly; the lowest of these scores is a bar that the item's true ``top`` reach.
All documents whose bound reaches the bar, equality included, are then scored exactly from their whole texts, so the result is
the same as scoring every document.  Nothing is capped: a low bar only means more exact scores.

Terms are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.  A term's weight is
``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and a document of n terms scores the sum over the item's terms, repeats included, of
``weight * (10**9 tf div (1000 tf + 12 m))`` with ``m = 75 + 25 n N div L``; N documents hold a term, L is the terms of all.

Null, empty and termless texts are never found, and items without a term find nothing.  Rows that share an ``item_id`` (null is an
id) are one item with the terms of all their distinct texts.  Repeated documents and rows that share a ``doc_id`` are found row by
row; equal scores go by ascending ``doc_id``, null first.  Other columns are not read.  Memory is bounded by the longest text and
by blocks of a few MB of text.  The query set is worked in blocks of ``QUERY_BYTES`` of text; only such a block, its
bars and the ids of its first documents are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.llm.arrow_text import LOWER, WORD_BYTES, hash_words, mix, runs, slices, string_buffers
from wideprep.session import checkpoint_dir

TOP = 20
#: Times ``top`` documents of the highest bounds that are scored first, for the bar.
FIRSTS = 4
LEVELS = (1, 2, 4)
#: Bits of a signature for each term of the block's fullest document, and bits set by a term: a filter errs on one term in 250 at most.
BITS, HASHES = 12, 6
LEAST_BITS = 64
#: Bits of a term's hash that signatures see; the others of 64 hold the document while terms are counted.
TERM_BITS = 42
#: Documents bounded at a time.
WIDTH = 1024
#: Text of the queries that are worked at once.
QUERY_BYTES = 1 << 20
#: Candidate pairs of document and item up to which they are broadcast to the documents (some 20 MB); more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of the terms, and the terms before each row."""
    raw, offsets = string_buffers(column)
    data = LOWER[raw]
    starts, ends, before = runs(WORD_BYTES[raw], offsets)
    return data, starts, ends, hash_words(data, starts, ends)[0], before


def bit_places(term: np.ndarray, width: int) -> np.ndarray:
    """The ``HASHES`` bits of each term in a signature of ``width`` bits."""
    h = mix(term)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(width) for i in range(HASHES)], axis=1).astype(np.int64)


def signatures(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[bytes]]]:
    """Blocks of the rows with terms: their places, numbers of terms, largest term frequencies, and per level width and slices."""
    _, _, _, hashes, before = words_of(column)
    counts = np.diff(before)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return
    owner = np.repeat(np.arange(len(rows), dtype=np.uint64), counts[rows])
    keys = np.sort((owner << np.uint64(TERM_BITS)) | (hashes >> np.uint64(64 - TERM_BITS)))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    tf = np.diff(np.r_[first, len(keys)])
    doc = (keys[first] >> np.uint64(TERM_BITS)).astype(np.int64)
    term = keys[first] & np.uint64((1 << TERM_BITS) - 1)
    distinct = np.bincount(doc, minlength=len(rows))
    most = np.maximum.reduceat(tf, np.r_[0, np.cumsum(distinct)[:-1]])
    kind = np.ceil(2 * np.log2(distinct)).astype(int)            # the fullest document of a block holds at most 1.4 times the terms of any
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        place = np.full(len(rows), -1)
        place[own] = np.arange(len(own))
        inside = place[doc] >= 0
        widths, cut = [], []
        for level in LEVELS:
            some = np.flatnonzero(inside & (tf >= level))
            at = place[doc[some]]
            width = max(LEAST_BITS, BITS * int(np.bincount(at, minlength=1).max()))
            bits = np.zeros((width, len(own)), bool)
            for places in bit_places(term[some], width).T:
                bits[places, at] = True
            widths.append(width)
            cut.append(np.packbits(bits, axis=1).tobytes())
        yield rows[own], counts[rows[own]], most[own], widths, cut


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: a row for each block of documents with ``docs`` (ids), ``terms``, ``most``, ``width`` and ``slices``."""
    schema = T.StructType([
        T.StructField("docs", T.ArrayType(docs.schema[doc_id].dataType)), T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("most", T.ArrayType(T.LongType())), T.StructField("width", T.ArrayType(T.IntegerType())),
        T.StructField("slices", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            for rows, terms, most, widths, cut in signatures(batch.column("t")):
                ids = batch.column("id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids), pa.array([terms], pa.list_(pa.int64())),
                    pa.array([most], pa.list_(pa.int64())), pa.array([widths], pa.list_(pa.int32())), pa.array([cut], pa.list_(pa.binary()))],
                    names=schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


class Queries:
    """A block of items: their distinct terms, and for each item its terms with repeats (``terms`` from ``edges[i]`` on)."""

    def __init__(self, texts: list[str]):
        data, starts, ends, hashes, before = words_of(pa.array(texts, pa.string()))
        words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
        names: dict[bytes, int] = {}
        self.terms = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        self.edges = np.asarray(before, np.int64)
        self.n_terms = len(names)
        one = np.zeros(self.n_terms, np.int64)
        one[self.terms] = np.arange(len(words))                      # a word of each term
        self.hashes = hashes[one] if len(words) else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hashes, kind="stable")
        self.known = self.hashes[self.order]
        self.size = (ends - starts)[one] if len(words) else np.zeros(0, np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are query terms, byte for byte, and their terms."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        lo = np.searchsorted(self.known, hashes[at])
        same = lo < len(self.known)
        same[same] = self.known[lo[same]] == hashes[at[same]]
        at, term = at[same], self.order[lo[same]]
        good = (ends - starts)[at] == self.size[term]
        at, term = at[good], term[good]
        good = np.ones(len(at), bool)
        for n in np.unique(self.size[term]).tolist():
            some = np.flatnonzero(self.size[term] == n)
            for lo in range(0, len(some), max(1, (1 << 22) // n)):
                part = some[lo:lo + max(1, (1 << 22) // n)]
                here = data[starts[at[part]][:, None] + np.arange(n)]
                good[part] = (here == self.bytes[self.begin[term[part]][:, None] + np.arange(n)]).all(axis=1)
        return at[good], term[good]

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row; and row, query term and frequency of each query term in a row, by row."""
        data, starts, ends, hashes, before = words_of(column)
        at, term = self.find(data, starts, ends, hashes)
        row = np.searchsorted(before, at, side="right") - 1
        pairs, tf = np.unique(row * max(1, self.n_terms) + term, return_counts=True)
        return np.diff(before), pairs // max(1, self.n_terms), pairs % max(1, self.n_terms), tf


class Scoring:
    """Weights of the query terms and the measures of the corpus."""

    def __init__(self, n_docs: int, n_words: int, df: np.ndarray):
        self.n_docs, self.n_words = n_docs, max(1, n_words)
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def damp(self, terms: np.ndarray) -> np.ndarray:
        return 75 + 25 * terms.astype(np.int64) * self.n_docs // self.n_words

    @staticmethod
    def gain(tf: np.ndarray, damp: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * damp)


def frequencies(docs: DataFrame, queries: Queries, text: str = "text") -> Scoring:
    """One pass over the documents: each task sends its sums, a row for each query term at most."""
    held = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, n_docs, n_words = held.value, 0, 0
        df = np.zeros(q.n_terms, np.int64)
        for batch in slices(batches, "t"):
            n, _, term, _ = q.counts(batch.column("t"))
            n_docs, n_words = n_docs + int((n > 0).sum()), n_words + int(n.sum())
            df += np.bincount(term, minlength=q.n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, used], pa.int64()), pa.array(np.r_[n_docs, n_words, df[used]], pa.int64())], names=["k", "n"])

    sums = dict(docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    return Scoring(sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(queries.n_terms)], float))


def bounds(block: dict, queries: Queries, scoring: Scoring) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds (items x documents) of the scores of ``WIDTH`` documents of an index row from a place on."""
    n_items, terms = len(queries.edges) - 1, np.asarray(block["terms"], np.int64)
    most, damp = np.asarray(block["most"], np.int64), scoring.damp(terms)
    owner = np.repeat(np.arange(n_items), np.diff(queries.edges))
    weights = np.zeros((n_items, queries.n_terms))
    np.add.at(weights, (owner, queries.terms), scoring.weight[queries.terms])
    if weights.sum(axis=1).max(initial=0) < 1 << 24:
        weights = weights.astype(np.float32)             # whole numbers that 24 bits hold: the sums stay exact
    term = queries.hashes >> np.uint64(64 - TERM_BITS)
    held = []
    for width, raw in zip(block["width"], block["slices"]):
        cut = np.frombuffer(raw, np.uint8).reshape(width, -1)
        places = bit_places(term, width)
        inside = cut[places[:, 0]]
        for k in range(1, HASHES):
            inside &= cut[places[:, k]]
        some = np.flatnonzero(inside.any(axis=1))
        held.append((weights[:, some], inside[some]))
    for lo in range(0, len(terms), WIDTH):
        hi, below = min(len(terms), lo + WIDTH), 0
        total = np.zeros((n_items, hi - lo), np.int64)
        for k, (weight, inside) in enumerate(held):
            upto = most if k + 1 == len(LEVELS) else np.minimum(LEVELS[k + 1] - 1, most)
            gain = Scoring.gain(upto, damp)[lo:hi]
            bits = np.unpackbits(inside[:, lo // 8:-(-hi // 8)], axis=1, count=hi - lo)
            total += (weight @ bits.astype(weight.dtype)).astype(np.int64) * np.maximum(gain - below, 0)
            below = gain if k == 0 else np.maximum(gain, below)
        yield lo, total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("docs")
            yield ids.values[ids.offsets[i].as_py():ids.offsets[i + 1].as_py()], \
                {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("terms", "most", "width")} \
                | {"slices": [x.as_py() for x in batch.column("slices")[i].values]}


def firsts(index: DataFrame, queries: Queries, scoring: Scoring, top: int) -> DataFrame:
    """``id`` and ``item`` of the ``top`` documents of each item by bound.  A task sends ``top`` rows an item at most."""
    kind = index.schema["docs"].dataType.elementType
    held = index.sparkSession.sparkContext.broadcast((queries, scoring))
    schema = T.StructType([T.StructField("id", kind), T.StructField("item", T.IntegerType()), T.StructField("bound", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, s = held.value
        n_items = len(q.edges) - 1
        best, who = np.zeros((n_items, 0), np.int64), np.zeros((n_items, 0), object)
        arrow = None
        for ids, block in _blocks(batches):
            arrow, names = ids.type, np.array([*ids.to_pylist(), None], object)[:-1]
            for lo, bound in bounds(block, q, s):
                bound = np.concatenate([best, bound], axis=1)
                own = np.broadcast_to(names[lo:lo + bound.shape[1] - best.shape[1]], (n_items, bound.shape[1] - best.shape[1]))
                whom = np.concatenate([who, own], axis=1)
                if bound.shape[1] > top:
                    pick = np.argpartition(-bound, top - 1, axis=1)[:, :top]
                    bound, whom = np.take_along_axis(bound, pick, 1), np.take_along_axis(whom, pick, 1)
                best, who = bound, whom
        if arrow is not None:
            item, at = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(who[item, at].tolist(), arrow), pa.array(item, pa.int32()), pa.array(best[item, at], pa.int64())], names=schema.names)

    by = Window.partitionBy("item").orderBy(F.desc("bound"), "id")
    return index.mapInArrow(run, schema).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= top).select("id", "item")


def candidates(index: DataFrame, queries: Queries, scoring: Scoring, bar: np.ndarray) -> DataFrame:
    """``id`` and ``item`` of all documents whose bound reaches the item's bar."""
    kind = index.schema["docs"].dataType.elementType
    held = index.sparkSession.sparkContext.broadcast((queries, scoring, bar))
    schema = T.StructType([T.StructField("id", kind), T.StructField("item", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, s, least = held.value
        for ids, block in _blocks(batches):
            for lo, bound in bounds(block, q, s):
                item, at = np.nonzero(bound >= least[:, None])
                if len(at):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + at)), pa.array(item, pa.int32())], names=schema.names)

    return index.mapInArrow(run, schema)


def exact(docs: DataFrame, pairs: DataFrame, queries: Queries, scoring: Scoring, least: np.ndarray, broadcast: bool) -> DataFrame:
    """``item``, ``id`` and ``score`` of the documents of ``pairs`` (``id``, ``items``) that score ``least`` at least."""
    kind = docs.schema["id"].dataType
    held = docs.sparkSession.sparkContext.broadcast((queries, scoring, least))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, s, bar = held.value
        for batch in slices(batches, "t"):
            n, row, term, tf = q.counts(batch.column("t"))
            part = s.weight[term] * Scoring.gain(tf, s.damp(n)[row])
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            gains = np.zeros(q.n_terms, np.int64)
            wanted = batch.column("items")
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for r in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[r], edge[r + 1])
                gains[term[own]] = part[own]
                items = wanted[r].values.to_numpy()
                sizes = q.edges[items + 1] - q.edges[items]
                ends = np.cumsum(sizes)
                flat = np.arange(ends[-1]) + np.repeat(q.edges[items] - (ends - sizes), sizes)
                score = np.add.reduceat(gains[q.terms[flat]], ends - sizes)
                gains[term[own]] = 0
                good = score >= bar[items]
                found.append((r, items[good], score[good]))
            if found:
                rows = np.repeat([r for r, _, _ in found], [len(x) for _, x, _ in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x for _, x, _ in found]), pa.int32()), batch.column("id").take(pa.array(rows, pa.int64())),
                    pa.array(np.concatenate([x for _, _, x in found]), pa.int64())], names=schema.names)

    side = pairs.select(F.col("id").alias("of"), "items")
    met = docs.join(F.broadcast(side) if broadcast else side, F.col("id").eqNullSafe(F.col("of"))).select("id", "t", "items")
    return met.mapInArrow(run, schema)


def grouped(pairs: DataFrame) -> DataFrame:
    """A row per document with its items; rows that share an id share a row."""
    return pairs.distinct().groupBy("id").agg(F.collect_list("item").alias("items"))


def _rank(docs: DataFrame, index: DataFrame, texts: list[str], top: int) -> DataFrame:
    """``item`` (place in ``texts``), ``rank``, ``id`` and ``score`` for one block of items that have terms."""
    queries = Queries(texts)
    scoring = frequencies(docs, queries, "t")
    one = np.ones(len(texts), np.int64)
    first = grouped(firsts(index, queries, scoring, FIRSTS * top))           # so many an item at most: bounded by the block
    by = Window.partitionBy("item").orderBy(F.desc("score"))
    bars = exact(docs, first, queries, scoring, one, True).withColumn("nth", F.row_number().over(by)).where(F.col("nth") == top)
    least = one.copy()
    for r in bars.select("item", "score").collect():
        least[r["item"]] = r["score"]
    pairs = grouped(candidates(index, queries, scoring, least)).checkpoint()
    n_pairs = pairs.agg(F.sum(F.size("items"))).first()[0] or 0
    scored = exact(docs, pairs, queries, scoring, least, n_pairs <= BROADCAST_PAIRS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
         top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``top`` documents of each item with a score above 0.  ``index`` is
    a kept ``build(docs)``; without one it is built and written to the checkpoint folder."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    index = build(rows, "id", "t").checkpoint() if index is None else index
    held = items.select(F.col(f"`{item_id}`").alias("key"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t")).distinct() \
        .groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("t")), " ").alias("t")) \
        .where(F.col("t").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    n_bytes = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts, out = max(1, -(-2 * n_bytes // QUERY_BYTES)) if n_bytes > QUERY_BYTES else 1, None
    key = items.schema[item_id].dataType
    for k in range(parts):
        block = held.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).collect()
        if not block:
            continue
        names = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", key)]))
        found = _rank(rows, index, [r["t"] for r in block], top).join(F.broadcast(names), "item") \
            .select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        found = found.checkpoint() if parts > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType([T.StructField("item_id", key), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType),
                               T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return out
