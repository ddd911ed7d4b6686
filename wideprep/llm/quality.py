"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words (runs of letters and digits, and runs of other visible characters; case matters) are hashed into buckets.  Every bucket owns a sparse random
index vector; a word's context vector is the sum of the index vectors of its neighbours over the whole corpus, counted in Spark tasks and added
up by a grouped sum.  The vectors' number and length are fixed, whatever the corpus.  A document is the mean and spread of its words' vectors and how
alike neighbouring words are.  A network with one hidden layer, trained on the pooled vectors of a bounded sample of labelled documents, gives the logit;
its temperature is fitted on held-back rows, so that scores are probabilities.

Whole texts are read.  Null, empty and wordless texts are pooled to zeros and scored like any other.  Rows without a label are not learned
from; repeated rows and extra columns pass through, a column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.llm import learn
from wideprep.llm.arrow_text import WORD_BYTES, byte_classes, hash_words, slices, string_buffers

BUCKETS = 1 << 14
DIM = 32
NONZERO = 4
REACH = 2          # neighbours on each side that count as context
HIDDEN = 32
#: Labelled documents learned from, chosen by hash.
SAMPLE = 20_000
EPOCHS = 60
HELD_BACK = 5
PUNCTUATION = byte_classes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
N_FEATURES = 2 * DIM + 2 * REACH + 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and the number of words before each row."""
    raw, offsets = string_buffers(column)
    kind = WORD_BYTES[raw].astype(np.int8) + 2 * PUNCTUATION[raw].astype(np.int8)
    turn = np.ones(len(raw) + 1, bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn[offsets] = True
    edges = np.flatnonzero(turn)
    starts, ends = edges[:-1], edges[1:]
    visible = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[visible], ends[visible]
    hashes, _ = hash_words(raw, starts, ends)
    return (hashes % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(starts, offsets)


def index_vectors(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def count_contexts(ids: np.ndarray, before: np.ndarray, into: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of all neighbours within a document to the words' rows of ``into`` (flat)."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for gap in range(1, REACH + 1):
        same = owner[gap:] == owner[:-gap]
        left, right = ids[:-gap][same], ids[gap:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                into += np.bincount(word.astype(np.int64) * DIM + places[near, k], signs[near, k], len(into))


def context_vectors(docs: DataFrame, text: str = "text", seed: int = 1) -> np.ndarray:
    """Unit word vectors (bucket x DIM) from the contexts of all documents; buckets without context are zero."""
    names = [f"c{i}" for i in range(DIM)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(seed)
        total = np.zeros(BUCKETS * DIM)
        for batch in slices(batches, text):
            count_contexts(*tokens(batch.column(text)), total, places, signs)
        table = total.reshape(BUCKETS, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(table[used, i]) for i in range(DIM)]], names=["bucket", *names])

    sums = docs.select(text).mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((BUCKETS, DIM))
    if sums.num_rows:
        rows = np.stack([sums.column(c).to_numpy() for c in names], axis=1).astype(float)
        at = sums.column("bucket").to_numpy()
        unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        unit -= unit.mean(axis=0)           # what all words share says nothing
        out[at] = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pool(ids: np.ndarray, before: np.ndarray, vectors: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Per document: mean and deviation of its words' vectors, mean likeness and share of equals at each gap up to ``REACH``, log length."""
    n_docs = len(before) - 1
    n = np.diff(before)
    sums = np.zeros((n_docs, 2 * DIM + 2 * REACH))
    for lo in range(0, len(ids), chunk):
        hi = min(len(ids), lo + chunk)
        some = np.arange(np.searchsorted(before, lo, side="right") - 1, np.searchsorted(before, hi, side="left"))
        some = some[n[some] > 0]
        first = np.maximum(before[some], lo) - lo
        reach = ids[lo:min(len(ids), hi + REACH)]
        v = vectors[reach]
        x = v[:hi - lo]
        parts = [x, x * x]
        owner = np.searchsorted(before, np.arange(lo, lo + len(reach)), side="right")
        for gap in range(1, REACH + 1):
            near, equal = np.zeros((hi - lo, 1), np.float32), np.zeros((hi - lo, 1), np.float32)
            m = max(0, min(hi - lo, len(reach) - gap))
            inside = owner[gap:gap + m] == owner[:m]
            near[:m, 0] = np.einsum("ij,ij->i", v[:m], v[gap:gap + m]) * inside
            equal[:m, 0] = (reach[:m] == reach[gap:gap + m]) & inside
            parts += [near, equal]
        sums[some] += np.add.reduceat(np.concatenate(parts, axis=1), first, axis=0)
    mean = sums / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(mean[:, DIM:2 * DIM] - mean[:, :DIM] ** 2, 0))
    return np.concatenate([mean[:, :DIM], spread, mean[:, 2 * DIM:], np.log1p(n)[:, None]], axis=1).astype(np.float32)


class Network:
    """Standardised inputs, one hidden layer, one logit, a temperature."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.params = {"w1": rng.normal(0, N_FEATURES ** -0.5, (N_FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN),
                       "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(1)}
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return np.maximum(np.clip((x - self.mean) / self.std, -8, 8) @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return learn.sigmoid(self.logits(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1, batch: int = 64) -> "Network":
        if not len(y) or y.min() == y.max():
            self.params["b2"][:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            self.params["w2"][:] = 0
            return self
        rng = np.random.default_rng(seed)
        held = rng.permutation(len(y)) % HELD_BACK == 0
        own = np.flatnonzero(~held)
        self.mean, self.std = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
        z = np.clip((x - self.mean) / self.std, -8, 8)
        adam, p = learn.Adam(self.params, 3e-3, decay=1e-4), self.params
        for epoch in range(epochs):
            adam.rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for some in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
                h = np.maximum(z[some] @ p["w1"] + p["b1"], 0)
                err = (learn.sigmoid(h @ p["w2"] + p["b2"][0]) - y[some]) / len(some)
                back = np.outer(err, p["w2"]) * (h > 0)
                adam.step({"w1": z[some].T @ back, "b1": back.sum(axis=0), "w2": h.T @ err, "b2": np.array([err.sum()])})
        self.temperature = learn.temperature(self.logits(x[held]), y[held])
        return self


def _mapped(docs: DataFrame, text: str, keep: list[str], into: str, kind, arrow_kind, compute) -> DataFrame:
    keep = [c for c in keep if c != into]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = pa.array(compute(*tokens(batch.column(text))), arrow_kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], names=[*keep, into])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, label: str = "quality", sample: int = SAMPLE,
          **kwargs) -> tuple[np.ndarray, Network]:
    """Word vectors of the whole corpus, and the network fitted on about ``sample`` labelled documents outside the held-out fold."""
    vectors = context_vectors(docs)
    rows = labels.where((learn.fold(F.col("doc_id"), folds) != held_out) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    wanted = learn.sample(rows, "doc_id", sample)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    # rows that share an id give one example, so the driver gets ``sample`` rows at most about
    pooled = _mapped(chosen, "text", ["doc_id", "label"], "x", T.ArrayType(T.FloatType()), pa.list_(pa.float32()),
                     lambda ids, before: list(pool(ids, before, held.value))) \
        .groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = pooled.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)
    return vectors, Network().fit(x, pooled.column("label").to_numpy().astype(float), **kwargs)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and the calibrated probability of good quality."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, text, docs.columns if keep is None else keep, into, T.DoubleType(), pa.float64(),
                   lambda ids, before: held.value[1].score(pool(ids, before, held.value[0])))
