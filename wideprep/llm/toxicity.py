"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are embedded as the sum of hashed vectors: of the whole word and of its first 4 to 7 bytes.  Filters of several widths
slide over the words; each filter's largest response in every block of ``BLOCK`` words is kept, and the document gets the
largest and the mean of its block maxima.  A linear layer gives the logit.  ``lang`` never enters a score: the language whose
threshold applies is guessed from the text by word frequencies that are learned with the classifier.  Scores are shifted so that
0.5 is the threshold of the guessed language.

Whole texts are read whatever their length; work memory is bounded by blocks of words.  Null, empty and wordless texts are clean:
their score is about 0.  Rows without a label are not learned from; repeated rows and extra columns pass
through, a column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.llm import learn
from wideprep.llm.arrow_text import LOWER, WORD_BYTES, hash_words, runs, slices, string_buffers

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
PREFIXES = (4, 5, 6, 7)
BLOCK = 32
#: Words convolved at a time.
CHUNK = 1 << 14
#: Labelled documents learned from, per label (of 1, and of 0), chosen by hash.
SAMPLE = (2500, 4500)
#: Passes over the sample; a small sample is read more often, up to about ``LEAST_SEEN`` documents in all.
EPOCHS = 5
LEAST_SEEN = 24_000
#: Sample documents that must hold a bucket before it gets a vector.
LEAST_DOCUMENTS = 4
#: Labelled documents of a guessed language from which it gets a threshold of its own.
LEAST_PER_LANGUAGE = 40
HELD_BACK = 5
NOTHING = -50.0
BLANK_WEIGHT = 0.1


def features(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its buckets (whole word, prefixes; 0: none) and the words before each row."""
    raw, offsets = string_buffers(column)
    starts, ends, before = runs(WORD_BYTES[raw], offsets)
    whole, parts = hash_words(LOWER[raw], starts, ends, PREFIXES)
    ids = np.zeros((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, h in enumerate([whole, *parts]):
        ids[:, k] = np.where(h == 0, 0, 1 + (h % np.uint64(BUCKETS - 1)).astype(np.int32))
    return ids, before


def places():
    """Index, width and first column in ``conv`` of every filter width."""
    return [(k, w, sum(WIDTHS[:k]) * FILTERS) for k, w in enumerate(WIDTHS)]


class Model:
    """``table`` holds the word vectors, ``conv`` one matrix per width and place, ``out`` the last layer."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.live = np.ones(BUCKETS, bool)                       # buckets with a vector; the others stay zero
        self.conv = rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.1, np.float32)
        self.out = rng.normal(0, 0.2, 2 * len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.words = np.zeros((BUCKETS, 0), np.float32)          # log frequency of whole words by language
        self.cuts = np.zeros(1, np.float32)                      # threshold by language, the last for any other
        self.scale = 1.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids].sum(axis=1)

    def respond(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Filter responses (before the maximum) at each word but the last ``max(WIDTHS) - 1``, which only follow."""
        n, x = len(ids) - max(WIDTHS) + 1, vectors @ self.conv
        y = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, w, col in places():
            part = y[:, k * FILTERS:(k + 1) * FILTERS]
            part[:] = x[:n, col:col + FILTERS]
            for j in range(1, w):
                part += x[j:n + j, col + j * FILTERS:col + (j + 1) * FILTERS]
        y += self.bias
        y[ids[:n, 0] == 0] = -np.inf        # no window begins between two documents
        return y

    def pool(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Largest and mean block maximum of every filter, per document."""
        n_docs, n_f = len(before) - 1, len(WIDTHS) * FILTERS
        top, total = np.zeros((n_docs, n_f), np.float32), np.zeros((n_docs, n_f), np.float32)
        blocks = -(-np.diff(before) // BLOCK)
        padded, begin = pad(ids, before)
        edges, owner = block_edges(before, begin)
        lo, stop = 0, len(padded) - max(WIDTHS) + 1
        while lo < len(edges):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + CHUNK)))
            end = int(edges[hi]) if hi < len(edges) else stop
            part = padded[edges[lo]:end + max(WIDTHS) - 1]
            y = self.respond(part, self.embed(part))
            best = np.maximum(np.maximum.reduceat(y, edges[lo:hi] - edges[lo], axis=0), 0)
            docs, first = np.unique(owner[lo:hi], return_index=True)
            top[docs] = np.maximum(top[docs], np.maximum.reduceat(best, first, axis=0))
            total[docs] += np.add.reduceat(best, first, axis=0)
            lo = hi
        return np.concatenate([top, total / np.maximum(blocks, 1)[:, None]], axis=1)

    def language(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each document (the last index: none)."""
        n = self.words.shape[1]
        out = np.full(len(before) - 1, n)
        some = np.flatnonzero(np.diff(before))
        if n and len(some):
            sums = [np.add.reduceat(self.words[ids[:, 0], k], before[some]) for k in range(n)]
            out[some] = np.argmax(np.stack(sums), axis=0)
        return out

    def logits(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each document; one without words holds nothing toxic."""
        return np.where(np.diff(before) > 0, self.pool(ids, before) @ self.out + self.base[0], NOTHING)

    def score(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        return learn.sigmoid((self.logits(ids, before).astype(float) - self.cuts[self.language(ids, before)]) / self.scale)


def pad(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with empty ones after each document, so that no window spans two; and where each document begins."""
    gap = max(WIDTHS) - 1
    begin = before[:-1] + gap * np.arange(len(before) - 1)
    out = np.zeros((len(ids) + gap * (len(before) - 1), ids.shape[1]), ids.dtype)
    out[np.arange(len(ids)) + gap * np.repeat(np.arange(len(before) - 1), np.diff(before))] = ids
    return out, begin


def block_edges(before: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of all blocks of ``BLOCK`` words in the padded words, and the document of each."""
    n = np.diff(before)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return begin[owner] + BLOCK * nth, owner


def _train_batch(model: Model, adam: learn.Adam, ids: np.ndarray, before: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    padded, begin = pad(ids, before)
    edges, owner = block_edges(before, begin)
    n_docs, n_f = len(labels), len(WIDTHS) * FILTERS
    x = model.embed(padded)
    y = model.respond(padded, x)
    n = len(y)
    best = np.maximum.reduceat(y, edges, axis=0)
    docs, first = np.unique(owner, return_index=True)
    blocks = np.diff(np.r_[first, len(owner)])
    live = np.maximum(best, 0)
    top, mean = np.zeros((n_docs, n_f), np.float32), np.zeros((n_docs, n_f), np.float32)
    top[docs] = np.maximum.reduceat(live, first, axis=0)
    mean[docs] = np.add.reduceat(live, first, axis=0) / blocks[:, None]
    pooled = np.concatenate([top, mean], axis=1)
    logit = pooled @ model.out + model.base[0]
    p = learn.sigmoid(logit)
    err = ((p - labels) * weight).astype(np.float32) / n_docs
    # A text without any response is clean: one such row goes with every batch.
    blank = BLANK_WEIGHT * learn.sigmoid(model.base)
    grads = {"out": pooled.T @ err, "base": np.array([err.sum()], np.float32) + blank.astype(np.float32)}
    back = err[:, None] * model.out
    # Each live block passes the mean's share on; the document's best block the maximum's too.
    of_block = np.repeat(np.arange(len(docs)), blocks)
    g = back[owner][:, n_f:] / blocks[of_block][:, None]
    g = g + np.where(best >= top[owner], back[owner][:, :n_f], 0)
    g = np.where(best > 0, g, 0).astype(np.float32)
    # It goes to the first word of the block with that response.
    block = np.repeat(np.arange(len(edges)), np.diff(np.r_[edges, n]))
    word, f = np.nonzero(y == best[block])
    at = np.zeros(best.shape, np.int64)
    at[block[word[::-1]], f[::-1]] = word[::-1]
    dy = np.zeros_like(y)
    dy[at, np.arange(n_f)] = g
    grads["bias"] = dy.sum(axis=0)
    grads["conv"], dx = np.zeros_like(model.conv), np.zeros_like(x)
    for k, w, col in places():
        own = dy[:, k * FILTERS:(k + 1) * FILTERS]
        for j in range(w):
            c = slice(col + j * FILTERS, col + (j + 1) * FILTERS)
            grads["conv"][:, c] = x[j:n + j].T @ own
            dx[j:n + j] += own @ model.conv[:, c].T
    rows = np.flatnonzero(dx.any(axis=1))
    dx = dx[rows]
    flat, share = padded[rows].ravel(), np.repeat(dx, padded.shape[1], axis=0)
    live = model.live[flat]
    used, dt = learn.sum_rows(flat[live], share[live])
    grads["table"] = dt
    adam.step(grads, {"table": used})
    return float(np.mean(np.logaddexp(0, logit) - labels * logit) + BLANK_WEIGHT * np.logaddexp(0, model.base[0]))


def _languages(ids: np.ndarray, before: np.ndarray, langs: list) -> tuple[np.ndarray, list]:
    """Log frequency of whole-word buckets by language, over the languages with enough documents."""
    counts: dict = {}
    for x in langs:
        counts[x] = counts.get(x, 0) + 1
    names = sorted(x for x, n in counts.items() if x is not None and n >= LEAST_PER_LANGUAGE)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out = np.zeros((BUCKETS, len(names)), np.float32)
    index = np.array([names.index(x) if x in names else -1 for x in langs])
    for k in range(len(names)):
        n = np.bincount(ids[index[owner] == k, 0], minlength=BUCKETS) + 0.1
        out[:, k] = np.log(n / n.sum())
    return out, names


def all_features(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of a column, slice by slice."""
    batches = pa.table({"text": texts}).to_batches()
    found = [features(b.column("text")) for b in slices(iter(batches), "text")]
    if not found:
        return features(pa.array([], pa.string()))
    counts = np.concatenate([np.diff(before) for _, before in found])
    return np.concatenate([ids for ids, _ in found]), np.r_[0, np.cumsum(counts)]


def fit(table: pa.Table, epochs: int = EPOCHS, least_seen: int = LEAST_SEEN, seed: int = 1, batch: int = 48) -> Model:
    """Train on rows of text, label and lang; every ``HELD_BACK``-th row only calibrates."""
    model = Model(seed)
    ids, before = all_features(table.column("text"))
    labels, langs = table.column("label").to_numpy().astype(np.float32), table.column("lang").to_pylist()
    n = len(labels)
    if not n or labels.min() == labels.max():
        model.base[0] = -2.0 if not n or labels.max() == 0 else 2.0
        return model
    model.words, _ = _languages(ids, before, langs)
    rng = np.random.default_rng(seed)
    held = rng.permutation(n) % HELD_BACK == 0
    learnt = np.flatnonzero(~held & (np.diff(before) > 0))
    weight = np.where(labels > 0, (labels == 0).sum() / max(1, (labels > 0).sum()), 1.0).astype(np.float32) ** 0.5
    owner = np.repeat(np.arange(n), np.diff(before))
    for k in range(ids.shape[1]):       # documents that hold each bucket, counted per feature
        pairs = np.unique(ids[:, k].astype(np.int64) * n + owner)
        frequency = np.bincount(pairs // n, minlength=BUCKETS) + (frequency if k else 0)
    model.live = frequency >= LEAST_DOCUMENTS
    model.live[0] = False
    model.table[~model.live] = 0
    names = ("table", "conv", "bias", "out", "base")
    adam = learn.Adam({k: getattr(model, k) for k in names}, 0.01)
    epochs = max(epochs, min(40, -(-least_seen // max(1, len(learnt)))))
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(learnt)
        order = order[np.argsort(np.arange(len(order)) // 512 * 10**9 + np.diff(before)[order] // 64, kind="stable")]
        for some in np.array_split(order, max(1, len(order) // batch)):
            some = np.sort(some)
            take = np.concatenate([np.arange(before[d], before[d + 1]) for d in some])
            _train_batch(model, adam, ids[take], np.r_[0, np.cumsum(np.diff(before)[some])], labels[some], weight[some])
    cal = np.flatnonzero(held)
    take = np.concatenate([np.arange(before[d], before[d + 1]) for d in cal]) if len(cal) else np.zeros(0, np.int64)
    cal_before = np.r_[0, np.cumsum(np.diff(before)[cal])].astype(np.int64)
    z, y = model.logits(ids[take], cal_before).astype(float), labels[cal]
    lang = model.language(ids[take], cal_before)
    any_ = learn.best_threshold(z, y)
    model.cuts = np.full(model.words.shape[1] + 1, any_, np.float32)
    for k in range(model.words.shape[1]):
        own = lang == k
        if own.sum() >= LEAST_PER_LANGUAGE and 5 <= y[own].sum() < own.sum():
            model.cuts[k] = learn.best_threshold(z[own], y[own])
    model.scale = learn.temperature(z - model.cuts[lang], y)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, label: str = "toxic",
          sample: tuple[int, int] = SAMPLE, **kwargs) -> Model:
    """Fit on at most about ``sample`` labelled documents (of label 1, of label 0) outside the held-out fold."""
    rows = labels.where((learn.fold(F.col("doc_id"), folds) != held_out) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    wanted = learn.draw(docs, rows.where("label in (0, 1)"), "label", lambda counts: {k: sample[1 - k] for k in counts})
    langs = docs.select("doc_id", "lang").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("lang").alias("lang"))
    return learn.fit_in_task(learn.texts_of(docs, langs), partial(fit, **kwargs))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and the score; 0.5 is the threshold."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            ids, before = features(batch.column(text))
            found = pa.array(held.value.score(ids, before), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], names=[*keep, into])

    return docs.mapInArrow(run, schema)
