"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are the runs of 3 and 4 bytes of its lower-cased words (with a blank before and after each word).  Their hashed vectors are averaged
and a softmax over all languages of the labelled rows gives probabilities, with a temperature fitted on held-back rows.  A text whose best
probability is below the calibrated confidence is marked ``rejected``; the prediction itself stays.

A text that is null or has no letter gets ``und`` with score 0 and is rejected.  ``lang`` is a training label only.  Rows without it are not learned from.
Whole texts are read; repeated rows and extra columns pass through, a column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.llm import learn
from wideprep.llm.arrow_text import LOWER, WORD_BYTES, slices, string_buffers

BUCKETS = 1 << 15
DIM = 16
SIZES = (3, 4)
#: Documents learned from, chosen by hash; a language gets its share of them.
SAMPLE = 4000
#: Documents that a language gets at least, beyond ``SAMPLE`` if need be (all it has if it has fewer).
LEAST_PER_LANGUAGE = 100
#: Texts of a language seen in training at least: those of a language with few are read more often.
LEAST_SEEN = 400
EPOCHS = 4
HELD_BACK = 5
#: Share of right predictions wanted among the accepted held-back rows.
WANTED_ACCURACY = 0.995
UNKNOWN = "und"
MULTIPLIER = np.uint32(0x01000193)


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of all rows and the number of subwords before each row."""
    raw, offsets = string_buffers(column)
    n_rows = len(offsets) - 1
    chars = np.full(len(raw) + n_rows + 1, 32, np.uint8)
    letters = np.where(WORD_BYTES[raw] & ((raw < 48) | (raw > 57)), LOWER[raw], 32).astype(np.uint8)
    chars[np.arange(len(raw)) + 1 + np.repeat(np.arange(n_rows), np.diff(offsets))] = letters
    begin = offsets + np.arange(n_rows + 1)          # the blank before each row; the last ends the last row
    blank = chars == 32
    codes, places = [], []
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            continue
        inside = np.ones(n, bool)
        for j in range(1, size - 1):
            inside &= ~blank[j:n + j]
        at = np.flatnonzero(inside)
        h = np.full(len(at), 2166136261 + size, np.uint32)
        for j in range(size):
            h = (h ^ chars[at + j]) * MULTIPLIER
        h ^= h >> np.uint32(15)
        codes.append((h % np.uint32(BUCKETS)).astype(np.int32))
        places.append(at)
    if not codes:
        return np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
    counts = [np.searchsorted(p, begin) for p in places]
    before = sum(counts)
    out = np.empty(before[-1] if n_rows else 0, np.int32)
    owner = [np.repeat(np.arange(n_rows), np.diff(c)) for c in counts]
    done = np.zeros(n_rows, np.int64)
    for code, c, own in zip(codes, counts, owner):
        out[before[:-1][own] + done[own] + np.arange(len(own)) - (c[:-1] - c[0])[own]] = code[c[0]:c[-1]]
        done += np.diff(c)
    return out, before


class Model:
    """``embed`` (bucket x DIM), ``out`` (DIM x language), ``bias``; scoring folds the first two into one table."""

    def __init__(self, names: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.names = names
        self.embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, len(names)), np.float32)
        self.bias = np.zeros(len(names), np.float32)
        self.temperature, self.confidence = 1.0, 0.0
        self.table = np.zeros((BUCKETS, len(names)), np.float32)

    def logits(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = np.diff(before)
        out = np.tile(self.bias.astype(float), (len(n), 1))
        some = np.flatnonzero(n)
        for k in range(len(self.names)):
            if len(some):
                out[some, k] += np.add.reduceat(self.table[codes, k], before[some], dtype=np.float64) / n[some]
        return out

    def probabilities(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = self.logits(codes, before) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(table: pa.Table, epochs: int = EPOCHS, seed: int = 1, rate: float = 0.5, names: list[str] | None = None) -> Model:
    """Train on rows of text and lang (one of ``names``); every ``HELD_BACK``-th row only calibrates, but never the first of a language."""
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs) if names is None else names)
    model = Model(names, seed)
    if not names:
        return model
    place = {x: k for k, x in enumerate(names)}
    docs, target = [], np.array([place[x] for x in langs], dtype=np.int64)
    for batch in slices(iter(table.select(["text"]).to_batches()), "text"):
        codes, before = subwords(batch.column("text"))
        docs += [codes[a:b] for a, b in zip(before[:-1], before[1:])]
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(docs)) % HELD_BACK == 0
    bags = [np.unique(d, return_counts=True) for d in docs]
    some = np.flatnonzero([len(d) > 0 for d in docs])
    held[some[np.unique(target[some], return_index=True)[1]]] = False
    own = some[~held[some]]
    often = -(-LEAST_SEEN // (epochs * np.maximum(1, np.bincount(target[own], minlength=len(names)))))
    own = np.repeat(own, np.maximum(1, often)[target[own]])
    steps = max(1, epochs * len(own))
    for step, i in enumerate(np.concatenate([rng.permutation(own) for _ in range(epochs)])):
        pace = rate * (1 - step / steps)
        codes, counts = bags[i]
        share = (counts / counts.sum()).astype(np.float32)
        mean = share @ model.embed[codes]
        z = mean @ model.out + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[target[i]] -= 1
        back = model.out @ p
        model.out -= pace * np.outer(mean, p)
        model.bias -= 0.1 * pace * p
        # An average spreads its gradient over all subwords; each moves in proportion to its share.
        model.embed[codes] -= (pace * len(codes) * 0.5) * share[:, None] * back / max(1, len(codes)) ** 0.5
    model.table = model.embed @ model.out
    back_rows = [i for i in np.flatnonzero(held) if len(docs[i])]
    if back_rows:
        flat = np.concatenate([docs[i] for i in back_rows])
        before = np.r_[0, np.cumsum([len(docs[i]) for i in back_rows])]
        z, y = model.logits(flat, before), target[back_rows]
        grid = np.exp(np.linspace(np.log(0.05), np.log(4), 50))
        loss = []
        for t in grid:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            loss.append(float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])))
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.probabilities(flat, before)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= WANTED_ACCURACY)
        if not len(good):
            model.confidence = 1.0
        elif good[-1] + 1 < len(y):       # everything below the last row that keeps the accuracy is rejected
            model.confidence = float(p.max(axis=1)[order][good[-1]])
    return model


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, **kwargs) -> Model:
    """Fit on about ``sample`` documents with a language outside the held-out fold, or more where a language has less than
    ``LEAST_PER_LANGUAGE`` among them.  One row per language, its number of documents, reaches the driver."""
    rows = docs.where((learn.fold(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min("lang").alias("lang"))
    names: list[str] = []

    def quota(counts: dict) -> dict:
        names.extend(counts)
        share = sample / max(1, sum(counts.values()))
        return {k: max(round(n * share), LEAST_PER_LANGUAGE) for k, n in counts.items()}

    wanted = learn.draw(docs, rows, "lang", quota)
    return fit(learn.gather(docs.select("doc_id", "text"), wanted), names=names, **kwargs)


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and a struct ``into``: lang, score and rejected."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    read = docs.select(*[F.col(f"`{c}`") for c in {*keep, text}], F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            known = held.value
            letter = np.asarray(batch.column("__letter").to_pylist(), bool)
            if known.names:
                p = known.probabilities(*subwords(batch.column(text)))
                best, score = p.argmax(axis=1), np.where(letter, p.max(axis=1), 0.0)
                lang = [known.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())]
            else:
                score, lang = np.zeros(len(letter)), [UNKNOWN] * len(letter)
            parts = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~letter | (score < known.confidence))]
            result = pa.StructArray.from_arrays(parts, names=["lang", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], result], names=[*keep, into])

    return read.mapInArrow(run, schema)
