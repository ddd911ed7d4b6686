"""Multiclass gradient boosting (ML5): one regression tree per class and round on the softmax gradients.

Features are cut into ``max_bins`` bins at approximate quantiles.  All trees of a round grow together, a level per job: every task
walks its rows down to their nodes and sums gradients and hessians by (class, node, feature, bin) in numpy, Spark adds the tasks' sums by
(class, node, feature) with a partial sum before the shuffle, and the best split of each (class, node) follows from running sums over
the bins.  Leaf values are a Newton step, so a round's last level needs no further job.  A task holds one histogram and one batch of rows; the driver
gets one row per class and node.  Margins are not stored after each round but every ``KEEP_ROUNDS``, by checkpoint; in between
tasks apply the few trees that are younger.

Null and NaN values lie above every threshold.  Rows without a label are not learned from.  Rows are never sampled; the result depends on
the rows and, through the order of floating point sums, in its last bits on their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.operators._util import col
from wideprep.session import checkpoint_dir

#: Rounds between two checkpoints of the margins.
KEEP_ROUNDS = 10
#: Bytes of the histograms of one task; classes beyond it take a further job.
HISTOGRAM_BYTES = 256 << 20
#: Cells (rows x features) that one step counts at once.
STEP_CELLS = 1 << 21
#: Columns of one aggregate that looks for bin edges.
CHUNK = 200


@dataclass
class Trees:
    """Trees of one depth in heap order (children of i: 2i + 1 and 2i + 2); arrays over (tree, node)."""

    feature: np.ndarray
    split: np.ndarray          # a row goes left if its bin is at most this
    value: np.ndarray          # margin added at a leaf
    cover: np.ndarray          # hessians of the training rows
    gain: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int) -> "Trees":
        size = (n, (1 << depth + 1) - 1)
        return cls(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(size), np.zeros(size))

    def walk(self, bins: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node of every row after ``levels`` steps; rows in a leaf stay."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, f] > self.split[tree, at]))
        return at


@dataclass
class Softmax:
    """A fitted model: bin edges by feature, log priors, and one ``Trees`` (a tree per class) a round."""

    features: list[str]
    edges: list[np.ndarray]
    prior: np.ndarray
    depth: int
    rounds: list[Trees] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def add(self, margins: np.ndarray, bins: np.ndarray, rounds: list[Trees]) -> np.ndarray:
        for trees in rounds:
            for c in range(margins.shape[1]):
                margins[:, c] += trees.value[c, trees.walk(bins, c, self.depth)]
        return margins

    def importances(self) -> np.ndarray:
        """Gain by feature over all rounds and classes, 100 in all."""
        out = np.zeros(len(self.features))
        for trees in self.rounds:
            inner = trees.feature >= 0
            np.add.at(out, trees.feature[inner], trees.gain[inner])
        return out * 100 / (out.sum() or 1.0)

    def leaves(self) -> list[dict]:
        """Leaves with paths, as ``explain`` takes them; the priors are a leaf without conditions."""
        out, n = [{"value": self.prior.tolist(), "path": {}}], len(self.prior)
        for trees in self.rounds:
            for c in range(n):
                todo = [(0, {})]
                while todo:
                    at, path = todo.pop()
                    f = int(trees.feature[c, at])
                    if f < 0:
                        out.append({"value": [float(trees.value[c, at]) if k == c else 0.0 for k in range(n)], "path": path})
                        continue
                    lo, hi, _, share = path.get(f, (None, None, None, 1.0))
                    t = float(self.edges[f][trees.split[c, at]])
                    for child, a, b in ((2 * at + 1, lo, t if hi is None else min(t, hi)), (2 * at + 2, t if lo is None else max(t, lo), hi)):
                        todo.append((child, {**path, f: (a, b, None, share * float(trees.cover[c, child] / trees.cover[c, at]))}))
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def _values(features) -> "F.Column":
    return F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _edges(train: DataFrame, features, max_bins: int) -> list[np.ndarray]:
    shares, out = [i / max_bins for i in range(1, max_bins)], []
    for lo in range(0, len(features), CHUNK):
        some = features[lo:lo + CHUNK]
        real = [F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in some]
        row = train.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"e{i}") for i, x in enumerate(real)]).first()
        out += [np.unique(np.array(e or [], float)) for e in row]
    return out


def _histograms(model: Softmax, young: list[Trees], growing: Trees, level: int, max_bins: int, classes: range):
    n, n_features = len(model.prior), len(model.features)
    first, nodes = (1 << level) - 1, 1 << level
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("class", "node", "f")]
                          + [T.StructField(f"{s}{b}", T.DoubleType()) for s in "gh" for b in range(max_bins)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(classes), nodes, n_features, max_bins))
        step = max(1, STEP_CELLS // n_features)
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            bins, y = _matrix(batch.column("bins"), n_features).astype(int), batch.column("label").to_numpy()
            p = softmax(model.add(_matrix(batch.column("margins"), n).copy(), bins, young))
            columns = np.arange(n_features) * max_bins
            for i, c in enumerate(classes):
                at = growing.walk(bins, c, level) - first
                open_ = at >= 0                                # the others rest in a leaf above
                cell = (at[open_, None] * n_features * max_bins + columns + bins[open_]).ravel()
                g, h = p[open_, c] - (y[open_] == c), p[open_, c] * (1 - p[open_, c])
                for k, w in enumerate((g, h)):
                    sums[k, i] += np.bincount(cell, np.repeat(w, n_features), nodes * n_features * max_bins).reshape(nodes, n_features, max_bins)
        i, node, f = np.nonzero(sums[1].any(axis=-1))
        held = sums[:, i, node, f]
        ids = [pa.array(v.astype(np.int32)) for v in (i + classes.start, node + first, f)]
        yield pa.RecordBatch.from_arrays(ids + [pa.array(np.ascontiguousarray(held[k, :, b])) for k in (0, 1) for b in range(max_bins)], names=schema.names)

    return run, schema


def _best(max_bins: int, penalty: float, least: float):
    """The best split of every (class, node, feature) row of sums; ``bin`` -1 where none gains."""
    names = ["class", "node", "f", "gain", "bin", "g", "h", "g_left", "h_left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, h = (np.stack([batch.column(f"{s}{b}").to_numpy() for b in range(max_bins)], axis=1).cumsum(axis=1) for s in "gh")
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g ** 2 / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - total_g ** 2 / (total_h + penalty)
            gain[(h < least) | (total_h - h < least)] = 0
            at = gain.argmax(axis=1)
            rows = np.arange(len(at))
            best = gain[rows, at]
            made = [best, np.where(best > 1e-12, at, -1).astype(np.int32), total_g[:, 0], total_h[:, 0], g[rows, at], h[rows, at]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + [pa.array(v) for v in made], names=names)

    return run, "class int, node int, f int, gain double, bin int, g double, h double, g_left double, h_left double"


def train_softmax(train: DataFrame, features, label: str, rounds: int = 50, max_depth: int = 6, step_size: float = 0.1,
                  max_bins: int = 32, penalty: float = 1.0, least_hessian: float = 1e-3) -> Softmax:
    """Fit ``rounds`` rounds on class indexes 0, 1, ... in ``label``.  ``penalty`` is added to the hessians of a leaf, ``least_hessian``
    is what a child must hold at least."""
    spark, features = train.sparkSession, list(features)
    checkpoint_dir(spark)
    data = train.where(col(label).isNotNull())
    counts = {int(r[0]): r[1] for r in data.groupBy(col(label).cast("int")).agg(F.count("*")).collect()}      # one row per class
    if not counts:
        raise ValueError("no row has a label")
    if min(counts) < 0:
        raise ValueError("labels must be class indexes from 0")
    n = max(counts) + 1
    prior = np.log([(counts.get(c, 0) + 0.5) / (sum(counts.values()) + 0.5 * n) for c in range(n)])
    model = Softmax(features, _edges(data, features, max_bins), prior, max_depth)
    held = spark.sparkContext.broadcast(Softmax(features, model.edges, prior, max_depth))

    def binned(batches):
        for batch in batches:
            bins = held.value.bins(_matrix(batch.column("x"), len(features))).astype(np.int16)
            yield pa.RecordBatch.from_arrays([_lists(bins), batch.column("label"), _lists(np.tile(prior, (len(bins), 1)))], names=["bins", "label", "margins"])

    schema = "bins array<smallint>, label int, margins array<double>"
    state = data.select(_values(features).alias("x"), col(label).cast("int").alias("label")).mapInArrow(binned, schema).checkpoint()
    young: list[Trees] = []
    best, best_schema = _best(max_bins, penalty, least_hessian)
    sums = [F.sum(f"{s}{b}").alias(f"{s}{b}") for s in "gh" for b in range(max_bins)]
    shrink = step_size * (n - 1) / n if n > 1 else step_size
    for number in range(rounds):
        trees = Trees.empty(n, max_depth)
        for level in range(max_depth):
            found, at_once = [], max(1, HISTOGRAM_BYTES // (16 * (1 << level) * len(features) * max_bins))
            for lo in range(0, n, at_once):
                run, hist_schema = _histograms(Softmax(features, model.edges, prior, max_depth), young, trees, level, max_bins, range(lo, min(n, lo + at_once)))
                found += state.mapInArrow(run, hist_schema).groupBy("class", "node", "f").agg(*sums).mapInArrow(best, best_schema) \
                    .groupBy("class", "node").agg(F.max_by(F.struct("f", "gain", "bin", "g", "h", "g_left", "h_left"), F.struct("gain", -F.col("f"))).alias("s")).collect()
            grown = 0
            for r in found:
                c, at, s = r["class"], r["node"], r["s"]
                trees.cover[c, at], trees.value[c, at] = s["h"], -shrink * s["g"] / (s["h"] + penalty)
                if s["bin"] < 0:
                    continue
                grown += 1
                trees.feature[c, at], trees.split[c, at], trees.gain[c, at] = s["f"], s["bin"], s["gain"]
                for child, g, h in ((2 * at + 1, s["g_left"], s["h_left"]), (2 * at + 2, s["g"] - s["g_left"], s["h"] - s["h_left"])):
                    trees.cover[c, child], trees.value[c, child] = h, -shrink * g / (h + penalty)
            if not grown:
                break
        model.rounds.append(trees)
        young.append(trees)
        if len(young) == KEEP_ROUNDS and number + 1 < rounds:
            state, young = _moved(state, model, young, schema).checkpoint(), []
    return model


def _moved(state: DataFrame, model: Softmax, young: list[Trees], schema: str) -> DataFrame:
    slim = Softmax(model.features, model.edges, model.prior, model.depth)

    def run(batches):
        for batch in batches:
            bins = _matrix(batch.column("bins"), len(slim.features)).astype(int)
            margins = slim.add(_matrix(batch.column("margins"), len(slim.prior)).copy(), bins, young)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), _lists(margins)], names=["bins", "label", "margins"])

    return state.mapInArrow(run, schema)


def predict_softmax(model: Softmax, df: DataFrame, keep=()) -> DataFrame:
    """ML7: ``*keep, prediction, probability (array<double>), margin (array<double>)``."""
    held, width = df.sparkSession.sparkContext.broadcast(model), len(model.features)
    kept = [f"_k{i}" for i in range(len(keep))]
    slim = df.select(*[col(c).alias(k) for c, k in zip(keep, kept)], _values(model.features).alias("_x"))
    schema = T.StructType([*[slim.schema[k] for k in kept], T.StructField("prediction", T.IntegerType()),
                           *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("probability", "margin")]])

    def run(batches):
        m = held.value
        for batch in batches:
            bins = m.bins(_matrix(batch.column("_x"), width))
            margins = m.add(np.tile(m.prior, (len(bins), 1)), bins, m.rounds)
            p = softmax(margins)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(p.argmax(axis=1).astype(np.int32)), _lists(p), _lists(margins)],
                                             names=schema.names)

    made = slim.mapInArrow(run, schema)
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "prediction", "probability", "margin")


def importances_softmax(model: Softmax, spark) -> DataFrame:
    """ML6: ``feature, importance`` (100 in all), descending."""
    rows = [(f, float(v)) for f, v in zip(model.features, model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
