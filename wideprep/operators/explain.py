"""Per-prediction explanations with TreeSHAP (ML8, ML9, SO4).

Path-dependent TreeSHAP (Lundberg et al., "Consistent individualized feature attribution for tree ensembles") gives a
leaf's share to the features on its path.  With ``o`` telling whether a row meets a feature's condition, and ``z`` the share of
training rows that take its branches, feature i's weight at a leaf of d conditions is the Shapley sum over the other
conditions, which equals an integral:

    (o_i - z_i) * sum_S |S|! (d - 1 - |S|)! / d! * prod_{k in S} o_k * prod_{k not in S} z_k
        = (o_i - z_i) * integral over t in (0, 1) of prod_{k != i} (o_k t + z_k (1 - t))

The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature with (d + 1) // 2 nodes is exact: a leaf costs d times d / 2
steps at any depth, with no table of condition sets.  Rows are explained where they lie, a batch of rows with all leaves in numpy; nothing is
shuffled, and the model (its leaves) is all that is broadcast.

``base_value + sum(contributions) = probability`` (forest) or ``margin`` (boosted) for every row and class.  Rows that share a
``key`` are explained each for itself.  Null values are explained as NaN, which takes the right branch.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideprep.functions.text import sign_label
from wideprep.operators._util import col

#: Numbers that one step holds at once (rows x leaves x conditions): 16 MB an array.
STEP_CELLS = 1 << 21


def leaves(java_tree, value) -> list[dict]:
    """Leaves of one fitted tree: ``value(node)`` and, per feature on the path, the interval or category set that leads
    there and the share of training rows that take those branches."""
    out = []

    def weight(node):
        return float(sum(node.impurityStats().stats())) if node.impurityStats().count() is None else float(node.impurityStats().count())

    def walk(node, path):
        if node.getClass().getSimpleName() != "InternalNode":
            out.append({"value": value(node), "path": path})
            return
        split, total = node.split(), weight(node)
        f = int(split.featureIndex())
        lo, hi, cats, share = path.get(f, (None, None, None, 1.0))
        if split.getClass().getSimpleName() == "ContinuousSplit":
            t = float(split.threshold())
            sides = ((node.leftChild(), (lo, t if hi is None else min(t, hi), None)), (node.rightChild(), (t if lo is None else max(t, lo), hi, None)))
        else:
            sides = tuple((n, (None, None, sorted(set(map(float, c)) & set(cats or map(float, c)))))
                          for n, c in ((node.leftChild(), split.leftCategories()), (node.rightChild(), split.rightCategories())))
        for child, interval in sides:
            walk(child, {**path, f: (*interval, share * weight(child) / (total or 1.0))})

    walk(java_tree.rootNode(), {})
    return out


def forest_leaves(rf_model) -> list[dict]:
    """Leaves of all trees of a random forest; values are class distributions over the number of trees."""
    trees = rf_model._java_obj.trees()

    def value(node):
        stats = [float(x) for x in node.impurityStats().stats()]
        return [x / (sum(stats) or 1.0) / len(trees) for x in stats]

    return [leaf for t in trees for leaf in leaves(t, value)]


def boosted_leaves(ovr_model) -> list[dict]:
    """Leaves of all trees of a ``OneVsRest(GBTClassifier)`` model; a tree counts for its own class only."""
    out, n = [], len(ovr_model.models)
    for c, m in enumerate(ovr_model.models):
        for tree, w in zip(m._java_obj.trees(), m._java_obj.treeWeights()):
            out += leaves(tree, lambda node, c=c, w=w: [float(w) * float(node.prediction()) if k == c else 0.0 for k in range(n)])
    return out


class _Paths:
    """All leaves whose paths name ``d`` features, as arrays over (leaf, condition)."""

    def __init__(self, found: list[dict], d: int):
        paths = [sorted(leaf["path"].items()) for leaf in found]
        self.d, self.values = d, np.array([leaf["value"] for leaf in found], float)
        self.f = np.array([[f for f, _ in p] for p in paths], int).reshape(len(found), d)
        number = lambda at, none: np.array([[none if c[at] is None else c[at] for _, c in p] for p in paths], float).reshape(len(found), d)
        self.lo, self.hi, self.share = number(0, -np.inf), number(1, np.inf), number(3, 1.0)
        self.any_low = np.isneginf(self.lo)
        self.any_high = np.isposinf(self.hi)
        self.cats = [(n, k, np.array(c[2], float)) for n, p in enumerate(paths) for k, (_, c) in enumerate(p) if c[2] is not None]
        nodes, weights = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
        self.nodes, self.weights = (nodes + 1) / 2, weights / 2

    def met(self, x: np.ndarray) -> np.ndarray:
        """Whether each row meets each condition; NaN is above every threshold."""
        v = x[:, self.f]
        out = (self.any_low | ~(v <= self.lo)) & (self.any_high | (v <= self.hi))
        for n, k, cats in self.cats:
            out[:, n, k] = np.isin(v[:, n, k], cats)
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Weight of every condition of every leaf for every row."""
        met = self.met(x).astype(float)
        out = np.zeros_like(met)
        for t, w in zip(self.nodes, self.weights):
            part = met * t + self.share * (1 - t)          # positive: a branch has training rows
            out += w * part.prod(axis=2, keepdims=True) / part
        return (met - self.share) * out


class _Shap:
    """The leaves of a model by length of path, ready to explain rows."""

    def __init__(self, found: list[dict], n_features: int):
        self.n_features, self.n_classes = n_features, len(found[0]["value"])
        self.base = np.sum([np.array(leaf["value"], float) * prod(c[3] for c in leaf["path"].values()) for leaf in found], axis=0)
        by: dict[int, list[dict]] = {}
        for leaf in found:
            by.setdefault(len(leaf["path"]), []).append(leaf)
        self.groups = [_Paths(held, d) for d, held in sorted(by.items()) if d]

    def values(self, x: np.ndarray) -> np.ndarray:
        """Contributions (row, feature, class)."""
        out = np.zeros((len(x), self.n_features, self.n_classes))
        for g in self.groups:
            flat, place = g.f.ravel(), np.repeat(np.arange(len(g.f)), g.d)
            order = np.argsort(flat, kind="stable")
            edges = np.flatnonzero(np.diff(flat[order], prepend=-1))
            step = max(1, STEP_CELLS // flat.size)
            for lo in range(0, len(x), step):
                w = g.shapley(x[lo:lo + step]).reshape(-1, flat.size)
                for at in np.split(order, edges[1:]):
                    out[lo:lo + step, flat[at[0]]] += w[:, at] @ g.values[place[at]]
        return out


def _explain(found: list[dict], df: DataFrame, key: str, features, label: str | None, total: str, predicted_only: bool) -> DataFrame:
    spark, feats = df.sparkSession, list(features)
    shap = _Shap(found, len(feats))
    n, base, model = shap.n_classes, [float(b) for b in shap.base], spark.sparkContext.broadcast(shap)
    lab = col(label).cast("string") if label else F.lit(None).cast("string")
    x = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in feats])
    src = df.select(col(key).cast("string").alias("row_key"), lab.alias("true_class"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shap = model.value
        rows = max(1, STEP_CELLS // (shap.n_features * n))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                s = shap.values(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, shap.n_features))
                every = s.sum(axis=1) + shap.base
                best = every.argmax(axis=1)
                if predicted_only:
                    s = s[np.arange(len(s)), :, best]
                held = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * (s[0].size if len(s) else 0), pa.array(s.ravel()))
                sums = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * n, pa.array(every.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("true_class"), pa.array(best.astype(np.int32)), sums, held],
                                                 names=["row_key", "true_class", "predicted_class", "all", "s"])

    made = src.mapInArrow(run, "row_key string, true_class string, predicted_class int, all array<double>, s array<double>")
    long = made.select("row_key", "true_class", "predicted_class", "all", F.posexplode("s").alias("i", "shap_value"))
    own, feature = (F.col("predicted_class"), F.col("i")) if predicted_only else (F.col("i") % n, F.expr(f"i div {n}").cast("int"))
    return long.select("row_key", "true_class", "predicted_class", own.cast("long").alias("class"),
                       F.element_at(F.lit(feats), feature + 1).alias("feature_name"), "shap_value",
                       F.element_at(F.lit(base), (own + 1).cast("int")).alias("base_value"), F.element_at("all", (own + 1).cast("int")).alias(total))


def explain(rf_model, df: DataFrame, key: str, features, label: str | None = None, predicted_only: bool = False) -> DataFrame:
    """ML8: long table ``row_key, true_class, predicted_class, class, feature_name,
    shap_value, base_value, probability`` for every row, feature and class (``predicted_only``: the predicted class)."""
    return _explain(forest_leaves(rf_model), df, key, features, label, "probability", predicted_only)


def explain_boosted(model, df: DataFrame, key: str, features, label: str | None = None, predicted_only: bool = False) -> DataFrame:
    """ML8 for a boosted model, per class (``OneVsRest``) or multiclass (``boosting.Softmax``): contributions to every
    class's margin; ``margin`` in place of ``probability``."""
    found = boosted_leaves(model) if hasattr(model, "models") else model.leaves()
    return _explain(found, df, key, features, label, "margin", predicted_only)


def explain_predicted(long: DataFrame) -> DataFrame:
    """ML8 for the predicted class only."""
    return long.where(F.col("class") == F.col("predicted_class")).drop("class")


def explain_topk(long: DataFrame, k: int = 10) -> DataFrame:
    """SO4/TX9: top ``k`` features by absolute contribution per row (predicted class)."""
    pred = explain_predicted(long)
    w = Window.partitionBy("row_key").orderBy(F.abs("shap_value").desc(), "feature_name")
    return (pred.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("effect", sign_label("shap_value")))


def explain_global(long: DataFrame) -> DataFrame:
    """ML9: ``feature_name, class, mean_abs_shap`` over all explained rows."""
    return long.groupBy("feature_name", "class").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
