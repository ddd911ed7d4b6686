import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wideprep.operators import explain as EX
from wideprep.operators import knn as KN
from wideprep.operators import model as MD


def brute_knn(pdf, cols, k=3):
    X = pdf[cols].to_numpy(dtype=float)
    out = X.copy()
    m = len(cols)
    for i in range(len(X)):
        for c in range(m):
            if not np.isnan(X[i, c]):
                continue
            cands = []
            for j in range(len(X)):
                if np.isnan(X[j, c]):
                    continue
                common = ~np.isnan(X[i]) & ~np.isnan(X[j])
                if not common.any():
                    continue
                d = np.sqrt(m / common.sum() * ((X[i, common] - X[j, common]) ** 2).sum())
                cands.append((d, pdf["id"].iloc[j], X[j, c]))
            cands.sort()
            out[i, c] = np.mean([y for _, _, y in cands[:k]]) if cands else np.nanmean(X[:, c])
    return out


import pytest


@pytest.mark.parametrize("cell_rows", [2, 20, 10_000])
def test_knn_equals_brute_force(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(KN, "GROUP_ROWS", 7)              # cells are dealt over several groups
    rng = np.random.default_rng(11)
    n = 250
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n) * 10, "b": rng.integers(0, 5, n).astype(float),
                        "c": rng.normal(size=n)})
    for col, step in (("a", 7), ("b", 5), ("c", 4)):
        pdf.loc[pdf.index % step == 1, col] = np.nan
    pdf.loc[3, ["a", "b", "c"]] = np.nan                  # a row with nothing: column means
    sdf = spark.createDataFrame(pdf)
    rep = {}
    got = KN.impute_knn(sdf, "id", ["a", "b", "c"], k=3, cell_rows=cell_rows, report=rep).toPandas().sort_values("id")
    want = brute_knn(pdf, ["a", "b", "c"])
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want, atol=1e-9)
    assert rep["receivers"] >= rep["first"] > 0 or cell_rows == 2


def test_knn_over_forty_columns_and_skewed_donors(spark):
    """More columns than a bit mask holds, many presence patterns, and a third of the rows in one small region."""
    rng = np.random.default_rng(4)
    n, m = 160, 40
    x = rng.normal(size=(n, m)) * 5
    x[::3] = 1.0 + rng.normal(size=(len(x[::3]), m)) * 1e-3
    x[rng.random((n, m)) < 0.1] = np.nan
    cols = [f"v{i}" for i in range(m)]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "id", np.arange(n))
    sdf = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x.tolist()], ", ".join(f"{c} double" for c in cols)) \
        .withColumn("id", F.monotonically_increasing_id())
    ids = {r["id"]: i for i, r in enumerate(sdf.select("id").collect())}
    rep = {}
    got = KN.impute_knn(sdf, "id", cols, k=3, cell_rows=16, report=rep).toPandas()
    got = got.assign(id=got["id"].map(ids)).sort_values("id")
    assert np.allclose(got[cols].to_numpy(), brute_knn(pdf, cols), atol=1e-9)


def test_knn_prunes_cells(spark):
    rng = np.random.default_rng(6)
    n = 4000
    x = rng.normal(size=(n, 2))
    rows = [(i, float(a), None if i % 10 == 0 else float(b), None if i % 7 == 0 else float(a + b)) for i, (a, b) in enumerate(x)]
    rep = {}
    out = KN.impute_knn(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", ["a", "b", "c"], cell_rows=50, report=rep)
    assert out.where("b IS NULL OR c IS NULL").count() == 0
    assert rep["cells"] > 40 and rep["first"] + rep["second"] < 0.25 * rep["cells"] * rep["receivers"]


def test_treeshap_additivity(spark):
    rng = np.random.default_rng(2)
    n = 300
    X = rng.normal(size=(n, 4))
    y = (X[:, 0] > 0).astype(int) + (X[:, 1] > 0.5).astype(int)
    pdf = pd.DataFrame(X, columns=["f0", "f1", "f2", "f3"]).assign(label=y, id=np.arange(n))
    sdf = spark.createDataFrame(pdf)
    model = MD.train_forest(sdf, ["f0", "f1", "f2", "f3"], "label", num_trees=5, max_depth=4)
    long = EX.explain(MD.forest(model), sdf.limit(20), "id", ["f0", "f1", "f2", "f3"], "label").toPandas()
    sums = long.groupby(["row_key", "class"]).agg(s=("shap_value", "sum"), b=("base_value", "first"),
                                                  p=("probability", "first"))
    assert np.allclose(sums.s + sums.b, sums.p, atol=1e-9)
    pred = MD.predict(model, sdf.limit(20), keep=("id",)).toPandas()
    probs = {str(r.id): r.probability for r in pred.itertuples()}
    for (rk, c), row in sums.iterrows():
        assert abs(probs[rk][c] - row.p) < 1e-9


def test_importances_sum_to_100(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"]).assign(label=lambda d: (d.a > 0) * 1)
    model = MD.train_forest(spark.createDataFrame(pdf), ["a", "b", "c"], "label", num_trees=5)
    imp = MD.importances(model, ["a", "b", "c"]).toPandas()
    assert abs(imp.importance.sum() - 100) < 1e-9
    assert imp.iloc[0].feature == "a"


def _expected(node, x, known, value):
    """Path-dependent expectation of a tree when only the features ``known`` are given."""
    if node.getClass().getSimpleName() != "InternalNode":
        return np.array(value(node))
    split = node.split()
    left, right = node.leftChild(), node.rightChild()
    if int(split.featureIndex()) in known:
        return _expected(left if x[int(split.featureIndex())] <= split.threshold() else right, x, known, value)
    wl, wr = (sum(c.impurityStats().stats()) for c in (left, right))
    return (wl * _expected(left, x, known, value) + wr * _expected(right, x, known, value)) / (wl + wr)


def test_contributions_are_shapley_values(spark):
    """Against the definition: the mean over all feature orders of what each feature adds."""
    from itertools import combinations
    from math import factorial
    rng = np.random.default_rng(12)
    X = rng.normal(size=(120, 4))
    y = (X[:, 0] + X[:, 2] > 0).astype(int) + (X[:, 3] > 1).astype(int)
    names = [f"f{i}" for i in range(4)]
    sdf = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(label=y, id=np.arange(120)))
    model = MD.train_forest(sdf, names, "label", num_trees=3, max_depth=4)
    trees = MD.forest(model)._java_obj.trees()

    def value(node):
        s = np.array([float(v) for v in node.impurityStats().stats()])
        return s / s.sum() / len(trees)

    long = EX.explain(MD.forest(model), sdf.where("id < 4"), "id", names).toPandas()
    for row in range(4):
        worth = {s: sum(_expected(t.rootNode(), X[row], s, value) for t in trees)
                 for n in range(5) for s in map(frozenset, combinations(range(4), n))}
        for f in range(4):
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth[s | {f}] - worth[s]) for s in worth if f not in s)
            own = long[(long.row_key == str(row)) & (long.feature_name == names[f])].sort_values("class")
            assert np.allclose(own.shap_value, want, atol=1e-9)
            assert np.allclose(own.base_value, worth[frozenset()])


def test_categorical_splits_are_explained(spark):
    rows = [(i, "abc"[i % 3], float(i % 7), int(i % 3 == 1)) for i in range(90)]
    raw = spark.createDataFrame(rows, "id long, c string, x double, label int")
    model, imp, scored, names = MD.end_to_end(raw.withColumn("label", F.col("label").cast("string")), "id", "label", ["x"], ["c"], num_trees=3, max_depth=3)
    ready = scored.count()
    assert ready > 0 and names == ["num__x", "cat__c_a", "cat__c_b", "cat__c_c"]
    assert imp.first()["feature"] in ("cat__c_b", "cat__c_a", "cat__c_c")


def test_split_is_exact_within_strata(spark):
    from wideprep.operators import features as FE
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4 == 0).alias("g"))
    got = {(r.g, r.split): r["count"] for r in FE.split_hash(df, "id", 0.2, exact=True, stratify="g").groupBy("g", "split").count().collect()}
    assert got == {(True, "test"): 5, (True, "train"): 20, (False, "test"): 15, (False, "train"): 60}


def test_scaling_can_be_fitted_on_the_training_part(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i else "only-test", str(i % 2)) for i in range(60)], "id long, x double, c string, label string")
    for fit_on in ("all", "train"):
        _, imp, _, names = MD.end_to_end(df, "id", "label", ["x"], ["c"], fit_on=fit_on, stratify=True, num_trees=2, max_depth=2)
        assert set(names) >= {"num__x", "cat__c_a"} and imp.count() == len(names)


def test_end_to_end_with_classification(spark):
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "label": (x > 0).astype(int),
                        "num_txt": [f"{v:.3f}".replace(".", ",") for v in x * 10],   # decimal comma
                        "grp": rng.choice(["a", "b", "c"], n), "noise": rng.normal(size=n)})
    hints = spark.createDataFrame([("num_txt", "numerical")], "key string, kind string")
    model, imp, scored, names = MD.end_to_end(spark.createDataFrame(pdf), "id", "label", hints=hints,
                                              num_trees=5, max_depth=3)
    assert "num__num_txt" in names and "num__noise" in names and "cat__grp_a" in names
    top = imp.first()
    assert top["feature"] == "num__num_txt"
    assert scored.count() > 0


def test_boosted_per_class_model(spark):
    rng = np.random.default_rng(14)
    X = rng.normal(size=(300, 3))
    y = (X[:, 0] > 0.5).astype(int) + (X[:, 1] > 0).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    sdf = spark.createDataFrame(pdf)
    model = MD.train_boosted(sdf, ["a", "b", "c"], "label", max_iter=10, max_depth=3)
    imp = MD.importances(model, ["a", "b", "c"]).toPandas()
    assert abs(imp.importance.sum() - 100) < 1e-9 and imp.iloc[-1].feature == "c"
    pred = MD.predict(model, sdf).toPandas()
    assert np.allclose(pred.probability.apply(sum), 1.0)
    assert (pred.prediction == y).mean() > 0.8
    assert (pred.probability.apply(np.argmax) == pred.prediction).all()


def test_boosted_treeshap_additive_on_margin(spark):
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(15)
    X = rng.normal(size=(240, 3))
    y = (X[:, 0] > 0.3).astype(int) + (X[:, 1] > 0).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y, id=np.arange(240))
    sdf = spark.createDataFrame(pdf)
    model = MD.train_boosted(sdf, ["a", "b", "c"], "label", max_iter=6, max_depth=3)
    long = EX.explain_boosted(MD.forest(model), sdf.limit(15), "id", ["a", "b", "c"], "label").toPandas()
    sums = long.groupby(["row_key", "class"]).agg(s=("shap_value", "sum"), b=("base_value", "first"),
                                                  m=("margin", "first"))
    assert np.allclose(sums.s + sums.b, sums.m, atol=1e-9)
    raw = model.transform(sdf.limit(15)).select("id", vector_to_array("rawPrediction").alias("r")).toPandas()
    for rec in raw.itertuples():
        for c in range(3):
            assert abs(sums.loc[(str(rec.id), c), "m"] - rec.r[c]) < 1e-9


def test_deep_trees_are_explained(spark):
    """Depth 12, against the Shapley definition."""
    from itertools import combinations
    from math import factorial
    rng = np.random.default_rng(21)
    X = np.round(rng.normal(size=(600, 5)), 2)
    y = ((np.sin(3 * X[:, 0]) + X[:, 1] * X[:, 2] + rng.normal(0, .5, 600)) > 0).astype(int)
    names = list("abcde")
    sdf = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(label=y, id=np.arange(600)))
    model = MD.train_forest(sdf, names, "label", num_trees=2, max_depth=12)
    trees = list(MD.forest(model)._java_obj.trees())
    assert max(t.depth() for t in trees) >= 10
    some = sdf.where("id < 3")
    long = EX.explain(MD.forest(model), some, "id", names, "label").toPandas()

    def value(node):
        stats = [float(v) for v in node.impurityStats().stats()]
        return np.array([v / sum(stats) / len(trees) for v in stats])

    for row in range(3):
        worth = {s: sum(_expected(t.rootNode(), X[row], s, value) for t in trees) for n in range(6) for s in map(frozenset, combinations(range(5), n))}
        for f in range(5):
            want = sum(factorial(len(s)) * factorial(4 - len(s)) / 120 * (worth[s | {f}] - worth[s]) for s in worth if f not in s)
            own = long[(long.row_key == str(row)) & (long.feature_name == names[f])].sort_values("class")
            assert np.allclose(own.shap_value, want, atol=1e-9)
    alone = EX.explain(MD.forest(model), some, "id", names, "label", predicted_only=True).toPandas()
    both = long[long["class"] == long.predicted_class].merge(alone, on=["row_key", "feature_name"])
    assert len(alone) == 15 == len(both) and np.allclose(both.shap_value_x, both.shap_value_y)
    assert EX.explain(MD.forest(model), sdf.where("id < 0"), "id", names).count() == 0


def test_knn_cells_are_found_by_groups():
    # nearest cells and cells within a radius equal those of all bounds, and few cells are bounded
    rng = np.random.default_rng(5)
    low = rng.uniform(0, 100, (900, 3))[np.argsort(rng.uniform(0, 1, 900))]
    low = low[np.lexsort((low[:, 2] // 25, low[:, 1] // 25, low[:, 0] // 25))]
    count = np.where(np.arange(900)[:, None] < 90, rng.integers(0, 6, (900, 3)), 5).astype(float)
    b = KN.Boxes(np.arange(900), low, low + 1, count, np.full(900, 5.0))
    x = rng.uniform(0, 100, (200, 3))
    c = rng.integers(0, 3, 200)
    x[np.arange(200), c] = np.nan
    bound = np.where(b.count[:, c].T > 0, b.bounds(x), np.inf)
    full = np.where(b.count[:, c].T >= 3, bound, np.inf)
    at = KN._nearest(b, x, c, 3)
    assert (full[np.arange(200), at] == full.min(axis=1)).all()
    reach = np.full(200, 30.0)
    met, seen = np.zeros((200, 900), bool), 0
    for rows, cells, d in KN._around(b, x, c, lambda: reach):
        seen += d.size
        met[np.ix_(rows, cells.cell)] = d <= 30.0
    assert (met == (bound <= 30.0)).all() and seen < bound.size / 2
