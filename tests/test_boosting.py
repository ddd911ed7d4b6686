"""Multiclass boosting against a plain loop, the forest's log loss and additivity."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wideprep.operators import boosting as B
from wideprep.operators import explain as EX
from wideprep.operators import model as MD


def _table(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = (x[:, 0] > 0.2).astype(int) + (x[:, 1] * x[:, 2] > 0).astype(int)
    x[::17, 3] = np.nan
    return x, y, spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(label=y, id=np.arange(n))).repartition(3)


def _plain(x, y, rounds, depth, step, penalty, least, edges):
    """Greedy trees by trying every feature and edge at every node."""
    n = y.max() + 1
    margins = np.tile(np.log((np.bincount(y) + 0.5) / (len(y) + 0.5 * n)), (len(y), 1))
    score = lambda g, h: g ** 2 / (h + penalty)
    for _ in range(rounds):
        p = B.softmax(margins)
        new = margins.copy()
        for c in range(n):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
            todo = [(np.arange(len(y)), depth)]
            while todo:
                rows, left = todo.pop()
                best = (1e-12, None, None)
                for f in range(x.shape[1]) if left else ():
                    for t in edges[f]:
                        go = x[rows, f] <= t
                        a, b = rows[go], rows[~go]
                        if h[a].sum() < least or h[b].sum() < least:
                            continue
                        gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[rows].sum(), h[rows].sum())
                        if gain > best[0] + 1e-9:
                            best = (gain, a, b)
                if best[1] is None:
                    new[rows, c] -= step * (n - 1) / n * g[rows].sum() / (h[rows].sum() + penalty)
                else:
                    todo += [(best[1], left - 1), (best[2], left - 1)]
        margins = new
    return margins


def test_margins_match_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(B, "HISTOGRAM_BYTES", 4096)         # several jobs a level
    x, y, df = _table(spark)
    model = B.train_softmax(df, list("abcd"), "label", rounds=3, max_depth=3, max_bins=8)
    got = {r["id"]: r for r in B.predict_softmax(model, df, keep=("id",)).collect()}
    want = _plain(x, y, 3, 3, 0.1, 1.0, 1e-3, model.edges)
    assert np.allclose([got[i]["margin"] for i in range(len(y))], want, atol=1e-8)
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["probability"])) for r in got.values())


def test_held_out_log_loss_is_below_the_forest_s(spark):
    df = _table(spark, 900, 9)[2].na.fill(0.0)             # the forest takes no NaN
    train, test = df.where("id < 600"), df.where("id >= 600")
    loss = lambda out: np.mean([-np.log(max(r["probability"][r["label"]], 1e-9)) for r in out.select("label", "probability").collect()])
    model = B.train_softmax(train, list("abcd"), "label", rounds=25, max_depth=3, step_size=0.3)
    forest = MD.train_forest(train, list("abcd"), "label")
    assert loss(B.predict_softmax(model, test, keep=("label",))) < loss(MD.predict(forest, test, keep=("label",)))
    imp = {r["feature"]: r["importance"] for r in B.importances_softmax(model, spark).collect()}
    assert abs(sum(imp.values()) - 100) < 1e-9 and min(imp, key=imp.get) == "d"


def test_explanations_add_up_to_the_margins(spark):
    _, _, df = _table(spark)
    model = B.train_softmax(df, list("abcd"), "label", rounds=4, max_depth=4)
    some = df.where("id < 40")
    long = EX.explain_boosted(model, some, "id", list("abcd"), "label")
    sums = {(int(r["row_key"]), r["class"]): r["m"] for r in long.groupBy("row_key", "class").agg((F.sum("shap_value") + F.first("base_value")).alias("m")).collect()}
    for r in B.predict_softmax(model, some, keep=("id",)).collect():
        assert np.allclose([sums[(r["id"], c)] for c in range(3)], r["margin"], atol=1e-9)


def test_odd_tables(spark):
    schema = "x double, label int"
    one = B.train_softmax(spark.createDataFrame([(1.0, 0), (None, 0), (float("nan"), None)], schema), ["x"], "label", rounds=2)
    assert [r["probability"] for r in B.predict_softmax(one, spark.createDataFrame([(None, 0)], schema)).collect()] == [[1.0]]
    flat = B.train_softmax(spark.createDataFrame([(None, i % 3) for i in range(9)], schema), ["x"], "label", rounds=2)
    assert len(B.predict_softmax(flat, spark.createDataFrame([], schema)).collect()) == 0
    got = B.predict_softmax(flat, spark.createDataFrame([(5.0, 1)], schema)).first()["probability"]
    assert np.allclose(got, 1 / 3)
    for bad in ([], [(1.0, -1)]):
        try:
            B.train_softmax(spark.createDataFrame(bad, schema), ["x"], "label", rounds=1)
            raise AssertionError("no error")
        except ValueError:
            pass
