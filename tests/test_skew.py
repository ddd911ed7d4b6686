"""One key holding a third of all rows: results stay right and the hot key is split."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wideprep.operators import knn as KN
from wideprep.operators import ordered as O
from wideprep.operators import posthoc as H
from wideprep.operators import profile as P
from wideprep.plans import header as HD


def hot_events(spark, n=900):
    rng = np.random.default_rng(21)
    user = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 50, n))     # user 0 holds a third
    v = rng.normal(size=n).round(3)
    v[rng.random(n) < 0.4] = np.nan
    pdf = pd.DataFrame({"k": np.arange(n) * 2 + 1, "u": user, "v": v})
    sdf = spark.createDataFrame([(int(a), int(b), None if np.isnan(c) else float(c))
                                 for a, b, c in pdf.itertuples(index=False)], "k long, u long, v double")
    return sdf, pdf


def test_hot_partition_key_is_split_over_buckets(spark):
    sdf, pdf = hot_events(spark)
    of = O.OrderedFrame(sdf, "k", ["v"], partition_by=["u"], n_buckets=8)
    assert of.frame.where("u = 0").select("_bkt").distinct().count() == 8
    got = O.fill_forward(sdf, ["v"], "k", partition_by=["u"], n_buckets=8).toPandas().sort_values("k")
    want = pdf.sort_values("k").groupby("u")["v"].ffill()
    assert np.allclose(got["v"].to_numpy(dtype=float), want.sort_index().to_numpy(), equal_nan=True)


def test_running_total_hot_segment(spark):
    sdf, pdf = hot_events(spark)
    out = O.running_total(sdf.withColumn("one", F.lit(1)), ["u"], "k", "one", "before", n_buckets=6)
    got = out.toPandas().sort_values("k")["before"].to_numpy()
    assert list(got) == list(pdf.sort_values("k").groupby("u").cumcount().to_numpy())


def test_posthoc_with_hot_group_and_value(spark):
    rng = np.random.default_rng(5)
    n = 600
    g = np.where(np.arange(n) % 3 == 0, "A", rng.choice(list("BCD"), n))
    v = np.where(np.arange(n) % 4 == 0, 7.0, rng.integers(0, 30, n).astype(float))   # a hot value
    pdf = pd.DataFrame({"g": g, "v": v})
    st = {(r["group_1"], r["group_2"]): r for r in H.dscf_statistics(spark.createDataFrame(pdf), "g",
                                                                     n_buckets=5).collect()}
    for (a, b), r in st.items():
        sub = pdf[pdf.g.isin([a, b])].copy()
        sub["r"] = sub.v.rank()
        ni, nj = (sub.g == a).sum(), (sub.g == b).sum()
        ui = ni * nj + ni * (ni + 1) / 2 - sub[sub.g == a].r.sum()
        assert abs(r["u"] - min(ui, ni * nj - ui)) < 1e-9


def test_knn_identical_coordinates(spark):
    rng = np.random.default_rng(3)
    n = 300
    a = np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(size=n) * 3)
    b = np.where(np.arange(n) % 3 == 0, 1.0, rng.normal(size=n))
    c = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c})
    pdf.loc[pdf.index % 7 == 2, "c"] = np.nan
    from test_knn_explain import brute_knn
    got = KN.impute_knn(spark.createDataFrame(pdf), "id", ["a", "b", "c"], k=3).toPandas().sort_values("id")
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), brute_knn(pdf, ["a", "b", "c"]), atol=1e-9)


def test_dedupe_hot_name(spark):
    rows = [(i, "same" if i % 3 == 0 else f"n{i % 17}") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, name string")
    out = HD.dedupe_names(df, "name", "i", n_buckets=6).toPandas()
    assert out["name"].is_unique
    assert out.set_index("i").loc[3, "name"] == "same_2"


def test_mode_hot_value_and_partial_topk_plan(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "i int, s string")
    m = P.mode(df, ["s"]).first()
    assert (m["mode"], m["mode_count"], m["tie_count"]) == ("hot", 300, 1)
    sample = P.sample_per_column(df, "i", ["s"], n=3)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sample_sorts_only_the_cells_near_the_smallest_hashes(spark):
    import hashlib
    df = spark.range(0, 20_000, 1, 2).selectExpr("id AS i", "concat('v', id) AS s", "CASE WHEN id < 2 THEN 'x' END AS few")
    sample = P.sample_per_column(df, "i", n=3)
    got = {(r["column"], r["sample_rank"]): r["value"] for r in sample.collect()}
    by = lambda c, ids: sorted(ids, key=lambda i: hashlib.md5(f"42:{c}:{i}".encode()).hexdigest())[:3]
    assert got == {**{("s", k + 1): f"v{i}" for k, i in enumerate(by("s", range(20_000)))}, ("few", 1): "x", ("few", 2): "x"}
    # the sorted cells are those within the bound
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert "_lead" in plan[plan.index("WindowGroupLimit"):] and "_bound" in plan[plan.index("WindowGroupLimit"):]
