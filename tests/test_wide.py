"""A 300-column table: profiles and the fill plan stay a handful of jobs and compile."""

import numpy as np
import pandas as pd

from wideprep.operators import impute as I
from wideprep.operators import ordered as O
from wideprep.operators import profile as P


def wide_frame(spark, n_cols=300, n_rows=400):
    rng = np.random.default_rng(9)
    data = {"id": np.arange(n_rows)}
    for j in range(n_cols):
        v = rng.normal(size=n_rows).round(2)
        v[rng.random(n_rows) < (j % 10) / 20] = np.nan
        data[f"c{j}.x y"] = v                 # names with a dot and a space
    return spark.createDataFrame(pd.DataFrame(data)), pd.DataFrame(data)


def test_wide_fill_rate_and_profile(spark):
    sdf, pdf = wide_frame(spark)
    rate = {r["column"]: r["filled"] for r in P.fill_rate(sdf).collect()}
    assert all(rate[c] == pdf[c].notna().sum() for c in pdf.columns)
    prof = {r["column"]: r for r in P.column_profile(sdf).collect()}
    for c in list(pdf.columns)[1:20]:
        assert abs(prof[c]["mean"] - pdf[c].mean()) < 1e-9
        assert prof[c]["n_unique"] == pdf[c].nunique()


def test_wide_ordered_fill(spark):
    sdf, pdf = wide_frame(spark, n_cols=60)
    cols = [c for c in pdf.columns if c != "id"]
    got = O.fill_forward(sdf, cols, "id", n_buckets=4).toPandas().sort_values("id")
    assert np.allclose(got[cols].to_numpy(dtype=float), pdf[cols].ffill().to_numpy(), equal_nan=True)


def test_wide_apply_filling(spark):
    sdf, pdf = wide_frame(spark, n_cols=80)
    filled, log, summary = I.apply_filling(sdf, order_by="id")
    assert log.count() == 81
    s = {r["metric"]: r["value"] for r in summary.collect()}
    assert s["total_missing_after"] == "0"


def test_wide_approx_profile(spark):
    sdf, pdf = wide_frame(spark)
    prof = {r["column"]: r for r in P.column_profile(sdf, approx=True).collect()}
    assert len(prof) == 301
    for c in list(pdf.columns)[1:10]:
        assert prof[c]["precision"] == 2 or pdf[c].dropna().round(1).eq(pdf[c].dropna()).all()
        assert abs(prof[c]["n_unique"] - pdf[c].nunique()) <= 0.1 * pdf[c].nunique() + 2
    assert prof["id"]["precision"] == 0
