"""D2 fills equal pandas on small data for several bucket counts."""

import numpy as np
import pandas as pd
import pytest

from wideprep.operators import ordered as O


def frame(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n).round(3)
    mask = rng.random(n) < 0.45
    mask[:4] = True          # leading gap
    mask[-5:] = True         # trailing gap
    mask[100:160] = True     # a gap longer than a bucket
    vals = [None if m else float(x) for x, m in zip(v, mask)]
    keys = rng.permutation(n) * 3 + 7
    pdf = pd.DataFrame({"k": keys, "g": keys % 3, "v": vals}).sort_values("k").reset_index(drop=True)
    sdf = spark.createDataFrame([(int(a), int(b), c) for a, b, c in pdf[["k", "g", "v"]].itertuples(index=False)],
                                "k long, g long, v double")
    pdf["v"] = pdf["v"].astype("float64")
    return sdf, pdf


def collect(sdf):
    return pd.DataFrame(sdf.select("k", "v").toPandas()).sort_values("k")["v"].to_numpy(dtype="float64")


def close(a, b):
    return np.allclose(a, b, equal_nan=True, atol=1e-12)


@pytest.mark.parametrize("buckets", [1, 4, 23, 150])
@pytest.mark.parametrize("limit", [None, 1, 5, 150])
def test_ffill_bfill(spark, buckets, limit):
    sdf, pdf = frame(spark)
    assert close(collect(O.fill_forward(sdf, ["v"], "k", limit=limit, n_buckets=buckets)),
                 pdf["v"].ffill(limit=limit).to_numpy())
    assert close(collect(O.fill_backward(sdf, ["v"], "k", limit=limit, n_buckets=buckets)),
                 pdf["v"].bfill(limit=limit).to_numpy())


@pytest.mark.parametrize("buckets", [1, 6])
@pytest.mark.parametrize("limit,direction", [(None, None), (2, "forward"), (2, "backward"), (3, "both"),
                                             (None, "both")])
def test_interpolate_linear(spark, buckets, limit, direction):
    sdf, pdf = frame(spark)
    got = collect(O.interpolate(sdf, ["v"], "k", limit=limit, limit_direction=direction, n_buckets=buckets))
    kw = {}
    if limit is not None:
        kw["limit"] = limit
    if direction is not None:
        kw["limit_direction"] = direction
    assert close(got, pdf["v"].interpolate(**kw).to_numpy())


def test_interpolate_index(spark):
    sdf, pdf = frame(spark)
    got = collect(O.interpolate(sdf, ["v"], "k", method="index", n_buckets=5))
    want = pdf.set_index("k")["v"].interpolate(method="index").to_numpy()
    assert close(got, want)


def test_partitioned_ffill(spark):
    sdf, pdf = frame(spark)
    got = collect(O.fill_forward(sdf, ["v"], "k", partition_by=["g"], n_buckets=7))
    want = pdf.groupby("g")["v"].ffill().sort_index().to_numpy()
    assert close(got, want)


def test_positions_and_slices(spark):
    sdf, pdf = frame(spark)
    pos = O.with_positions(sdf, "k", n_buckets=5).toPandas().sort_values("k")
    assert list(pos["position"]) == list(range(1, len(pdf) + 1))
    sl = O.slice_rows(sdf, "k", 3, None).toPandas().sort_values("k")
    assert list(sl["k"]) == list(pdf["k"][3:])
    sl = O.slice_rows(sdf, "k", 10, 20).toPandas().sort_values("k")
    assert list(sl["k"]) == list(pdf["k"][10:20])


def test_running_total_matches_cumsum(spark):
    sdf, pdf = frame(spark)
    out = O.running_total(sdf.withColumn("one", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)),
                          ["g"], "k", "one", "before", n_buckets=6).toPandas().sort_values("k")
    want = pdf.groupby("g").cumcount().to_numpy()
    assert list(out["before"]) == list(want)


def test_tie_break_columns(spark):
    rng = np.random.default_rng(4)
    n = 200
    pdf = pd.DataFrame({"k": rng.integers(0, 20, n), "t": np.arange(n)[::-1], "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.5, "v"] = np.nan
    sdf = spark.createDataFrame([(int(a), int(b), None if np.isnan(c) else float(c)) for a, b, c in
                                 pdf.itertuples(index=False)], "k long, t long, v double")
    got = O.fill_forward(sdf, ["v"], ["k", "t"], n_buckets=5).toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])["v"].ffill()
    assert np.allclose(got["v"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    pos = O.with_positions(sdf, ["k", "t"], n_buckets=5).toPandas().sort_values(["k", "t"])
    assert list(pos["position"]) == list(range(1, n + 1))


def test_text_order_key(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcxyzäé"), rng.integers(1, 9))) + str(i) for i in range(300)]
    v = rng.normal(size=300)
    v[rng.random(300) < 0.4] = np.nan
    pdf = pd.DataFrame({"k": words, "v": v})
    sdf = spark.createDataFrame([(a, None if np.isnan(b) else float(b)) for a, b in pdf.itertuples(index=False)],
                                "k string, v double")
    got = O.fill_forward(sdf, ["v"], "k", n_buckets=7).toPandas().sort_values("k")
    want = pdf.sort_values("k")["v"].ffill()          # Python str order = code points = UTF-8 byte order
    assert list(got["k"]) == list(pdf.sort_values("k")["k"])
    assert np.allclose(got["v"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_buckets_split_long_prefixes_and_ties(spark):
    from pyspark.sql import functions as F
    names = spark.range(20000).select(F.format_string("Customer#%012d", "id").alias("k"))
    ties = spark.range(20000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(7).alias("a"), F.col("id").alias("b"))
    for df, key, n in ((names, "k", 8), (ties, ["a", "b"], 8), (ties, ["a", "b"], 100)):
        bounds = O.bucket_bounds(df, key, n)
        counts = [r["count"] for r in O.with_bucket(df, key, bounds).groupBy("_bkt").count().collect()]
        assert len(counts) == n and max(counts) < 3 * 20000 / n
    got = O.with_positions(ties, ["a", "b"], n_buckets=100).collect()
    assert [r.position for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1, 20001))


def test_bounds_are_data_not_plan(spark, tmp_out):
    """Ten and 3,000 buckets give plans of one size, one exchange of the table, and the same rows."""
    from pyspark.sql import functions as F
    spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v")) \
        .write.parquet(f"{tmp_out}/t")
    df = spark.read.parquet(f"{tmp_out}/t")
    sizes, sums = [], []
    for n in (10, 3000):
        got = O.fill_forward(df, ["v"], "k", n_buckets=n)
        sizes.append(len(got._jdf.queryExecution().optimizedPlan().toString()))
        rows = got.collect()
        sums.append(sum(r.v or 0 for r in rows))
        final = got._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in final and len(rows) == 30_000
    assert abs(sizes[0] - sizes[1]) < 200 and sums[0] == sums[1]
    assert 2900 < len(set(r._bkt for r in O.with_bucket(df, "k", O.bucket_bounds(df, "k", 3000)).select("_bkt").collect())) <= 3000


def test_interpolate_time_between_rows_of_one_time(spark):
    # valid and missing rows at one time: no slope, and no division by zero
    rows = [(0, 10, 1.0), (1, 10, None), (2, 10, 5.0), (3, 15, None), (4, 20, 7.0), (5, 20, None), (6, 30, None), (7, 30, 9.0)]
    df = spark.createDataFrame(rows, "id long, t long, v double").selectExpr("id", "timestamp_seconds(t) AS ts", "v")
    got = {r.id: r.v for r in O.interpolate(df, ["v"], ["ts", "id"], method="time").collect()}
    assert got == {0: 1.0, 1: 5.0, 2: 5.0, 3: 6.0, 4: 7.0, 5: 7.0, 6: 9.0, 7: 9.0}
    want = pd.Series([r[2] for r in rows], index=pd.to_datetime([r[1] for r in rows], unit="s")).interpolate(method="time")
    assert [got[i] for i in range(8)] == want.tolist()
    # a gap beside a row without a time stays, as no slope is known
    df = spark.createDataFrame([(0, None, 1.0), (1, 5, None), (2, 6, 3.0)], "id long, t long, v double").selectExpr("id", "timestamp_seconds(t) AS ts", "v")
    assert [r.v for r in O.interpolate(df, ["v"], ["ts", "id"], method="time").orderBy("id").collect()] == [1.0, None, 3.0]
