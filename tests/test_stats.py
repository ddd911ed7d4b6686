import numpy as np
import pandas as pd

from wideprep.operators import correlate as C
from wideprep.operators import posthoc as H
from wideprep.operators import quantile as Q


def test_exact_median(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 5001).astype(float)           # many ties
    b = rng.normal(size=5001)
    b[::7] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    sdf = spark.createDataFrame(pdf)
    for bits in (16, 8):                                  # four and eight digits
        monkeypatch.setattr(Q, "BITS", bits)
        got = {r["column"]: r["value"] for r in Q.exact_quantiles(sdf, None, (0.5, 0.25, 0.9))
               .where("prob = 0.5").collect()}
        assert np.isclose(got["a"], np.median(a))
        assert np.isclose(got["b"], np.nanmedian(b))
        q = {r["prob"]: r["value"] for r in Q.exact_quantiles(sdf, ["b"], (0.25, 0.9)).collect()}
        assert np.isclose(q[0.25], pdf["b"].quantile(0.25)) and np.isclose(q[0.9], pdf["b"].quantile(0.9))


def test_correlation_methods_match_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(size=400), "z": rng.normal(size=400), "c": 1.5})
    pdf.loc[::5, "x"] = np.nan
    pdf.loc[::7, "y"] = np.nan
    sdf = spark.createDataFrame(pdf)
    want = pdf.corr()
    for block in (500, 2):
        for r in C.correlation_pairs(sdf, block=block).collect():
            w = want.loc[r["feature_1"], r["feature_2"]]
            if np.isnan(w):
                assert r["correlation"] is None
            else:
                assert abs(r["correlation"] - w) < 1e-9


def test_dscf_statistic_against_direct_ranks(spark):
    rng = np.random.default_rng(7)
    g = rng.choice(list("ABCD"), 300)
    v = rng.integers(0, 20, 300).astype(float)            # ties
    pdf = pd.DataFrame({"g": g, "v": v})
    st = {(r["group_1"], r["group_2"]): r for r in H.dscf_statistics(spark.createDataFrame(pdf), "g",
                                                                     n_buckets=3).collect()}
    for (a, b), r in st.items():
        sub = pdf[pdf.g.isin([a, b])].copy()
        sub["r"] = sub.v.rank()
        ni, nj = (sub.g == a).sum(), (sub.g == b).sum()
        ri = sub[sub.g == a].r.sum()
        ui = ni * nj + ni * (ni + 1) / 2 - ri
        u = min(ui, ni * nj - ui)
        t = sub.v.value_counts().to_numpy()
        s = ni + nj
        var = ni * nj / (s * (s - 1)) * ((s ** 3 - s) / 12 - ((t ** 3 - t) / 12).sum())
        q = np.sqrt(2) * abs(u - ni * nj / 2) / np.sqrt(var)
        assert abs(r["q"] - q) < 1e-9 and abs(r["u"] - u) < 1e-9


def test_studentized_range_critical_values():
    for q, k in [(2.772, 2), (3.314, 3), (3.633, 4), (3.858, 5)]:
        assert abs(H.studentized_range_sf(q, k)[0] - 0.05) < 2e-4


def test_posthoc_long_form(spark):
    pdf = pd.DataFrame({"g": list("AAABBBCCC"), "v": [1, 2, 3, 4, 5, 6, 7, 8, 9.0]})
    out = H.posthoc_dscf(spark.createDataFrame(pdf), "g").toPandas()
    assert len(out) == 9                                  # 3 x 3 incl. diagonal
    assert (out[out.group_1 == out.group_2].p_value == 1.0).all()
    m = out.pivot(index="group_1", columns="group_2", values="p_value")
    assert np.allclose(m.to_numpy(), m.to_numpy().T)


def test_missing_group_column_is_an_error(spark):
    import pytest
    with pytest.raises(ValueError):
        H.dscf_statistics(spark.createDataFrame(pd.DataFrame({"v": [1.0]})), "nope")


def test_approx_profile_close_to_exact(spark):
    from wideprep.operators import profile as P
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.integers(0, 300, 3000).astype(float), "s": rng.choice(list("abcdef"), 3000)})
    sdf = spark.createDataFrame(pdf)
    exact = {r["column"]: r for r in P.column_profile(sdf).collect()}
    approx = {r["column"]: r for r in P.column_profile(sdf, approx=True).collect()}
    for c in ("a", "s"):
        assert abs(approx[c]["n_unique"] - exact[c]["n_unique"]) <= 0.05 * exact[c]["n_unique"] + 1
    assert approx["a"]["precision"] == exact["a"]["precision"] == 1
    assert abs(approx["a"]["mean"] - exact["a"]["mean"]) < 1e-9


def test_blocked_moments_equal_single_pass(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 7))
    x[:, 3] = x[:, 0] * 0.5 + rng.normal(size=300)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(7)])
    pdf.loc[::6, "x1"] = np.nan
    pdf.loc[::5, "x3"] = np.nan
    pdf["k"] = 2.0
    sdf = spark.createDataFrame(pdf)
    one = {(r.feature_1, r.feature_2): r for r in C.correlation_pairs(sdf).collect()}
    blk = {(r.feature_1, r.feature_2): r for r in C.correlation_pairs(sdf, block=3).collect()}
    want = pdf.corr()
    assert one.keys() == blk.keys() and len(one) == 28
    for key, r in blk.items():
        assert r.n == one[key].n
        w = want.loc[key[0], key[1]]
        assert (r.correlation is None) if np.isnan(w) else abs(r.correlation - w) < 1e-9


def test_quadrature_converged_for_many_groups():
    import math
    x, w = np.polynomial.legendre.leggauss(4000)
    z, w = 12.0 * x, 12.0 * w
    erf = np.vectorize(math.erf)
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)

    def fine(q, k):
        cdf = 0.5 * (1 + erf(z / math.sqrt(2))) - 0.5 * (1 + erf((z - q) / math.sqrt(2)))
        return 1 - k * np.sum(w * phi * np.clip(cdf, 0, 1) ** (k - 1))

    for q, k in [(1.0, 2), (3.858, 5), (5.0, 20), (7.0, 300)]:
        assert abs(H.studentized_range_sf(q, k)[0] - fine(q, k)) < 1e-12


def test_dscf_with_many_groups_absent_groups_and_small_steps(spark, monkeypatch):
    """Forty groups, some without values in a feature, against direct ranks of every pair."""
    monkeypatch.setattr(H, "CELLS", 100)
    rng = np.random.default_rng(11)
    n = 1500
    pdf = pd.DataFrame({"g": [f"g{x:02d}" for x in rng.integers(0, 40, n)], "a": rng.integers(0, 30, n).astype(float), "b": rng.normal(size=n)})
    pdf.loc[pdf.g < "g03", "b"] = np.nan
    pdf.loc[pdf.g == "g05", "b"] = 1.5
    rows = [tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)]
    got = {(r["feature"], r["group_1"], r["group_2"]): r
           for r in H.dscf_statistics(spark.createDataFrame(rows, "g string, a double, b double"), "g", n_buckets=5).collect()}
    assert len(got) == 2 * 40 * 39 // 2 - 3                 # a pair without any value has no row
    for (f, x, y), r in got.items():
        sub = pdf[pdf.g.isin([x, y]) & pdf[f].notna()]
        ranks, ni, nj = sub[f].rank(), int((sub.g == x).sum()), int((sub.g == y).sum())
        ri = ranks[sub.g == x].sum()
        ui = ni * nj + ni * (ni + 1) / 2 - ri
        t = sub[f].value_counts().to_numpy()
        assert (r["n_1"], r["n_2"], r["k"]) == (ni, nj, 40) and r["rank_sum_1"] == ri and r["u"] == min(ui, ni * nj - ui)
        assert np.isclose(r["ties"], ((t.astype(float) ** 3 - t) / 12).sum())


def test_dscf_of_no_rows(spark):
    empty = spark.createDataFrame([], "g string, a double")
    assert H.dscf_statistics(empty, "g").count() == 0 and H.posthoc_dscf(empty, "g").count() == 0
