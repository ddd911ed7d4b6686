"""Property tests (hypothesis): D2 equals pandas for random data, bucket
counts and limits; results do not depend on the input partitioning."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wideprep.operators import ordered as O
from wideprep.operators import profile as P

values = st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 2))),
                  min_size=1, max_size=60)
common = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, vals, parts=3):
    rows = [(i * 3 + 1, v) for i, v in enumerate(vals)]
    sdf = spark.createDataFrame(rows, "k long, v double").repartition(parts)
    pdf = pd.DataFrame(rows, columns=["k", "v"]).astype({"v": "float64"})
    return sdf, pdf


def got(sdf):
    return sdf.toPandas().sort_values("k")["v"].to_numpy(dtype="float64")


@common
@given(vals=values, buckets=st.integers(1, 9), limit=st.one_of(st.none(), st.integers(1, 5)),
       parts=st.integers(1, 5))
def test_fills_equal_pandas(spark, vals, buckets, limit, parts):
    sdf, pdf = frame(spark, vals, parts)
    assert np.allclose(got(O.fill_forward(sdf, ["v"], "k", limit=limit, n_buckets=buckets)),
                       pdf["v"].ffill(limit=limit).to_numpy(), equal_nan=True)
    assert np.allclose(got(O.fill_backward(sdf, ["v"], "k", limit=limit, n_buckets=buckets)),
                       pdf["v"].bfill(limit=limit).to_numpy(), equal_nan=True)


@common
@given(vals=values, buckets=st.integers(1, 9), direction=st.sampled_from(["forward", "backward", "both"]),
       limit=st.one_of(st.none(), st.integers(1, 4)))
def test_interpolation_equals_pandas(spark, vals, buckets, direction, limit):
    sdf, pdf = frame(spark, vals)
    kw = {"limit_direction": direction}
    if limit is not None:
        kw["limit"] = limit
    want = pdf["v"].interpolate(**kw).to_numpy()
    assert np.allclose(got(O.interpolate(sdf, ["v"], "k", n_buckets=buckets, **kw)), want, equal_nan=True)


@common
@given(vals=values, parts=st.integers(1, 6))
def test_profile_invariant_to_partitioning(spark, vals, parts):
    a, _ = frame(spark, vals, 1)
    b, _ = frame(spark, vals, parts)
    pa = sorted((r["column"], r["n_unique"], r["precision"]) for r in P.column_profile(a).collect())
    pb = sorted((r["column"], r["n_unique"], r["precision"]) for r in P.column_profile(b).collect())
    assert pa == pb


from wideprep.functions import text as _TX  # noqa: E402

# every character the normaliser treats specially, plus a few plain ones
ALPHABET = ("abZß'\"- " + _TX.QUOTE_CHARS + _TX.DASH_CHARS + _TX.NBSP_CHARS + _TX.ZERO_WIDTH_CHARS
            + _TX.WHITESPACE_CHARS)


@common
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=20))
def test_normalisation_equals_python_twin(spark, texts):
    from wideprep.functions import text as TX
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r["i"]: (r["n"], r["k"], r["n2"]) for r in df.select(
        "i", TX.normalize_text("s").alias("n"), TX.match_key("s").alias("k"),
        TX.normalize_name("s").alias("n2")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (TX.py_normalize_text(t), TX.py_match_key(t), TX.py_normalize_text(t, False)), repr(t)
