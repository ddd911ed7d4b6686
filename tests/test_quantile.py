"""Selection by digits: keys order like their doubles, ranks are exact on odd values, hot values and many columns."""

import math
import random
import struct

import numpy as np

from wideprep.operators import quantile as Q


def test_keys_are_the_bits_and_keep_the_order(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1.0, 2.0, 4.0, 8.0, 1024.0]
    values += [2.0 ** e for e in range(-1074, 1024, 37)] + [math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 41)]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(500)]
    values = [v for v in values if v == v]
    got = Q.with_key(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.key == (bits if r.v >= 0 else -bits)
        assert Q.key_value(r.key) == r.v
    by = sorted(got, key=lambda r: r.v)
    assert all(a.key <= b.key for a, b in zip(by, by[1:]))


def test_quantiles_of_odd_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 4000
    cols = {"hot": np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(size=n)), "wide": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
            "close": 1 + np.arange(n) * 2.0 ** -52, "one": np.full(n, -2.5), "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.integers(-3, 3, n)),
            "ends": np.where(np.arange(n) % 2 == 0, -np.inf, np.inf), "none": np.full(n, np.nan)}
    names = list(cols)
    df = spark.createDataFrame([[float(x) for x in row] for row in np.stack([cols[c] for c in names], axis=1)], ", ".join(f"{c} double" for c in names)).repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    got = {(r["column"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, None, probs).collect()}
    monkeypatch.setattr(Q, "BITS", 8)                  # bins stay fuller than a list may be long: all digits are read
    assert str(sorted(got.items())) == str(sorted({(r["column"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, None, probs).collect()}.items()))
    assert {c for c, _ in got} == set(names) - {"none"}
    for c in names[:-2]:
        v = cols[c][~np.isnan(cols[c])]
        want = np.sort(v)
        for p in probs:
            r = p * (len(v) - 1)
            k = math.floor(r)
            low, high = want[k], want[min(k + 1, len(v) - 1)]
            assert got[(c, p)] == (low if r == k else low + (r - k) * (high - low))
    assert got[("ends", 0.0)] == -math.inf and got[("ends", 1.0)] == math.inf


def test_median_of_300_columns_and_of_no_rows(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 300))
    df = spark.createDataFrame(data.tolist(), ", ".join(f"c{i} double" for i in range(300)))
    got = {r["column"]: r["median"] for r in Q.median(df).collect()}
    assert all(np.isclose(got[f"c{i}"], np.median(data[:, i]), rtol=1e-15) for i in range(300))
    assert Q.exact_quantiles(df.limit(0)).count() == 0


def test_cells_are_counted_within_arrow_batches(spark):
    # 40,000 cells of few digits leave the scan as a few counts a batch, not as rows
    df = spark.range(0, 40_000, 1, 2).selectExpr("CAST(1 + id % 7 AS DOUBLE) AS a", "IF(id % 2 = 0, -0.0D, double('nan')) AS b", "CAST(NULL AS DOUBLE) AS c")
    rows = Q._counts(Q.numeric_wide(df), None, 64, 48).collect()
    assert len(rows) < 100 and {(c, sum(r.n for r in rows if r["column"] == c)) for c in "abc"} == {("a", 40_000), ("b", 20_000), ("c", 0)}
    low = next(r.key >> 48 for r in rows if r["column"] == "a")
    rows = Q._counts(Q.numeric_wide(df), {"a": [low]}, 48, 0).collect()
    assert rows and {(r["column"], r.prefix, r.key >> 48) for r in rows} == {("a", low, low)}
