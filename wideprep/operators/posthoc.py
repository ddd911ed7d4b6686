"""Steel-Dwass / Dwass-Steel-Critchlow-Fligner all-pairs test (ST2, design D4).

For every numeric feature and every pair of groups (i, j) of ``group_col``:
average ranks within the pair's pooled values (ties averaged), rank sum,
``U = min(U_i, U_j)``, the tie-corrected variance and
``q = sqrt(2) * |U - n_i n_j / 2| / sqrt(var)``; the p-value is the upper
tail of the studentized range with k groups and infinite degrees of freedom.

No raw rank is ever computed and no value meets a pair of groups as a row.  Values are
reduced to a histogram ``(feature, value, group) -> count`` (map-side
combined) in range buckets of the value.  With the group counts below a
bucket as a vector, the vectors below its values are one cumulative sum of the rows
of counts ``c``, and two matrix products give all pairs at once:
``c' (below + c / 2)`` counts the value pairs in which j lies below i (that is
the rank sum less ``n_i (n_i + 1) / 2``), and ``(c c)' c`` gives the tie
terms, since ``(c_i + c_j)**3`` is a sum of such products.  The k x k sums of
the buckets are added by feature and pair.  Only the final
(features x pairs) table meets the p-value quadrature.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideprep.functions.numeric import NUMERIC_TYPES, nan_to_null
from wideprep.functions.text import significance_label
from wideprep.operators._util import col, unpivot
from wideprep.operators.ordered import bucket_bounds, with_bucket
from wideprep.session import checkpoint_dir

ALPHA = 0.05
# Gauss-Legendre nodes for the studentized-range integral over z in [-8, 8]
QUADRATURE_POINTS = 200
CELLS = 1 << 20              # values x groups of a step
STATISTICS = ("feature string, group_1 string, group_2 string, n_1 long, n_2 long, rank_sum_1 double, u double, ties double, "
              "k long, q double")


def studentized_range_sf(q, k: int):
    """Upper tail P(Q > q) of the studentized range, k means, df = infinity:
    ``1 - k * Int phi(z) (Phi(z) - Phi(z - q))^(k-1) dz``."""
    import numpy as np
    x, w = np.polynomial.legendre.leggauss(QUADRATURE_POINTS)
    z = 8.0 * x
    w = 8.0 * w
    erf = np.frompyfunc(math.erf, 1, 1)

    def Phi(v):
        return 0.5 * (1.0 + erf(v / math.sqrt(2.0)).astype("float64"))

    phi = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    q = np.atleast_1d(np.asarray(q, dtype="float64"))
    out = np.empty_like(q)
    base = Phi(z)
    for idx, qq in enumerate(q):
        if not np.isfinite(qq):
            out[idx] = np.nan
            continue
        inner = np.clip(base - Phi(z - qq), 0.0, 1.0) ** (k - 1)
        cdf = k * np.sum(w * phi * inner)
        out[idx] = min(1.0, max(0.0, 1.0 - cdf))
    return out


def dscf_statistics(df: DataFrame, group_col: str, features=None, n_buckets=None) -> DataFrame:
    """``feature, group_1, group_2, n_1, n_2, rank_sum_1, u, ties, k, q`` for every
    feature and group pair with ``group_1 < group_2``."""
    if group_col not in df.columns:
        raise ValueError(f"group column {group_col!r} not found; columns: {df.columns}")
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = [c for c in (features or df.columns) if c != group_col and isinstance(types[c], NUMERIC_TYPES)]
    g = col(group_col).cast("string")
    sel = [g.alias("_g")] + [nan_to_null(col(c).cast("double")).alias(c) for c in feats]
    long = (df.where(col(group_col).isNotNull()).select(*sel)
            .transform(lambda w: unpivot(w, ["_g"], feats, "feature", "v")).where(F.col("v").isNotNull()))
    hist = long.groupBy("feature", "_g", "v").agg(F.count(F.lit(1)).alias("c"))
    # k = groups present in the group column (all rows, as in the reference); the result has k(k-1)/2 rows a feature
    names = sorted(r["_g"] for r in df.where(col(group_col).isNotNull()).select(g.alias("_g")).distinct().collect())
    k, spark = len(names), df.sparkSession
    if not names or not feats:
        return spark.createDataFrame([], STATISTICS)
    checkpoint_dir(spark)
    index = spark.createDataFrame(list(zip(names, range(k))), "_g string, i int")
    hist = hist.join(F.broadcast(index), "_g").select("feature", "v", "i", "c").checkpoint()
    rows = with_bucket(hist, "v", bucket_bounds(hist, "v", n_buckets))
    # group counts below each bucket: a running sum over the buckets for every feature and group
    totals = rows.groupBy("feature", "_bkt", "i").agg(F.sum("c").alias("c"))
    dense = totals.groupBy("feature", "_bkt").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m")) \
        .select("feature", "_bkt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "m") \
        .select("feature", "_bkt", "i", F.coalesce(F.element_at("m", F.col("i")), F.lit(0)).alias("c"))
    earlier = Window.partitionBy("feature", "i").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    below = dense.select("feature", "_bkt", "i", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("below"))
    keys = ["feature", "_bkt"]
    sums = rows.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInPandas(_pair_sums(k), "feature string, i int, j int, above double, cubes double") \
        .groupBy("feature", "i", "j").agg(F.sum("above").alias("above"), F.sum("cubes").alias("cubes"))
    pairs = sums.where("i <> j").groupBy("feature", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        F.sum(F.when(F.col("i") < F.col("j"), F.col("above"))).alias("above"), F.sum("cubes").alias("mixed"))
    own = totals.groupBy("feature", "i").agg(F.sum("c").alias("n")) \
        .join(sums.where("i = j").select("feature", "i", "cubes"), ["feature", "i"]) \
        .groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "cubes")))).alias("own"))
    # the pairs of a feature come from its one row of k group counts
    every = own.select("feature", "own", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")) \
        .select("feature", "own", "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j > F.col("i"))).alias("j"))
    of = lambda x, field: F.coalesce(F.element_at("own", F.col(x))[field], F.lit(0)).cast("double")
    every = every.select("feature", "i", "j", of("i", "n").alias("ni"), of("j", "n").alias("nj"), (of("i", "cubes") + of("j", "cubes")).alias("cubes")) \
        .where(F.col("ni") + F.col("nj") > 0)
    st = every.join(pairs, ["feature", "i", "j"], "left").fillna(0.0, ["above", "mixed"])
    ni, nj, above = F.col("ni"), F.col("nj"), F.col("above")
    s = ni + nj
    ties = (F.col("cubes") + 3.0 * F.col("mixed") - s) / 12.0
    u = F.least(ni * nj - above, above)
    var = F.when(s > 1, (ni * nj / (s * (s - 1.0))) * ((s * s * s - s) / 12.0 - ties))
    q = F.when(var > 0, F.sqrt(F.lit(2.0)) * F.abs(u - ni * nj / 2.0) / F.sqrt(var))
    group = lambda x: F.get(F.lit(names), F.col(x))
    return st.select("feature", group("i").alias("group_1"), group("j").alias("group_2"), ni.cast("long").alias("n_1"), nj.cast("long").alias("n_2"),
                     (ni * (ni + 1) / 2.0 + above).alias("rank_sum_1"), u.alias("u"), ties.alias("ties"), F.lit(k).cast("long").alias("k"), q.alias("q"))


def _pair_sums(k: int):
    """For the histogram rows of one feature and range bucket (``v, i, c``) and the group counts below it: for groups i and j the number of
    pairs with j's value below i's, ties half, and the sum over values of ``c_i**2 * c_j``."""
    import numpy as np
    import pandas as pd

    def run(left, right):
        out = {"feature": [], "i": [], "j": [], "above": [], "cubes": []}
        if len(left):
            below = np.zeros(k)
            below[right["i"].to_numpy()] = right["below"].to_numpy()
            v, i, c = left["v"].to_numpy(), left["i"].to_numpy(), left["c"].to_numpy().astype(float)
            values, at = np.unique(v, return_inverse=True)
            order = np.argsort(at, kind="stable")
            at, i, c = at[order], i[order], c[order]
            above, cubes = np.zeros((k, k)), np.zeros((k, k))
            step = max(1, CELLS // k)
            for lo in range(0, len(values), step):
                a, b = np.searchsorted(at, [lo, lo + step])
                counts = np.zeros((min(step, len(values) - lo), k))
                counts[at[a:b] - lo, i[a:b]] = c[a:b]
                run_ = below + np.cumsum(counts, axis=0)
                above += counts.T @ (run_ - counts / 2)
                cubes += (counts * counts).T @ counts
                below = run_[-1]
            x, y = np.nonzero((above != 0) | (cubes != 0))
            out = {"feature": left["feature"].iloc[0], "i": x.astype(np.int32), "j": y.astype(np.int32), "above": above[x, y], "cubes": cubes[x, y]}
        return pd.DataFrame(out)

    return run


def posthoc_dscf(df: DataFrame, group_col: str, features=None, alpha: float = ALPHA,
                 labels=("yes", "no"), n_buckets=None) -> DataFrame:
    """ST2/SE1: ``group_1, group_2, p_value, feature, significant``: both
    directions and the diagonal (p = 1), as the reference's stacked square
    matrix, for all features at once (one long result, no per-feature loop)."""
    st = dscf_statistics(df, group_col, features, n_buckets)

    def pvalues(batches):
        for pdf in batches:
            kk = int(pdf["k"].iloc[0]) if len(pdf) else 2
            pdf = pdf.assign(p_value=studentized_range_sf(pdf["q"].fillna(float("nan")).to_numpy(), kk))
            yield pdf[["feature", "group_1", "group_2", "p_value"]]

    # (features x pairs) rows: a handful of Arrow batches
    pv = st.select("feature", "group_1", "group_2", "q", "k").mapInPandas(
        pvalues, "feature string, group_1 string, group_2 string, p_value double")
    pv = pv.withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))
    both = pv.unionByName(pv.select("feature", F.col("group_2").alias("group_1"),
                                    F.col("group_1").alias("group_2"), "p_value"))
    gs = df.where(col(group_col).isNotNull()).select(col(group_col).cast("string").alias("group_1")).distinct()
    feats = st.select("feature").distinct()
    # features x groups: the feature list (bounded by the schema) is broadcast,
    # the groups stay distributed
    diag = gs.withColumn("_k", F.lit(1)).join(F.broadcast(feats.withColumn("_k", F.lit(1))), "_k").drop("_k")
    diag = diag.select("feature", "group_1", F.col("group_1").alias("group_2"), F.lit(1.0).alias("p_value"))
    out = both.unionByName(diag)
    return out.select("group_1", "group_2", "p_value", "feature",
                      significance_label("p_value", alpha, *labels).alias("significant"))


def dscf_table(df: DataFrame, group_col: str, features=None, alpha: float = ALPHA, labels=("yes", "no"),
               n_buckets=None) -> DataFrame:
    """Statistics and p-value per feature and pair ``group_1 < group_2``."""
    st = dscf_statistics(df, group_col, features, n_buckets)

    def pvalues(batches):
        for pdf in batches:
            if len(pdf):
                kk = int(pdf["k"].iloc[0])
                pdf = pdf.assign(p_value=studentized_range_sf(pdf["q"].astype("float64").to_numpy(), kk))
            else:
                pdf = pdf.assign(p_value=[])
            yield pdf

    schema = ("feature string, group_1 string, group_2 string, n_1 long, n_2 long, rank_sum_1 double, "
              "u double, ties double, k long, q double, p_value double")
    out = st.mapInPandas(pvalues, schema)
    out = out.withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))
    return out.withColumn("significant", significance_label("p_value", alpha, *labels))
