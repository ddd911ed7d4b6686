"""Pearson correlation over pairwise-complete rows (ST1, ST1b, SE2-SE4, SO3; design D3).

pandas ``DataFrame.corr`` uses, for every pair of columns, only the rows
where both are present.  With k columns that is k(k-1)/2 masked statistics.

One ``mapInPandas`` pass keeps six k x k moment matrices per task (masked
matrix products on a mean-shifted block), emits them once per task as
``(i, j, ...)`` rows, and one ``groupBy(i, j).sum`` - the only shuffle, k^2/2
keys - combines them.  The data never leaves its task; what moves is O(k^2)
numbers per task.  Beyond ``MOMENT_BLOCK`` columns the columns are blocked: one
narrow pass per block pair keeps task memory at six block x block matrices.

A constant column (zero spread within the pair's rows) gives NULL, never an
error; fewer than two common rows gives NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.numeric import to_number
from wideprep.operators._util import chunks, col, union_all
from wideprep.session import checkpoint_dir

# a spread below this share of the column's magnitude counts as zero
CONSTANT_TOLERANCE = 1e-12


def _clamp(r):
    """Keep rounding noise inside [-1, 1]; NULL stays NULL (``greatest`` skips NULLs)."""
    return F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def numeric_view(df: DataFrame, columns=None) -> tuple[DataFrame, list[str]]:
    """NUM1 coercion of the chosen columns to double (unparseable -> NULL)."""
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[to_number(col(c), types[c]).alias(c) for c in names]), names


MOMENT_BLOCK = 500   # columns per block: a task holds 6 block x block matrices


def _pairs_moments(num: DataFrame, names: list[str], block: int = MOMENT_BLOCK) -> DataFrame:
    import numpy as np
    k = len(names)
    means = {}
    for part in chunks(list(enumerate(names)), 200):   # one narrow job per 200 columns
        row = num.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in part]).first()
        means.update({i: row[f"m{i}"] for i, _ in part})
    shift = np.array([means[i] if means[i] is not None else 0.0 for i in range(k)])
    spark = num.sparkSession
    bshift = spark.sparkContext.broadcast(shift)  # k numbers
    blocks = [list(range(a, min(a + block, k))) for a in range(0, k, block)]

    def moments_for(ia, ja):
        same = ia == ja
        cols = ia if same else ia + ja
        na = len(ia)

        def moments(batches):
            import pandas as pd
            s = bshift.value[cols]
            acc = None
            for pdf in batches:
                x = pdf.to_numpy(dtype="float64", na_value=np.nan)
                m = (~np.isnan(x)).astype("float64")
                x0 = np.where(m > 0, x - s, 0.0)
                x2 = x0 * x0
                if same:
                    a_m, a_x, a_x2, b_m, b_x, b_x2 = m, x0, x2, m, x0, x2
                else:
                    a_m, a_x, a_x2 = m[:, :na], x0[:, :na], x2[:, :na]
                    b_m, b_x, b_x2 = m[:, na:], x0[:, na:], x2[:, na:]
                # pair (i, j): x = column i, y = column j, both restricted to common rows
                part = (a_m.T @ b_m, a_x.T @ b_m, a_m.T @ b_x, a_x2.T @ b_m, a_m.T @ b_x2, a_x.T @ b_x)
                acc = part if acc is None else tuple(u + v for u, v in zip(acc, part))
            if acc is None:
                return
            if same:
                iu, ju = np.triu_indices(na, 1)
            else:
                iu, ju = np.meshgrid(np.arange(na), np.arange(len(ja)), indexing="ij")
                iu, ju = iu.ravel(), ju.ravel()
            n, sx, sy, sxx, syy, sxy = (a[iu, ju] for a in acc)
            gi, gj = np.asarray(ia)[iu], np.asarray(ja)[ju]
            yield pd.DataFrame({"i": gi, "j": gj, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sxy})

        return moments, cols

    schema = "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = []
    for bi in range(len(blocks)):
        for bj in range(bi, len(blocks)):
            fn, cols = moments_for(blocks[bi], blocks[bj])
            # each block pair reads only its own columns
            parts.append(num.select(*[col(names[c]).alias(f"c{c}") for c in cols]).mapInPandas(fn, schema))
    per_task = union_all(parts)
    tot = per_task.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cxy = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    # spread relative to the magnitude of the (unshifted) values
    shift_arr = F.array(*[F.lit(float(v)) for v in shift])
    mag_x = F.greatest(F.lit(1.0), F.abs(F.col("sx") / F.col("n") + shift_arr[F.col("i").cast("int")]))
    mag_y = F.greatest(F.lit(1.0), F.abs(F.col("sy") / F.col("n") + shift_arr[F.col("j").cast("int")]))
    sdx = F.sqrt(F.greatest(vx, F.lit(0.0))) / F.col("n")
    sdy = F.sqrt(F.greatest(vy, F.lit(0.0))) / F.col("n")
    ok = (F.col("n") >= 2) & (sdx > F.lit(CONSTANT_TOLERANCE) * mag_x) & (sdy > F.lit(CONSTANT_TOLERANCE) * mag_y)
    r = F.when(ok, cxy / (F.sqrt(vx) * F.sqrt(vy)))
    return tot.select("i", "j", F.col("n").cast("long").alias("n"),
                      _clamp(r).alias("correlation"))


def correlation_pairs(df: DataFrame, columns=None, block: int = MOMENT_BLOCK) -> DataFrame:
    """ST1/SE2: ``feature_1, feature_2, n, correlation`` for every unordered pair,
    ``feature_1`` the earlier column.  More than ``block`` columns are split into
    blocks: one pass per block pair."""
    num, names = numeric_view(df, columns)
    pairs = _pairs_moments(num, names, block)
    name_arr = F.array(*[F.lit(n) for n in names])
    return pairs.select(name_arr[F.col("i").cast("int")].alias("feature_1"),
                        name_arr[F.col("j").cast("int")].alias("feature_2"), "n", "correlation")


def ranked_pairs(df: DataFrame, columns=None) -> DataFrame:
    """ST1b/SO3: unique pairs with ``rank`` by absolute correlation, undefined
    last, ties by feature names.  The pair table is written once (k(k-1)/2 rows); its rank
    comes from the distributed position plan (12.5 million pairs at 5,000 columns never sort in one task)."""
    from wideprep.operators.ordered import with_positions
    checkpoint_dir(df.sparkSession)
    pairs = correlation_pairs(df, columns)
    keyed = pairs.withColumn("_key", F.coalesce(-F.abs("correlation"), F.lit(2.0))).checkpoint()  # |r| <= 1; NULL last
    ranked = with_positions(keyed, ["_key", "feature_1", "feature_2"], name="rank")
    return ranked.drop("_key")


def correlation_matrix(df: DataFrame, columns=None, decimals: int | None = 2) -> DataFrame:
    """SE3/SE4: square matrix ``feature`` x one column per feature (mirrored,
    diagonal 1 when the column has any spread)."""
    num, names = numeric_view(df, columns)
    pairs = correlation_pairs(num, names)
    both = pairs.select("feature_1", "feature_2", "correlation").unionByName(
        pairs.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation"))
    spread = num.agg(*[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(names)])
    diag = spread.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"),
                 F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("correlation"))
        for i, c in enumerate(names)])).alias("d")).select("d.*")
    long = both.unionByName(diag)
    if decimals is not None:
        long = long.withColumn("correlation", F.round("correlation", decimals))
    wide = long.groupBy(F.col("feature_1").alias("feature")).pivot("feature_2", names).agg(F.first("correlation"))
    return wide
