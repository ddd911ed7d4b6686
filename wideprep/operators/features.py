"""Feature engineering (ML1-ML4): scaling, one-hot encoding, long feature
matrix, deterministic hash split.

Fitted parameters (means, spreads, category dictionaries) are small - one row
per column, one row per (column, category) - and come from one job each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideprep.functions.numeric import to_number
from wideprep.operators._util import col, union_all, unpivot
from wideprep.session import checkpoint_dir

MISSING_CATEGORY = "nan"


def fit_standard(df: DataFrame, columns) -> dict:
    """ML1 fit: population mean and std per column (missing ignored); a zero
    spread scales by 1."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(columns):
        v = to_number(col(c), types[c])
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def standardize(df: DataFrame, columns, params: dict | None = None) -> DataFrame:
    """ML1: ``(x - mean) / std_pop``; missing stays missing."""
    params = params or fit_standard(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    sel = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            sel.append(((to_number(col(c), types[c]) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            sel.append(col(c))
    return df.select(*sel)


def category_text(c) -> "F.Column":
    return F.coalesce(col(c).cast("string"), F.lit(MISSING_CATEGORY))


def fit_categories(df: DataFrame, columns) -> DataFrame:
    """ML2 fit: the dictionary ``column, category, n``; missing is the category
    ``nan``.  One ``groupBy`` over the unpivoted cells (map-side combined);
    categories sort as text wherever an order is needed."""
    long = unpivot(df.select(*[category_text(c).alias(c) for c in columns]), [], list(columns), "column", "category")
    return long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))


def onehot_long(df: DataFrame, key: str, columns, dictionary: DataFrame | None = None) -> DataFrame:
    """ML2 in sparse long form: ``key, feature, value`` with one 1.0 per row and
    column (``cat__<column>_<category>``); a category not in a given dictionary
    gives no entry (all zeros)."""
    long = unpivot(df.select(col(key), *[category_text(c).alias(c) for c in columns]), [key], list(columns),
                   "column", "category")
    # without a dictionary every category of the table is in it: nothing to look up
    hit = long if dictionary is None else long.join(dictionary, ["column", "category"], "left_semi")
    return hit.select(col(key), F.concat(F.lit("cat__"), F.col("column"), F.lit("_"), F.col("category")).alias("feature"),
                      F.lit(1.0).alias("value"))


def feature_matrix_long(df: DataFrame, key: str, numeric, categorical, scale_params: dict | None = None,
                        dictionary: DataFrame | None = None) -> DataFrame:
    """ML3: ``key, feature, value`` with ``num__<col>`` scaled values first and
    one-hot entries after; other columns are dropped."""
    scaled = standardize(df.select(col(key), *[col(c) for c in numeric]), numeric, scale_params)
    num = unpivot(scaled, [key], list(numeric), "column", "value") \
        .select(col(key), F.concat(F.lit("num__"), F.col("column")).alias("feature"), "value")
    parts = [num]
    if categorical:
        parts.append(onehot_long(df, key, categorical, dictionary))
    return union_all(parts)


#: Bits of the key's hash in an exact split, and those that one count refines.
HASH_BITS = 60
LEVEL_BITS = 12
#: Strata up to which their table is broadcast; beyond, rows are shuffled to it.
MAX_BROADCAST = 50_000


def hash_bucket(key, seed: int = 42) -> "F.Column":
    """Stable pseudo-random number in [0, 10000) from a row key."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), 1, 8)
    return F.conv(h, 16, 10).cast("long") % 10000


def split_hash(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, exact: bool = False,
               stratify: str | None = None) -> DataFrame:
    """ML4: adds ``split`` = ``test`` / ``train`` from a hash of the row key:
    deterministic, stable under repartitioning and task retries (unlike
    ``randomSplit``), no shuffle.  ``exact=True`` makes the test part exactly
    ``ceil(test_share * n)`` rows (as the reference's splitter): the rows with the smallest
    60-bit hashes of the key.  The hash of the last of them is found by ``hash_limits``, and
    every row is then compared with it where it lies.  ``stratify`` (with ``exact``) names a column;
    the share then holds within each of its values.

    Keys must be unique; rows that share the key at the limit (or null keys there) would all be train or, where that
    comes nearer to the share, all test."""
    if not exact:
        return df.withColumn("split", F.when(hash_bucket(key, seed) < int(round(test_share * 10000)),
                                             F.lit("test")).otherwise(F.lit("train")))
    h = F.coalesce(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))
    stratum = F.coalesce(F.concat(F.lit("0"), col(stratify).cast("string")), F.lit("1")) if stratify else F.lit("")
    hashed = df.withColumn("_h", h).withColumn("_g", stratum)
    limits = hash_limits(hashed.select("_g", "_h"), test_share)
    if stratify:
        limit, joined = F.col("_limit"), hashed.join(_small(limits), "_g")
    else:
        row = limits.first()                                   # one stratum, none without rows
        limit, joined = F.lit(row["_limit"] if row else 0), hashed
    return joined.select(*[col(c) for c in df.columns], F.when(F.col("_h") < limit, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table of one row per stratum, marked for broadcast if it has at most ``MAX_BROADCAST`` rows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def hash_limits(hashed: DataFrame, share: float) -> DataFrame:
    """``_g, _limit``: per stratum ``_g``, the hash under which ``ceil(share * n)`` of its rows' hashes ``_h`` (60 bits) lie.

    Rows are counted by stratum and leading 12 bits of the hash, running sums name the bin in which the last row falls, and only that bin
    is counted again, 12 bits finer: five counts with partial sums, no shuffle of rows and no sort.  A stratum has at most 4,096 bins
    a level, whatever its rows; strata are rows of a table, so there may be any number of them."""
    checkpoint_dir(hashed.sparkSession)
    hashed = hashed.checkpoint()                               # two narrow columns; the input is computed once
    total = hashed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    # the share is rounded to 9 decimals first: 0.2 * 15 is a little more than 3 in doubles
    open_ = total.select("_g", F.ceil(F.round(F.lit(float(share)) * F.col("n"), 9)).cast("long").alias("want"), F.lit(0).cast("long").alias("prefix")).checkpoint()
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = hashed.join(_small(open_), "_g").where(F.shiftright("_h", shift + LEVEL_BITS) == F.col("prefix"))
        bins = inside.groupBy("_g", "want", F.shiftright("_h", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the bin of the last wanted row; a stratum that wants none keeps its first bin, and no row
        edge = bins.withColumn("before", before).where((F.greatest("want", F.lit(1)) > F.col("before")) & (F.greatest("want", F.lit(1)) <= F.col("before") + F.col("n")))
        open_ = edge.select("_g", (F.col("want") - F.col("before")).alias("want"), F.col("bin").alias("prefix"), "n").checkpoint()
    return open_.select("_g", (F.col("prefix") + (2 * F.col("want") >= F.col("n")).cast("long") * (F.col("want") > 0).cast("long")).alias("_limit")).checkpoint()
