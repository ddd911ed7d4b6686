"""Column profiling (AGG1-AGG14) and the shared frequency table (design D1).

All per-column statistics of a wide table are computed in a few shared jobs:
one aggregation pass (chunked by ``AGG_CHUNK`` columns) for counts and
moments, and one ``groupBy(column, value)`` over the unpivoted cells for
everything that needs distinct values (cardinality, mode, top/freq).  The
frequency shuffle uses map-side partial aggregation, so hot values are
combined before they leave the task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.numeric import (NUMERIC_TYPES, decimal_places, dtype_category, float_text,
                                        is_integer_like, nan_to_null, to_number)
from wideprep.operators._util import chunks, col, stacked_agg, unpivot


def _fields(df: DataFrame, columns) -> list[T.StructField]:
    by_name = {f.name: f for f in df.schema.fields}
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields]
    return [by_name[c] for c in names]


def present(c: str, dtype) -> "F.Column":
    """A cell counts as filled when it is not NULL and, for floats, not NaN."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col(c).isNotNull() & ~F.isnan(col(c))
    return col(c).isNotNull()


def _types(df: DataFrame) -> dict:
    # one schema read per call: df.schema is a JVM round trip over all fields
    return {f.name: f.dataType for f in df.schema.fields}


# --------------------------------------------------------------------------- AGG1-AGG3

def fill_rate(df: DataFrame, columns=None, decimals: int = 2) -> DataFrame:
    """AGG1: ``position, column, filled, total, percentage`` (0 when the table is empty)."""
    fields = _fields(df, columns)
    types = {f.name: f.dataType for f in fields}
    names = [f.name for f in fields]
    out = stacked_agg(df, names,
                      lambda c: [F.count(F.when(present(c, types[c]), F.lit(1))).alias("filled")],
                      extra=lambda: [F.count(F.lit(1)).alias("total")])
    pct = F.when(F.col("total") > 0, F.round(F.col("filled") * 100.0 / F.col("total"), decimals)) \
        .otherwise(F.lit(0.0))
    return out.select("position", "column", "filled", "total", pct.alias("percentage"))


def missing_report(df: DataFrame, columns=None, top: int | None = None) -> DataFrame:
    """AGG2/SO1: ``column, missing_count, missing_percentage, data_type`` sorted by share desc."""
    cats = {f.name: dtype_category(f.dataType) for f in df.schema.fields}
    rate = fill_rate(df, columns, decimals=12)
    dtype = F.create_map(*[x for k, v in cats.items() for x in (F.lit(k), F.lit(v))])
    out = rate.select(
        "position", "column",
        (F.col("total") - F.col("filled")).alias("missing_count"),
        F.when(F.col("total") > 0, (F.col("total") - F.col("filled")) * 100.0 / F.col("total"))
         .otherwise(F.lit(0.0)).alias("missing_percentage"),
        dtype[F.col("column")].alias("data_type"))
    out = out.orderBy(F.col("missing_percentage").desc(), F.col("position"))
    if top is not None:
        out = out.limit(top)
    return out.drop("position")


def total_missing(df: DataFrame, columns=None) -> DataFrame:
    """AGG3: one row ``total_missing, total_cells`` over the chosen columns."""
    fields = _fields(df, columns)
    names = [f.name for f in fields]
    missing = sum((F.count(F.when(~present(f.name, f.dataType), F.lit(1))) for f in fields), F.lit(0))
    return df.agg(missing.cast("long").alias("total_missing"),
                  (F.count(F.lit(1)) * F.lit(len(names))).cast("long").alias("total_cells"))


# --------------------------------------------------------------------------- D1

def cells(df: DataFrame, columns=None, keep=()) -> DataFrame:
    """Unpivot to long form ``(*keep, column, value string)``, non-missing cells only."""
    fields = _fields(df, columns)
    sel = [col(k) for k in keep]
    for f in fields:
        v = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # NaN is missing; -0.0 and 0.0 are one value (as in pandas)
            v = F.when(v == 0, F.lit(0.0).cast(f.dataType)).otherwise(nan_to_null(v))
        sel.append(v.cast("string").alias(f.name))
    wide = df.select(*sel)
    long = unpivot(wide, list(keep), [f.name for f in fields], "column", "value")
    return long.where(F.col("value").isNotNull())


def frequency_table(df: DataFrame, columns=None) -> DataFrame:
    """D1: ``column, value, n`` for every distinct non-missing value of every column.

    For numeric columns ``num`` holds the typed value (for value-order ties).
    Integral, floating and other columns are grouped on their typed values
    (three narrow scans, Parquet reads each column once) and only the
    distinct values are formatted as text, after the shuffle."""
    fields = _fields(df, columns)
    ints = [f for f in fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    floats = [f for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    rest = [f for f in fields if f not in ints and f not in floats]   # text, dates, decimals (exact text)
    parts = []
    # at most AGG_CHUNK columns per unpivot: bounded projection lists, narrow scans
    typed = [(g, typ) for grp, typ in ((ints, "long"), (floats, "double")) for g in chunks(grp)]
    for group, typ in typed:
        sel = []
        for f in group:
            v = col(f.name).cast(typ)
            if typ == "double":  # NaN is missing; -0.0 and 0.0 are one value (as in pandas)
                v = F.when(v == 0, F.lit(0.0)).otherwise(nan_to_null(v))
            sel.append(v.alias(f.name))
        long = unpivot(df.select(*sel), [], [f.name for f in group], "column", "v").where(F.col("v").isNotNull())
        agg = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        fmt = {f.name: f.dataType for f in group}
        text = float_text(F.col("v")) if typ == "double" else F.col("v").cast("string")
        floats_as_float = [c for c, t in fmt.items() if isinstance(t, T.FloatType)]
        if floats_as_float:  # the shortest text of a float is shorter than that of the double with its value
            text = F.when(F.col("column").isin(floats_as_float), float_text(F.col("v").cast("float"))).otherwise(text)
        parts.append(agg.select("column", text.alias("value"), "n", F.col("v").cast("double").alias("num")))
    for group in chunks(rest):
        freq = cells(df, [f.name for f in group]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        decs = [f.name for f in group if isinstance(f.dataType, T.DecimalType)]
        num = F.when(F.col("column").isin(decs), F.col("value").try_cast("double")) if decs \
            else F.lit(None).cast("double")
        parts.append(freq.withColumn("num", num))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, num double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_stats(df: DataFrame, columns=None, freq: DataFrame | None = None) -> DataFrame:
    """``column, n_unique, precision`` from the frequency table.

    Decimal places depend only on the value, so they are computed once per
    distinct value in long form (one expression for any number of columns)
    instead of per row and per column: float columns by NUM3 on the typed
    value (the text of a double round-trips exactly), integral columns 0,
    others NULL."""
    fields = _fields(df, columns)
    freq = freq if freq is not None else frequency_table(df, [f.name for f in fields])
    floats = [f.name for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    ints = [f.name for f in fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in floats
            and not isinstance(f.dataType, T.DecimalType)]
    decs = {f.name: f.dataType.scale for f in fields if isinstance(f.dataType, T.DecimalType)}
    places = F.lit(None).cast("int")
    if floats:
        places = F.when(F.col("column").isin(floats), decimal_places(F.col("num"), T.DoubleType()))
    if ints:
        places = F.when(F.col("column").isin(ints), F.lit(0)).otherwise(places)
    for c, scale in decs.items():
        places = F.when(F.col("column") == c, F.lit(max(scale, 0))).otherwise(places)
    return freq.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max(places).alias("precision"))


# --------------------------------------------------------------------------- AGG4

def column_profile(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """AGG4/NUM3: ``position, column, mean, std, precision, n_unique``.

    Mean, sample std and precision (max decimal places) for numeric columns,
    NULL for others and for numeric columns without values.  ``n_unique``
    counts distinct non-missing values of every column.  ``approx=True``
    skips the frequency shuffle: ``approx_count_distinct`` (HyperLogLog++, a
    fixed-size sketch) for cardinality and precision from the rows."""
    fields = _fields(df, columns)
    types = {f.name: f.dataType for f in fields}
    if approx:
        return _column_profile_approx(df, types)

    def stats(c):
        t = types[c]
        if isinstance(t, NUMERIC_TYPES):
            v = nan_to_null(col(c).cast("double"))
            return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
        return [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std")]

    moments = stacked_agg(df, list(types), stats)
    uniq = distinct_stats(df, list(types))
    return (moments.join(F.broadcast(uniq), "column", "left")  # one row per column: bounded
            .select("position", "column", "mean", "std", "precision",
                    F.coalesce(F.col("n_unique"), F.lit(0)).cast("long").alias("n_unique")))


def _column_profile_approx(df: DataFrame, types: dict) -> DataFrame:
    def stats(c):
        t = types[c]
        u = F.approx_count_distinct(F.when(present(c, t), col(c))).alias("n_unique")
        if not isinstance(t, NUMERIC_TYPES):
            return [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), u]
        v = nan_to_null(col(c).cast("double"))
        return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), u]

    out = stacked_agg(df, list(types), stats)
    # decimal places in long form: one expression for every float column, a per-task
    # partial max, one row per column shuffled
    floats = [c for c, t in types.items() if isinstance(t, (T.FloatType, T.DoubleType))]
    ints = [c for c, t in types.items() if isinstance(t, NUMERIC_TYPES) and c not in floats]
    prec = None
    if floats:
        long = unpivot(df.select(*[nan_to_null(col(c).cast("double")).alias(c) for c in floats]), [], floats,
                       "column", "v")
        prec = long.groupBy("column").agg(F.max(decimal_places(F.col("v"), T.DoubleType())).alias("precision"))
    if ints:
        has = df.agg(*[F.max(F.when(col(c).isNotNull(), F.lit(0))).alias(f"_i{i}") for i, c in enumerate(ints)])
        ip = has.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_i{i}").alias("precision"))
                                            for i, c in enumerate(ints)])).alias("r")).select("r.*")
        prec = ip if prec is None else prec.unionByName(ip)
    if prec is not None:
        out = out.join(F.broadcast(prec), "column", "left")  # one row per column
    else:
        out = out.withColumn("precision", F.lit(None).cast("int"))
    return out.select("position", "column", "mean", "std", F.col("precision").cast("int"),
                      F.col("n_unique").cast("long"))


# --------------------------------------------------------------------------- AGG5 / AGG12 / PR9

#: Columns parsed as numbers in one scan: their patterns are long, and generated code has a size limit.
TEXT_CHUNK = 24


def numeric_ratio(df: DataFrame, columns=None) -> DataFrame:
    """AGG5/AGG12/NUM1/NUM2/PR9 in one pass per column chunk:
    ``position, column, non_null, numeric, ratio_numeric, int_like, kind``.

    ``numeric`` counts cells passing ``to_number``; ``ratio_numeric`` divides by
    all rows; ``kind`` is ``text`` when any non-missing cell is not a number
    (the reference's text-column rule)."""
    fields = _fields(df, columns)
    types = {f.name: f.dataType for f in fields}

    # numbers are read once per cell, below the aggregates that use them several times
    number = {c: f"_number{i}" for i, c in enumerate(types)}
    read = df.select("*", *[to_number(col(c), types[c]).alias(n) for c, n in number.items()])

    def stats(c):
        n = F.col(number[c])
        return [F.count(F.when(present(c, types[c]), F.lit(1))).alias("non_null"),
                F.count(n).alias("numeric"),
                F.bool_and(F.when(n.isNotNull(), is_integer_like(n))).alias("int_like")]

    out = stacked_agg(read, list(types), stats, extra=lambda: [F.count(F.lit(1)).alias("total")], size=TEXT_CHUNK)
    return out.select(
        "position", "column", "non_null", "numeric",
        F.when(F.col("total") > 0, F.col("numeric") / F.col("total")).otherwise(F.lit(0.0)).alias("ratio_numeric"),
        F.coalesce(F.col("int_like"), F.lit(False)).alias("int_like"),
        F.when(F.col("non_null") > F.col("numeric"), F.lit("text")).otherwise(F.lit("numeric")).alias("kind"))


def numeric_distinct(df: DataFrame, columns=None) -> DataFrame:
    """Distinct count of the coerced numeric values per column (AGG12)."""
    fields = _fields(df, columns)
    sel = [to_number(col(f.name), f.dataType).alias(f.name) for f in fields]
    long = unpivot(df.select(*sel), [], [f.name for f in fields], "column", "v").where(F.col("v").isNotNull())
    return (long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique_numeric")))


def type_profile(df: DataFrame, columns=None) -> DataFrame:
    """AGG5 totals: number of numeric and text columns."""
    per = numeric_ratio(df, columns)
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("n_columns"))


# --------------------------------------------------------------------------- AGG6-AGG8

def describe_object(df: DataFrame, columns=None) -> DataFrame:
    """AGG6: ``column, count, unique, top, freq`` (top: most frequent, ties by smallest text)."""
    freq = frequency_table(df, columns)
    return _mode_from(freq, "string").select("column", "count", "unique", F.col("mode").alias("top"), F.col("mode_count").alias("freq"))


def _mode_from(freq: DataFrame, tie: str) -> DataFrame:
    # one chain: the frequency table is grouped by count first (a near-unique column collapses into one
    # row per count already map-side), then the largest count of each column is picked
    first = F.struct(F.coalesce(F.col("num"), F.lit(0.0)), F.col("value")) if tie == "value" else F.struct("value")
    by_count = freq.groupBy("column", "n").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("ties"))
    return by_count.groupBy("column").agg(
        F.max_by(F.col("first.value"), "n").alias("mode"), F.max("n").alias("mode_count"), F.max_by("ties", "n").alias("tie_count"),
        F.sum(F.col("n") * F.col("ties")).cast("long").alias("count"), F.sum("ties").alias("unique"))


def mode(df: DataFrame, columns=None, tie: str = "string") -> DataFrame:
    """AGG7 (``tie='string'``: ties by smallest text) / AGG8 (``tie='value'``:
    ties by smallest typed value).  Output ``column, mode, mode_count, tie_count``;
    a column without values has no row."""
    fields = _fields(df, columns)
    return _mode_from(frequency_table(df, [f.name for f in fields]), tie).drop("count", "unique")


def mode_values(df: DataFrame, columns=None, tie: str = "string") -> dict:
    """Driver-side dict ``column -> (mode text, tie_count)``; size bounded by #columns."""
    rows = mode(df, columns, tie).collect()
    return {r["column"]: (r["mode"], r["tie_count"]) for r in rows}


# --------------------------------------------------------------------------- AGG10 / AGG13 / AGG14

def group_counts(df: DataFrame, key: str, labels: DataFrame | None = None,
                 label_key: str = "code", label_col: str = "label", on_missing: str = "null") -> DataFrame:
    """AGG10/JN4/TX8/SO5: ``key, n, total`` (+ ``label`` from a code table), sorted by key.

    The label table is a user mapping (one row per code) joined after the
    aggregation, so only #groups rows meet it.  ``on_missing='error'`` raises
    like the reference's dictionary lookup; ``'keep'`` uses the code itself."""
    counts = df.groupBy(col(key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.lit(1).alias("_k"))
    # equi-join with the one-row total (broadcast; its size is one row)
    out = counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    if labels is not None:
        lab = labels.select(F.col(label_key).alias("_code"), F.col(label_col).alias("label"))
        out = out.join(lab, out[key].cast("string") == lab["_code"].cast("string"), "left").drop("_code")
        if on_missing == "keep":
            out = out.withColumn("label", F.coalesce(F.col("label"), col(key).cast("string")))
        elif on_missing == "error":
            missing = out.where(F.col("label").isNull()).select(key).limit(5).collect()
            if missing:
                raise KeyError(f"no label for codes {[r[0] for r in missing]}")
    return out.orderBy(key)


def counter(df: DataFrame, c: str) -> DataFrame:
    """AGG13/AGG14: ``value, n`` counts of a column (methods, decision sources, header rows)."""
    return df.groupBy(col(c).alias(c)).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- AGG11

def sample_per_column(df: DataFrame, key: str, columns=None, n: int = 3, seed: int = 42) -> DataFrame:
    """AGG11: ``column, sample_rank, value``: the ``n`` non-missing cells with the
    smallest ``md5(seed:column:key)`` per column (deterministic, stable under
    repartitioning).  No cell is sorted that cannot be among them: a first pass takes
    the smallest hash of each of ``slots`` parts of a column, in fixed memory, and the n-th
    of these bounds the n smallest of the column.  The ``row_number() <= n`` filter over
    the few cells within the bound is planned as a partial per-task group limit."""
    long = cells(df, [c for c in (columns or df.columns) if c != key], keep=(key,))
    slots = 1 << max(8, (16 * n).bit_length())
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("column"), col(key).cast("string")))
    hashed = long.withColumn("_h", h).withColumn("_lead", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    slot = F.pmod(F.conv(F.substring("_h", 18, 15), 16, 10).cast("long"), F.lit(slots))
    least = hashed.groupBy("column", slot.alias("_slot")).agg(F.min("_lead").alias("_lead"))
    # a column with fewer than n filled parts has no bound
    bounds = least.groupBy("column").agg(F.get(F.sort_array(F.collect_list("_lead")), F.lit(n - 1)).alias("_bound")) \
        .select("column", F.coalesce("_bound", F.lit((1 << 60) - 1)).alias("_bound"))
    near = hashed.join(F.broadcast(bounds), "column").where(F.col("_lead") <= F.col("_bound"))  # one row per column
    w = Window.partitionBy("column").orderBy("_h", col(key))
    return (near.withColumn("sample_rank", F.row_number().over(w).cast("long"))
            .where(F.col("sample_rank") <= n).select("column", "sample_rank", "value"))


def first_values(df: DataFrame, order_by: str, columns=None, n: int = 3) -> DataFrame:
    """AGG11 first ``n`` values per column in ``order_by`` order, padded with ''."""
    names = [c for c in (columns or df.columns) if c != order_by]
    head = df.orderBy(col(order_by)).limit(n)  # top-n: TakeOrderedAndProject
    sel = [col(order_by)] + [col(c).cast("string").alias(c) for c in names]
    long = unpivot(head.select(*sel), [order_by], names, "column", "value")
    w = Window.partitionBy("column").orderBy(col(order_by))
    return long.select("column", F.row_number().over(w).cast("long").alias("rank"),
                       F.coalesce(F.col("value"), F.lit("")).alias("value"))
