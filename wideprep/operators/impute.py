"""Imputation (IM1-IM4, IM8-IM11, IM13).

Statistics are computed for all columns together (one aggregation job, one
frequency-table job, one exact-median job when needed), brought to the
driver as one small row per column, and every column is filled in a single
``select`` - no per-column loop of jobs.  Ordered fills (ffill, bfill,
interpolation) share one ``OrderedFrame`` (design D2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.numeric import INTEGRAL_TYPES, NUMERIC_TYPES, dtype_category, nan_to_null
from wideprep.operators import ordered as O
from wideprep.operators import profile as P
from wideprep.operators import quantile as Q
from wideprep.operators._util import col, stacked_agg
from wideprep.plans import fill as FP


def _types(df):
    return {f.name: f.dataType for f in df.schema.fields}


def _missing(c: str, t) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def _fill_const(c: str, t, value, widen: bool = False) -> Column:
    """``widen``: a mean or median of an integer column is a double, and so is the filled column."""
    widen = widen and isinstance(t, INTEGRAL_TYPES)
    if widen:
        return F.coalesce(col(c).cast("double"), F.lit(value).cast("double")).alias(c)
    if value is None:
        return col(c)
    lit = F.lit(value).cast(t) if not isinstance(value, str) or isinstance(t, T.StringType) \
        else F.lit(value).try_cast(t)
    return F.when(_missing(c, t), lit).otherwise(col(c)).alias(c)


def _apply(df: DataFrame, values: dict, widen=()) -> DataFrame:
    types = _types(df)
    return df.select(*[_fill_const(c, types[c], values[c], c in widen) if c in values else col(c) for c in df.columns])


def means(df: DataFrame, columns) -> dict:
    types = _types(df)
    row = df.agg(*[F.avg(nan_to_null(col(c).cast("double"))).alias(c) for c in columns
                   if isinstance(types[c], NUMERIC_TYPES)]).first()
    return {k: v for k, v in row.asDict().items()} if row else {}


def medians(df: DataFrame, columns) -> dict:
    return {r["column"]: r["median"] for r in Q.median(df, columns).collect()}


def impute_mean(df: DataFrame, columns) -> DataFrame:
    """IM1: numeric columns only; an all-missing column keeps its gaps.  Integer columns become double."""
    found = means(df, columns)
    return _apply(df, found, found)


def impute_median(df: DataFrame, columns) -> DataFrame:
    """IM2 (exact median, see ``quantile``).  Integer columns become double."""
    found = medians(df, columns)
    return _apply(df, found, found)


def impute_mode(df: DataFrame, columns, tie: str = "string") -> DataFrame:
    """IM3: any type; ``tie='string'`` (AGG7) or ``'value'`` (AGG8)."""
    modes = P.mode_values(df, columns, tie)
    return _apply(df, {c: v for c, (v, _) in modes.items()})


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    """IM4."""
    return _apply(df, values)


def drop_rows(df: DataFrame, columns) -> DataFrame:
    """IM13: drop rows with a missing value in any of ``columns`` (explicit opt-in)."""
    types = _types(df)
    cond = None
    for c in columns:
        m = _missing(c, types[c])
        cond = m if cond is None else (cond | m)
    return df.where(~cond) if cond is not None else df


# --------------------------------------------------------------------------- profile for the plan

def fill_facts(df: DataFrame, order_by: str | None, columns=None, config=None) -> list[FP.ColumnFacts]:
    """One aggregation job (missing counts, order facts, moments, precision),
    one frequency-table job (distinct counts, modes) and, only if some column
    needs it, one exact-median job."""
    types = _types(df)
    names = list(columns or df.columns)
    # raw order-key values (numbers, datetimes and text all compare the same on the driver)
    key = O._order(order_by)[1][0] if order_by else None

    def stats(c):
        t = types[c]
        miss = _missing(c, t)
        out = [F.count(F.when(miss, 1)).alias("missing")]
        if key is not None:
            out += [F.min(F.when(~miss, key)).alias("first_val"), F.max(F.when(miss, key)).alias("last_gap"),
                    F.min(F.when(miss, key)).alias("first_gap"), F.max(F.when(~miss, key)).alias("last_val")]
        else:
            out += [F.lit(None).cast("double").alias(x) for x in ("first_val", "last_gap", "first_gap", "last_val")]
        if isinstance(t, NUMERIC_TYPES):
            v = nan_to_null(col(c).cast("double"))
            out += [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
        else:
            out += [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std")]
        return out

    prof = stacked_agg(df, names, stats, extra=lambda: [F.count(F.lit(1)).alias("rows")]).collect()
    # distinct counts and modes from one frequency table, in one job - only for
    # columns with gaps (a complete column is left unchanged whatever its stats,
    # so near-unique keys never enter the shuffle)
    gappy = [r["column"] for r in prof if r["missing"] > 0]
    per = []
    if gappy:
        freq = P.frequency_table(df, gappy)
        per = P.distinct_stats(df, gappy, freq).join(P._mode_from(freq, "string"), "column", "left").collect()
    uniq = {r["column"]: r["n_unique"] for r in per}
    prec = {r["column"]: r["precision"] for r in per}
    modes = {r["column"]: (r["mode"], r["tie_count"]) for r in per if r["mode"] is not None}
    facts = []
    for r in prof:
        c = r["column"]
        f = FP.ColumnFacts(
            name=c, dtype=dtype_category(types[c]), missing=r["missing"], rows=r["rows"],
            has_value=r["missing"] < r["rows"],
            ffill_reduces=(r["first_val"] is not None and r["last_gap"] is not None
                           and r["first_val"] < r["last_gap"]),
            bfill_reduces=(r["first_gap"] is not None and r["last_val"] is not None
                           and r["first_gap"] < r["last_val"]),
            n_unique=uniq.get(c, 0) if isinstance(types[c], NUMERIC_TYPES) else None,
            std=r["std"], precision=prec.get(c), mean=r["mean"])
        if c in modes:
            f.mode, f.mode_ties = modes[c]
        facts.append(f)
    return facts


def _decide_all(df, facts, config, strict, order_by) -> list[FP.Decision]:
    decisions = [FP.decide(f, config, strict) for f in facts]
    need_median = [d.column for d in decisions if d.method == FP.MEDIAN]
    if need_median:
        med = medians(df, need_median)
        for d in decisions:
            if d.method == FP.MEDIAN:
                d.params["constant_value"] = med.get(d.column)
    if not order_by and any(d.method in (FP.FFILL, FP.BFILL, FP.INTERPOLATE) for d in decisions):
        raise ValueError("ordered fills need order_by")
    return decisions


def execute_plan(df: DataFrame, decisions: list[FP.Decision], order_by: str | None = None,
                 partition_by=(), n_buckets=None) -> DataFrame:
    """Apply all decisions in one ``select`` (plus one ordered frame if needed)."""
    types = _types(df)
    ordered = [d for d in decisions if d.method in (FP.FFILL, FP.BFILL, FP.INTERPOLATE)]
    exprs: dict[str, Column] = {}
    source = df
    if ordered:
        of = O.OrderedFrame(df, order_by, [d.column for d in ordered], partition_by, n_buckets)
        source = of.frame
        pos = F.col("_pos")
        for d in ordered:
            c, t = d.column, types[d.column]
            limit = d.params.get("limit")
            if d.method == FP.FFILL:
                p = of.prev(c)
                ok = p.isNotNull() if limit is None else (pos - p["p"] <= limit)
                exprs[c] = F.when(_missing(c, t) & ok, p["v"]).otherwise(col(c))
            elif d.method == FP.BFILL:
                n = of.next(c)
                ok = n.isNotNull() if limit is None else (n["p"] - pos <= limit)
                exprs[c] = F.when(_missing(c, t) & ok, n["v"]).otherwise(col(c))
            else:
                exprs[c] = O.interpolated(of, c, t, d.params.get("interpolation_method", "linear"), d.params.get("limit"),
                                          d.params.get("limit_direction") or "forward")
    for d in decisions:
        if d.method in (FP.MEAN, FP.MEDIAN, FP.MODE, FP.CONSTANT):
            exprs[d.column] = _fill_const(d.column, types[d.column], d.params.get("constant_value"),
                                          d.method in (FP.MEAN, FP.MEDIAN))
    return source.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])


def apply_filling(df: DataFrame, config: dict | None = None, order_by: str | None = None, columns=None,
                  strict: bool = True, partition_by=(), n_buckets=None):
    """IM10: returns ``(filled, log, summary)``.

    ``log``: ``column, method, params, missing_before, missing_after, dtype,
    fallback, reason``; ``summary``: ``metric, value`` rows with the totals
    and the method distribution (AGG3, AGG13)."""
    spark = df.sparkSession
    facts = fill_facts(df, order_by, columns, config)
    decisions = _decide_all(df, facts, config, strict, order_by)
    filled = execute_plan(df, decisions, order_by, partition_by, n_buckets)
    types = _types(df)
    names = [d.column for d in decisions]
    before = {f.name: f.missing for f in facts}
    # a constant fill (mean, median, mode, constant with a value) leaves no gap and
    # "unchanged" keeps its count; only ordered fills need counting on the result
    after = {}
    for d in decisions:
        if d.method in (FP.MEAN, FP.MEDIAN, FP.MODE, FP.CONSTANT) and d.params.get("constant_value") is not None:
            after[d.column] = 0
        elif d.method in (FP.UNCHANGED, FP.DROP_ROWS):
            after[d.column] = before[d.column]
    pending = [c for c in names if c not in after]
    if pending:
        after.update({r["column"]: r["total"] - r["filled"] for r in P.fill_rate(filled, pending).collect()})
    rows = [(d.column, d.method, FP.params_text(d.params), int(before[d.column]), int(after[d.column]),
             dtype_category(types[d.column]), bool(d.fallback), d.reason) for d in decisions]
    log = spark.createDataFrame(rows, "column string, method string, params string, missing_before long, "
                                      "missing_after long, dtype string, fallback boolean, reason string")
    counts: dict[str, int] = {}
    for d in decisions:
        counts[d.method] = counts.get(d.method, 0) + 1
    summary_rows = [("total_missing_before", str(sum(before.values()))),
                    ("total_missing_after", str(sum(after.values()))),
                    ("columns_processed", str(len(decisions)))]
    summary_rows += [(f"method:{m}", str(counts[m])) for m in sorted(counts)]
    summary = spark.createDataFrame(summary_rows, "metric string, value string")
    return filled, log, summary


# --------------------------------------------------------------------------- IM11

def impute_policy(df: DataFrame, rules: list[tuple], default_numeric: tuple | None = ("median", 30.0),
                  key: str | None = None, k: int = 3) -> DataFrame:
    """IM11: ordered rules ``(columns, method, bound)``.

    ``median`` / ``mean`` / ``mode`` rules fill a column named first by a rule
    when its missing share (percent, on the input) is below ``bound``; all such
    fills happen in one ``select``.  A ``knn`` rule then imputes its columns
    that exist together (``operators.knn``, keyed by ``key``) when there are
    more than one and the least filled has more than ``bound`` percent filled.
    Finally ``default_numeric`` fills every other numeric column whose missing
    share on the result so far lies strictly between 0 and its bound, with the
    statistic of that result."""
    from wideprep.operators.knn import impute_knn
    types = _types(df)
    rate = {r["column"]: (r["total"] - r["filled"], r["total"]) for r in P.fill_rate(df).collect()}
    share = {c: (m * 100.0 / t if t else 0.0) for c, (m, t) in rate.items()}
    chosen: dict[str, str] = {}
    knn_groups = []
    for cols, method, bound in rules:
        if method == "knn":
            knn_groups.append(([c for c in cols if c in types], bound))
            continue
        for c in cols:
            if c in types and c not in chosen and share[c] < bound:
                chosen[c] = method
    wide = lambda methods: [c for c, m in methods.items() if m in ("mean", "median")]
    out = _apply(df, _statistics(df, chosen), wide(chosen))
    for cols, bound in knn_groups:
        if len(cols) > 1:
            if key is None:
                raise ValueError("a knn rule needs the row key")
            filled = {r["column"]: r["percentage"] for r in P.fill_rate(out, cols, decimals=12).collect()}
            if min(filled.values()) > bound:
                out = impute_knn(out, key, cols, k=k)
                chosen.update({c: "knn" for c in cols})
    if default_numeric is not None:
        method, bound = default_numeric
        now = {r["column"]: r["total"] - r["filled"] for r in P.fill_rate(out).collect()}
        rows = next(iter(rate.values()))[1] if rate else 0
        rest = {c: method for c, t in types.items() if c not in chosen and isinstance(t, NUMERIC_TYPES)
                and 0 < now[c] < rows * bound / 100.0}
        out = _apply(out, _statistics(out, rest), wide(rest))
    return out


def _statistics(df: DataFrame, chosen: dict) -> dict:
    by_method: dict[str, list] = {}
    for c, m in chosen.items():
        by_method.setdefault(m, []).append(c)
    values: dict = {}
    if by_method.get("median"):
        values.update(medians(df, by_method["median"]))
    if by_method.get("mean"):
        values.update(means(df, by_method["mean"]))
    if by_method.get("mode"):
        values.update({c: v for c, (v, _) in P.mode_values(df, by_method["mode"], "value").items()})
    return values


def base_methods(df: DataFrame, config: dict | None = None, columns=None) -> DataFrame:
    """IM9/JN1 as a table: ``column, n_unique, std, precision, rows, method``.

    The column list is left-joined to the profile by name (both tables have
    one row per column: broadcast); a column without a profile row, or with
    incomplete stats, gets ``mode``; a configured override wins."""
    names = list(columns or df.columns)
    spark = df.sparkSession
    prof = P.column_profile(df, names)
    rows = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    cols = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "position int, column string")
    overrides = (config or {}).get("methods") or {}
    ov = spark.createDataFrame([(k, v) for k, v in overrides.items() if v in FP.METHODS] or [("", "")],
                               "column string, override string")
    joined = cols.join(F.broadcast(prof.drop("position")), "column", "left") \
        .join(F.broadcast(ov), "column", "left")
    numeric_rule = ((F.col("n_unique") < F.lit(FP.UNIQUE_SHARE * rows)) & (F.col("std") > F.lit(FP.MIN_STD))
                    & (F.col("precision") > F.lit(FP.MIN_PRECISION)))
    method = F.when(F.col("override").isNotNull(), F.col("override")) \
        .when(F.coalesce(numeric_rule, F.lit(False)), F.lit(FP.MEAN)).otherwise(F.lit(FP.MODE))
    return joined.select("position", "column", "n_unique", "std", "precision", F.lit(rows).cast("long").alias("rows"),
                         method.alias("method"))
