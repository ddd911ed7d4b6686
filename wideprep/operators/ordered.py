"""Order-dependent operators without a single-partition window (design D2).

pandas works on positional row order; Spark has none, so each operator takes
an explicit ``order_by`` - a unique key, or a list whose first column is the
key and whose other columns break its ties - and optional ``partition_by``
columns.  A window with no ``partitionBy`` would pull the whole table into
one task, and a hot partition key would do the same for its rows.  Instead:

1. Range buckets of the whole order key, ties included: bounds are read off a
   sample of about ``SAMPLE_PER_BUCKET`` keys per bucket by Spark's range
   partitioner and compared as structs, so texts with a long common prefix and
   bursts of equal first keys are split like any other.  The bounds are data
   (one checkpointed row), not part of the plan: it has the same size for ten
   buckets and for 100,000.
2. One window per ``(partition_by, bucket)`` ordered by the key gives the local
   position and, per column, the nearest non-missing value (with position)
   before and after each row inside the bucket.
3. A per-bucket summary (row count, first and last non-missing value with
   position) is tiny; running sums / carries over it give each bucket's
   global offset and the values carried in from earlier / later buckets.  It is
   computed from the same exchanged rows as step 2 (Spark reuses the exchange).
4. The summary is joined back on ``(partition_by, bucket)`` (broadcast when no
   ``partition_by`` and ``B`` is below 100k rows, which only changes the plan)
   and every fill is a plain expression.

Hot partition keys are split across buckets, so no group meets in one task.
Serves IM5 (ffill/bfill with ``limit``), IM6 (interpolation), positions and
PR13 (row slices).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.numeric import INTEGRAL_TYPES
from wideprep.operators._util import col
from wideprep.session import checkpoint_dir, shuffle_partitions

ROWS_PER_BUCKET = 2_000_000
MIN_ROWS_PER_BUCKET = 1_000


def _order(order_by) -> tuple[str, list]:
    """``order_by`` is a column name, or a list: the first column is the (bucketed)
    order key, the others break its ties inside the windows."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return cols[0], [col(c) for c in cols]


def _key_numeric(df: DataFrame, order_by) -> Column:
    """The order key as a number (the x of interpolation by key); NULL for text."""
    order_by = _order(order_by)[0]
    t = df.schema[order_by].dataType
    c = col(order_by)
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(t, T.StringType):
        return F.lit(None).cast("double")
    return c.cast("double")


SAMPLE_PER_BUCKET = 30
SAMPLE_LEAST = 100_000
SUMMARY_BROADCAST_ROWS = 100_000
BUCKETS_PER_TASK = 64       # buckets whose bounds one task reads off its range of the sample


class Bounds:
    """The sorted bounds of about ``n_buckets`` range buckets: one row with one array, written to the checkpoint folder.  A
    plan refers to it by a scalar subquery, so its size does not depend on the number of buckets."""

    def __init__(self, array: DataFrame | None = None, n_buckets: int = 1):
        self.array, self.n_buckets = array, n_buckets


def with_bucket(df: DataFrame, order_by, bounds: Bounds, out: str = "_bkt") -> DataFrame:
    """Add a monotone range-bucket id ``out`` of the order key: how many bounds are below it, by binary search."""
    if bounds.array is None:
        return df.withColumn(out, F.lit(0))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_order(order_by)[1])])
    steps = [1 << i for i in reversed(range((2 * bounds.n_buckets).bit_length()))]      # a sample may be longer than expected
    # beyond the last bound ``get`` gives null, which is below no key
    search = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) < F.col("_bkt_key"), at + step).otherwise(at))
    return df.select("*", bounds.array.scalar().alias("_bounds")).withColumn("_bkt_key", key) \
        .withColumn(out, F.coalesce(search, F.lit(0))).drop("_bounds", "_bkt_key")      # never null: joins on it add no filter


def bucket_bounds(df: DataFrame, order_by, n_buckets: int | None = None) -> Bounds:
    """Bounds of ``B`` about equal range buckets of the order key: ``B`` (given, or max(shuffle partitions, rows /
    ROWS_PER_BUCKET)) quantiles of a sample of about ``SAMPLE_PER_BUCKET`` keys per bucket.  Reads the key columns only.

    Spark's range partitioner sorts the sample; every task picks each so-many-th key of its range.  Keys meet
    in one row only as the B - 1 bounds."""
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(_order(order_by)[1])])
    n = keys.count()
    if n_buckets is None:
        n_buckets = max(shuffle_partitions(df.sparkSession), math.ceil(n / ROWS_PER_BUCKET))
        n_buckets = min(n_buckets, max(1, math.ceil(n / MIN_ROWS_PER_BUCKET)))  # small tables: few buckets
    if n_buckets <= 1 or not n:
        return Bounds()
    checkpoint_dir(df.sparkSession)
    share = min(1.0, max(SAMPLE_LEAST, SAMPLE_PER_BUCKET * n_buckets) / n)
    sample = keys if share == 1.0 else keys.sample(share, seed=7)
    every = math.ceil(n * share / n_buckets)
    tasks = max(1, min(shuffle_partitions(df.sparkSession), n_buckets // BUCKETS_PER_TASK))
    ranged = sample.repartitionByRange(tasks, *keys.columns).withColumn("_part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*keys.columns))
    picked = ranged.withColumn("_nth", nth).where(F.col("_nth") % every == 0).agg(F.collect_set(F.struct(*keys.columns)).alias("bounds"))
    return Bounds(picked.select(F.sort_array("bounds").alias("bounds")).checkpoint(), n_buckets)


class OrderedFrame:
    """Rows with ``_pos`` (1-based position within ``partition_by``) and, for
    each requested column, the previous / next non-missing value with its
    position.  Build once, derive several fills from it."""

    def __init__(self, df: DataFrame, order_by: str, columns=(), partition_by=(), n_buckets=None,
                 need_prev=True, need_next=True):
        self.order_by = order_by
        self.partition_by = list(partition_by or [])
        self.columns = list(columns)
        bounds = bucket_bounds(df, order_by, n_buckets)
        key = _key_numeric(df, order_by)
        types = {f.name: f.dataType for f in df.schema.fields}
        # one never-null struct for the partition keys: joins on it add no filter of their own, so both
        # uses of the exchanged rows keep the same plan
        base = with_bucket(df, order_by, bounds).withColumn("_x", key.cast("double")) \
            .withColumn("_seg", F.struct(*[col(p).alias(f"p{i}") for i, p in enumerate(self.partition_by)] or [F.lit(0).alias("p")]))
        seg = [F.col("_seg"), F.col("_bkt")]
        order_cols = _order(order_by)[1]
        w = Window.partitionBy(*seg).orderBy(*order_cols)
        wp = w.rowsBetween(Window.unboundedPreceding, 0)
        # "next value" = last value of the descending order: a running frame is
        # incremental, while a frame ending at unboundedFollowing is recomputed per row
        wn = Window.partitionBy(*seg).orderBy(*[c.desc() for c in order_cols]) \
            .rowsBetween(Window.unboundedPreceding, 0)
        framed = base.withColumn("_lpos", F.row_number().over(w))
        items = [F.when(col(c).isNotNull() & ~self._is_nan(types[c], c),
                        F.struct(F.col("_lpos").alias("p"), F.col("_x").alias("x"), col(c).alias("v")))
                 for c in self.columns]
        # one projection per window order (not a withColumn chain: wide tables stay shallow)
        if need_prev and items:
            framed = framed.select("*", *[F.last(it, ignorenulls=True).over(wp).alias(f"_p{i}")
                                          for i, it in enumerate(items)])
        if need_next and items:
            framed = framed.select("*", *[F.last(it, ignorenulls=True).over(wn).alias(f"_n{i}")
                                          for i, it in enumerate(items)])
        # per-bucket summary: B rows per partition key at most
        keys = ["_seg", "_bkt"]
        # _all makes the summary need every column, so that its exchange is the frame's own
        aggs = [F.count(F.lit(1)).alias("_cnt"), F.max(F.hash(*[col(c) for c in df.columns])).alias("_all")]
        for i, c in enumerate(self.columns):
            item = F.when(col(c).isNotNull() & ~self._is_nan(types[c], c),
                          F.struct(F.col("_lpos").alias("p"), F.col("_x").alias("x"), col(c).alias("v")))
            aggs += [F.max(item).alias(f"_last{i}"), F.min(item).alias(f"_first{i}")]
        summary = framed.groupBy(*[col(k) for k in keys]).agg(*aggs)
        ws = Window.partitionBy("_seg").orderBy("_bkt")
        before = ws.rowsBetween(Window.unboundedPreceding, -1)
        after = ws.rowsBetween(1, Window.unboundedFollowing)
        summary = summary.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
        carry = [col(k) for k in keys] + [F.col("_off"), F.col("_all")]
        for i, c in enumerate(self.columns):
            def glob(s):
                return F.when(F.col(s).isNotNull(), F.struct((F.col(s + ".p") + F.col("_off")).alias("p"),
                                                             F.col(s + ".x").alias("x"), F.col(s + ".v").alias("v")))
            if need_prev:
                carry.append(F.last(glob(f"_last{i}"), ignorenulls=True).over(before).alias(f"_cp{i}"))
            if need_next:
                carry.append(F.first(glob(f"_first{i}"), ignorenulls=True).over(after).alias(f"_cn{i}"))
        summary = summary.select(*carry)
        if not self.partition_by and bounds.n_buckets <= SUMMARY_BROADCAST_ROWS:
            summary = F.broadcast(summary)  # one row per bucket
        joined = framed.join(summary, keys, "left").where(F.col("_all").isNotNull())

        def globalised(local, carried):
            lc = F.when(F.col(local).isNotNull(), F.struct(
                (F.col(local + ".p") + F.col("_off")).alias("p"), F.col(local + ".x").alias("x"),
                F.col(local + ".v").alias("v")))
            return F.coalesce(lc, F.col(carried))

        extra = [(F.col("_lpos") + F.col("_off")).alias("_pos")]
        for i, _ in enumerate(self.columns):
            if need_prev:
                extra.append(globalised(f"_p{i}", f"_cp{i}").alias(f"_prev{i}"))
            if need_next:
                extra.append(globalised(f"_n{i}", f"_cn{i}").alias(f"_next{i}"))
        self.frame = joined.select("*", *extra)
        self.source_columns = df.columns

    @staticmethod
    def _is_nan(t, c):
        if isinstance(t, (T.FloatType, T.DoubleType)):
            return F.isnan(col(c))
        return F.lit(False)

    def prev(self, c):
        return F.col(f"_prev{self.columns.index(c)}")

    def next(self, c):
        return F.col(f"_next{self.columns.index(c)}")

    def result(self, replacements: dict[str, Column], keep_position: bool = False) -> DataFrame:
        sel = [replacements.get(c, col(c)).alias(c) for c in self.source_columns]
        if keep_position:
            sel.append(F.col("_pos").alias("position"))
        return self.frame.select(*sel)


def _missing(c: str, df_types) -> Column:
    t = df_types[c]
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def fill_forward(df: DataFrame, columns, order_by: str, limit: int | None = None, partition_by=(),
                 n_buckets=None) -> DataFrame:
    """IM5 ffill: a missing cell takes the last earlier value if at most
    ``limit`` missing cells separate them (pandas ``ffill(limit=)``)."""
    of = OrderedFrame(df, order_by, columns, partition_by, n_buckets, need_next=False)
    types = {f.name: f.dataType for f in df.schema.fields}
    rep = {}
    for c in columns:
        p = of.prev(c)
        ok = p.isNotNull() if limit is None else (F.col("_pos") - p["p"] <= limit)
        rep[c] = F.when(_missing(c, types) & ok, p["v"]).otherwise(col(c))
    return of.result(rep)


def fill_backward(df: DataFrame, columns, order_by: str, limit: int | None = None, partition_by=(),
                  n_buckets=None) -> DataFrame:
    """IM5 bfill with ``limit``."""
    of = OrderedFrame(df, order_by, columns, partition_by, n_buckets, need_prev=False)
    types = {f.name: f.dataType for f in df.schema.fields}
    rep = {}
    for c in columns:
        n = of.next(c)
        ok = n.isNotNull() if limit is None else (n["p"] - F.col("_pos") <= limit)
        rep[c] = F.when(_missing(c, types) & ok, n["v"]).otherwise(col(c))
    return of.result(rep)


INTERPOLATION_METHODS = ("linear", "time", "index", "values", "nearest", "pad", "ffill", "backfill", "bfill")


def interpolate(df: DataFrame, columns, order_by: str, method: str = "linear", limit: int | None = None,
                limit_direction: str | None = None, partition_by=(), n_buckets=None) -> DataFrame:
    """IM6: pandas ``Series.interpolate`` semantics over ``order_by`` order.

    ``linear`` treats rows as equally spaced; ``time`` / ``index`` / ``values``
    use the order key as x (in a gap between rows of equal x it is the next value).  Outside the first/last valid value the linear
    family repeats the edge value, ``nearest`` leaves gaps.  ``limit`` counts
    consecutive missing cells from the side(s) named by ``limit_direction``
    (default ``forward``; ``pad`` forward, ``backfill`` backward), and the
    leading (forward) / trailing (backward) gaps stay missing, as in pandas."""
    if method not in INTERPOLATION_METHODS:
        raise ValueError(f"unsupported interpolation method {method!r}")
    if method in ("pad", "ffill"):
        if limit_direction not in (None, "forward"):
            raise ValueError("pad interpolation only fills forward")
        return fill_forward(df, columns, order_by, limit, partition_by, n_buckets)
    if method in ("backfill", "bfill"):
        if limit_direction not in (None, "backward"):
            raise ValueError("backfill interpolation only fills backward")
        return fill_backward(df, columns, order_by, limit, partition_by, n_buckets)
    direction = limit_direction or "forward"
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if not isinstance(types[c], (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"column {c} is not numeric or datetime")
    of = OrderedFrame(df, order_by, columns, partition_by, n_buckets)
    return of.result({c: interpolated(of, c, types[c], method, limit, direction) for c in columns})


def interpolated(of: OrderedFrame, c: str, t, method: str, limit: int | None, direction: str) -> Column:
    """Column ``c`` of an ordered frame with its gaps interpolated; integer columns become double."""
    pos, p, n = F.col("_pos"), of.prev(c), of.next(c)
    pv, nv = _num(p["v"], t), _num(n["v"], t)
    if method == "nearest":
        val = F.when(p.isNotNull() & n.isNotNull(), F.when((pos - p["p"]) <= (n["p"] - pos), pv).otherwise(nv))
    else:
        if method == "linear":
            share = (pos - p["p"]).cast("double") / (n["p"] - p["p"]).cast("double")
        else:
            # between rows of one x there is no slope: a gap takes the next value, as a row at the x of the next value does
            width = n["x"] - p["x"]
            share = F.when(width == 0, F.lit(1.0)).otherwise((F.col("_x") - p["x"]) / F.nullif(width, F.lit(0.0)))
        val = (F.when(p.isNotNull() & n.isNotNull(), pv + (nv - pv) * share)
               .when(p.isNotNull(), pv)      # trailing gap: edge value
               .when(n.isNotNull(), nv))     # leading gap: edge value
    # pandas preserves leading NaNs for forward, trailing for backward
    fwd_ok = p.isNotNull() if limit is None else (p.isNotNull() & (pos - p["p"] <= limit))
    bwd_ok = n.isNotNull() if limit is None else (n.isNotNull() & (n["p"] - pos <= limit))
    allowed = {"forward": fwd_ok, "backward": bwd_ok, "both": fwd_ok | bwd_ok}[direction]
    own = col(c).cast("double") if isinstance(t, INTEGRAL_TYPES) else col(c)
    return F.when(_missing(c, {c: t}) & allowed, _from_num(val, t)).otherwise(own)


def _num(v: Column, t) -> Column:
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), v).cast("double")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(v).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(v).cast("double")
    return v.cast("double")


def _from_num(v: Column, t) -> Column:
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.round(v).cast("long"),
                              F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(F.round(v).cast("long"))
    if isinstance(t, T.DateType):
        return F.date_from_unix_date(F.round(v).cast("int"))
    return v if isinstance(t, INTEGRAL_TYPES) else v.cast(t)


def with_positions(df: DataFrame, order_by: str, partition_by=(), n_buckets=None, name="position") -> DataFrame:
    """Dense 1-based row position in ``order_by`` order (per ``partition_by``)."""
    of = OrderedFrame(df, order_by, (), partition_by, n_buckets, need_prev=False, need_next=False)
    return of.result({}, keep_position=True).withColumnRenamed("position", name)


def slice_rows(df: DataFrame, order_by: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """PR13: rows ``[start, stop)`` by position (0-based) in ``order_by`` order, by
    distributed positions: no part of the table, however long, meets in one task."""
    pos = with_positions(df, order_by, name="_rowpos")
    cond = F.col("_rowpos") > start
    if stop is not None:
        cond = cond & (F.col("_rowpos") <= stop)
    return pos.where(cond).drop("_rowpos")


def running_total(df: DataFrame, segment, order_by: str, value: str, out: str = "cum_before",
                  n_buckets=None) -> DataFrame:
    """Per ``segment``, the sum of ``value`` over all rows with a smaller
    ``order_by`` (rows must be unique on ``segment + order_by``).

    Same bucketed plan as ``OrderedFrame``: one window per (segment, range
    bucket), bucket totals, running offsets over the small bucket table, a
    join back; a segment with billions of distinct keys is spread over all
    buckets instead of one task."""
    segment = list(segment)
    bounds = bucket_bounds(df, order_by, n_buckets)
    base = with_bucket(df, order_by, bounds).withColumn("_seg", F.struct(*[col(c).alias(f"p{i}") for i, c in enumerate(segment)]))
    w = Window.partitionBy("_seg", "_bkt").orderBy(*_order(order_by)[1]).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_loc", F.coalesce(F.sum(col(value)).over(w), F.lit(0)))
    tot = local.groupBy("_seg", "_bkt").agg(F.sum(col(value)).alias("_tot"))
    ws = Window.partitionBy("_seg").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_seg", "_bkt", F.coalesce(F.sum("_tot").over(ws), F.lit(0)).alias("_off"))
    joined = local.join(offs, ["_seg", "_bkt"], "left")
    return joined.withColumn(out, F.col("_loc") + F.col("_off")).drop("_seg", "_bkt", "_loc", "_off")
