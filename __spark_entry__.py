"""

Every query reads the driver's tables in full.  The tables hold no NULL, so
missing values are injected by the same key rule on both sides (the "gaps"
below); each ``oracle_sql`` entry is an independent DuckDB formulation of
the same result with the same column names.  Floats are rounded on both
sides where summation order could change the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wideprep.functions import numeric as N
from wideprep.functions import text as TX
from wideprep.operators import classify as CL
from wideprep.operators import columns as CO
from wideprep.operators import correlate as C
from wideprep.operators import boosting as BO
from wideprep.operators import explain as EX
from wideprep.operators import features as FE
from wideprep.operators import impute as I
from wideprep.operators import knn as KN
from wideprep.operators import model as MD
from wideprep.operators import posthoc as H
from wideprep.operators import ordered as O
from wideprep.operators import profile as P
from wideprep.operators import quantile as Q
from wideprep.operators._util import col
from wideprep.plans import header as HD
from wideprep.session import checkpoint_dir
from wideprep.sources import io as IO
from wideprep.sources import reports as RP

# The training-data operators are an optional part: without their files the rest works alone.
try:
    import corpus_pipeline
    from wideprep.llm import queries as LLM
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "wideprep.llm"):
        raise
    LLM = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _null_if(cond, value):
    return F.when(~cond, value)


# --------------------------------------------------------------------------- gap set-ups

def orders_gaps(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    _null_if(k % 7 == 0, F.col("o_totalprice")).alias("o_totalprice"),
                    "o_orderdate",
                    _null_if(k % 5 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_GAPS_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_KIND = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "string",
               "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "string"}


def lineitem_gaps(spark, d):
    li = _t(spark, d, "lineitem")
    return li.withColumn("l_quantity", _null_if(F.col("l_orderkey") % 9 == 0, F.col("l_quantity")))


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_GAPS_SQL = ("(SELECT * REPLACE (CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END "
                     "AS l_quantity) FROM lineitem)")


def part_text(spark, d):
    """``part`` with every column as text and odd number formats in ``p_size``."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    size = (F.when(k % 100 == 0, F.lit("n/a")).when(k % 13 == 0, F.lit("1,5"))
            .when(k % 17 == 0, F.lit("2f")).when(k % 19 == 0, F.lit("1_0"))
            .when(k % 23 == 0, F.lit(" 1e1 ")).otherwise(F.col("p_size").cast("string")))
    return p.select(k.cast("string").alias("p_partkey"), "p_name", "p_brand", "p_type",
                    size.alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"))


PART_TEXT_SQL = """(SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
  CASE WHEN p_partkey % 100 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN '1,5'
       WHEN p_partkey % 17 = 0 THEN '2f' WHEN p_partkey % 19 = 0 THEN '1_0'
       WHEN p_partkey % 23 = 0 THEN ' 1e1 ' ELSE CAST(p_size AS VARCHAR) END AS p_size,
  CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part)"""
PART_TEXT_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def sql_to_number(x: str) -> str:
    """NUM1 in DuckDB: same guard pattern as the Spark side, then a cast."""
    blanks = r"'^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$'"
    return (f"(CASE WHEN regexp_matches({x}, '{N.NUMBER_PATTERN}') "
            f"THEN TRY_CAST(regexp_replace({x}, {blanks}, '', 'g') AS DOUBLE) "
            f"WHEN regexp_matches({x}, '{N.INFINITY_PATTERN}') "
            f"THEN CASE WHEN starts_with(trim({x}), '-') THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END END)")


def sql_normalize(x: str, typography: bool = True) -> str:
    src, dst = TX._translate_args(typography)
    lit_src = src.replace("'", "''")
    lit_dst = dst.replace("'", "''")
    return (f"trim(regexp_replace(translate(coalesce({x}, ''), '{lit_src}', '{lit_dst}'), "
            f"'{TX.WHITESPACE_RUN}', ' ', 'g'))")


def sql_match_key(x: str) -> str:
    s = f"lower({sql_normalize(x)})"
    for a, b in TX.CASEFOLD_EXTRA:
        s = f"replace({s}, '{a}', '{b}')"
    return s


# --------------------------------------------------------------------------- profiling queries

def q_fill_rate(spark, d):
    return P.fill_rate(orders_gaps(spark, d))


def q_missing_report_top20(spark, d):
    out = P.missing_report(orders_gaps(spark, d), top=20)
    return out.select("column", "missing_count", F.round("missing_percentage", 6).alias("missing_percentage"),
                      "data_type")


def q_total_missing(spark, d):
    return P.total_missing(orders_gaps(spark, d))


def q_column_profile(spark, d):
    out = P.column_profile(lineitem_gaps(spark, d))
    return out.select("position", "column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                      "precision", "n_unique")


def q_type_profile(spark, d):
    out = P.numeric_ratio(part_text(spark, d))
    uniq = P.numeric_distinct(part_text(spark, d))
    return (out.join(uniq, "column", "left")
            .select("position", "column", "non_null", "numeric", F.round("ratio_numeric", 6).alias("ratio_numeric"),
                    "int_like", "kind", F.coalesce("n_unique_numeric", F.lit(0)).alias("n_unique_numeric")))


def q_type_totals(spark, d):
    return P.type_profile(part_text(spark, d))


def q_describe_object(spark, d):
    g = orders_gaps(spark, d).select("o_orderstatus", "o_orderpriority",
                                     F.col("o_custkey").cast("string").alias("o_custkey"))
    return P.describe_object(g)


def _part_modes(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_size", "p_brand", "p_type",
                    _null_if(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("p_retailprice"),
                    # near-unique values from 1e-9 to 1e20, whose order as text differs from their order as numbers
                    (F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_partkey") % 30 - 12)).alias("p_scaled"),
                    F.when(F.col("p_partkey") % 2 == 0, 12000000.0).otherwise(1.5).alias("p_tied"))


def q_mode_by_string_float(spark, d):
    """AGG7 on float columns; of two equally common values the smaller text wins."""
    k = F.col("p_partkey")
    tied = F.when(k % 2 == 0, F.lit(12_000_000.0)).otherwise(1.5)
    return P.mode(_t(spark, d, "part").select(F.col("p_retailprice").cast("float").alias("price"), tied.cast("float").alias("tied"),
                                              F.when(k % 5 > 0, (k % 7) / 10).cast("float").alias("tenths")), tie="string")


def q_mode_by_string(spark, d):
    return P.mode(_part_modes(spark, d), tie="string")


def q_mode_by_value(spark, d):
    return P.mode(_part_modes(spark, d), tie="value")


STATUS_LABELS = [("F", "fulfilled"), ("O", "open")]  # 'P' deliberately has no label


def q_group_counts(spark, d):
    labels = spark.createDataFrame(STATUS_LABELS, "code string, label string")
    return P.group_counts(orders_gaps(spark, d), "o_orderstatus", labels)


def q_sample_per_column(spark, d):
    p = _t(spark, d, "part")
    return P.sample_per_column(p, "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
                               n=3, seed=42)


def q_numeric_ratio(spark, d):
    return q_type_profile(spark, d).select("column", "ratio_numeric", "n_unique_numeric", "int_like")


# --------------------------------------------------------------------------- text queries

DOC_WRAP_PREFIX = " «​ "
DOC_WRAP_SUFFIX = " — ’　"


def documents_wrapped(spark, d):
    doc = _t(spark, d, "documents")
    inner = F.replace(F.col("text"), F.lit(". "), F.lit(".  \t "))
    return doc.select("doc_id", F.concat(F.lit(DOC_WRAP_PREFIX), inner, F.lit(DOC_WRAP_SUFFIX)).alias("text"))


DOCS_WRAPPED_SQL = (f"(SELECT doc_id, concat('{DOC_WRAP_PREFIX}', replace(text, '. ', '.  \t '), "
                    f"'{DOC_WRAP_SUFFIX.replace(chr(39), chr(39) * 2)}') AS text FROM documents)")


def q_normalize_text(spark, d):
    w = documents_wrapped(spark, d)
    return w.select("doc_id", TX.normalize_text("text").alias("normalized"),
                    TX.normalize_name("text").alias("name_form"))


def q_match_key(spark, d):
    w = documents_wrapped(spark, d)
    return w.select("doc_id", TX.match_key("text").alias("key"), TX.id_match_key("text").alias("id_key"),
                    TX.starts_with_key("text", " «The").alias("starts_the"))


def q_decimal_comma(spark, d):
    p = _t(spark, d, "part")
    txt = F.when(F.col("p_partkey") % 50 == 0, F.lit("n,a")) \
        .otherwise(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    return p.select("p_partkey", txt.alias("txt"), TX.decimal_comma_to_double(txt).alias("value"))


# --------------------------------------------------------------------------- ordered fills (D2)

def events_gaps(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", "ts", "user_id",
                    _null_if((F.col("event_id") % 5).isin(1, 2, 3), F.col("value")).alias("value"))


EVENTS_GAPS_SQL = ("(SELECT event_id, ts, user_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN NULL ELSE value END "
                   "AS value FROM events)")


def _ordered_out(df, value="value"):
    return df.select("event_id", F.round(value, 6).alias("value"))


def q_ffill(spark, d):
    return _ordered_out(O.fill_forward(events_gaps(spark, d), ["value"], "event_id"))


def q_ffill_by_user(spark, d):
    return _ordered_out(O.fill_forward(events_gaps(spark, d), ["value"], "event_id", partition_by=["user_id"]))


def q_ffill_limit(spark, d):
    return _ordered_out(O.fill_forward(events_gaps(spark, d), ["value"], "event_id", limit=2))


def q_bfill(spark, d):
    return _ordered_out(O.fill_backward(events_gaps(spark, d), ["value"], "event_id"))


def q_bfill_limit_by_user(spark, d):
    return _ordered_out(O.fill_backward(events_gaps(spark, d), ["value"], "event_id", limit=1,
                                        partition_by=["user_id"]))


def q_interpolate_linear(spark, d):
    return _ordered_out(O.interpolate(events_gaps(spark, d), ["value"], "event_id"))


def q_interpolate_time(spark, d):
    return _ordered_out(O.interpolate(events_gaps(spark, d), ["value"], ["ts", "event_id"], method="time"))


def q_interpolate_both_by_user(spark, d):
    return _ordered_out(O.interpolate(events_gaps(spark, d), ["value"], "event_id", limit=1,
                                      limit_direction="both", partition_by=["user_id"]))


def q_interpolate_nearest(spark, d):
    return _ordered_out(O.interpolate(events_gaps(spark, d), ["value"], "event_id", method="nearest"))


def q_row_slice(spark, d):
    e = _t(spark, d, "events")
    return O.slice_rows(e, "event_id", 100, 300).select("event_id", "user_id", "event_type")


def q_skip_rows(spark, d):
    e = _t(spark, d, "events")
    return O.slice_rows(e, "event_id", 3, None).select("event_id", "user_id")


def q_positions_by_user(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id")
    return O.with_positions(e, "event_id", partition_by=["user_id"])


def _sql_ordered(expr_value: str, part: str = "", order: str = "event_id", x: str | None = None) -> str:
    """Window formulation in DuckDB: previous/next value and position per row."""
    pby = f"PARTITION BY {part} " if part else ""
    w_prev = f"OVER ({pby}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_next = f"OVER ({pby}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    xs = x or "0"
    return (f"WITH g AS {EVENTS_GAPS_SQL},\n"
            f"p AS (SELECT *, row_number() OVER ({pby}ORDER BY {order}) AS pos, {xs} AS x FROM g),\n"
            "q AS (SELECT *,\n"
            f" last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) {w_prev} AS pp,\n"
            f" last_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) {w_prev} AS px,\n"
            f" last_value(value IGNORE NULLS) {w_prev} AS pv,\n"
            f" first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) {w_next} AS np,\n"
            f" first_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) {w_next} AS nx,\n"
            f" first_value(value IGNORE NULLS) {w_next} AS nv FROM p)\n"
            f"SELECT event_id, round({expr_value}, 6) AS value FROM q")


LINEAR_SQL = ("CASE WHEN value IS NOT NULL THEN value WHEN pp IS NOT NULL AND np IS NOT NULL "
              "THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE)) "
              "WHEN pp IS NOT NULL THEN pv END")
TIME_SQL = ("CASE WHEN value IS NOT NULL THEN value WHEN pp IS NOT NULL AND np IS NOT NULL "
            "THEN pv + (nv - pv) * ((x - px) / (nx - px)) WHEN pp IS NOT NULL THEN pv END")
BOTH1_SQL = ("CASE WHEN value IS NOT NULL THEN value "
             "WHEN (pp IS NOT NULL AND pos - pp <= 1) OR (np IS NOT NULL AND np - pos <= 1) THEN "
             "CASE WHEN pp IS NOT NULL AND np IS NOT NULL "
             "THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE)) "
             "WHEN pp IS NOT NULL THEN pv ELSE nv END END")
NEAREST_SQL = ("CASE WHEN value IS NOT NULL THEN value WHEN pp IS NOT NULL AND np IS NOT NULL "
               "THEN CASE WHEN pos - pp <= np - pos THEN pv ELSE nv END END")


def _sql_slice() -> str:
    return "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 200 OFFSET 100"


def _sql_skip() -> str:
    return ("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) "
            "WHERE rn > 3")


def _sql_positions() -> str:
    return ("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position "
            "FROM events")


# --------------------------------------------------------------------------- imputation

def q_impute_mean(spark, d):
    out = I.impute_mean(orders_gaps(spark, d), ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def q_impute_median(spark, d):
    out = I.impute_median(orders_gaps(spark, d), ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def q_impute_mode(spark, d):
    out = I.impute_mode(orders_gaps(spark, d), ["o_totalprice", "o_orderpriority"], tie="string")
    return out.select("o_orderkey", "o_totalprice", "o_orderpriority")


def q_impute_constant(spark, d):
    out = I.impute_constant(orders_gaps(spark, d), {"o_totalprice": 0.0, "o_orderpriority": "unknown"})
    return out.select("o_orderkey", "o_totalprice", "o_orderpriority")


def q_drop_rows(spark, d):
    return I.drop_rows(orders_gaps(spark, d), ["o_totalprice"]).select("o_orderkey", "o_totalprice")


def orders_auto(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        _null_if(k % 3 == 0, F.col("o_custkey")).alias("o_custkey"),
        _null_if(k % 13 == 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        _null_if(k % 7 == 0, F.col("o_totalprice")).alias("o_totalprice"),
        _null_if(k % 4 == 0, F.round(F.col("o_totalprice") / 10000, 1)).alias("o_price_k"),
        _null_if(k % 11 == 0, F.col("o_orderdate")).alias("o_orderdate"),
        F.lit(None).cast("double").alias("o_none"))


ORDERS_AUTO_SQL = """(SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice / 10000, 1) END AS o_price_k,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
  CAST(NULL AS DOUBLE) AS o_none FROM orders)"""
AUTO_CONFIG = {"methods": {"o_custkey": "median"}}


def _auto(spark, d):
    return I.apply_filling(orders_auto(spark, d), AUTO_CONFIG, order_by="o_orderkey")


def q_impute_auto(spark, d):
    filled, _, _ = _auto(spark, d)
    return filled.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         F.round("o_price_k", 4).alias("o_price_k"),
                         F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_none")


def q_impute_log(spark, d):
    _, log, _ = _auto(spark, d)
    return log.select("column", "method", "missing_before", "missing_after", "dtype", "fallback", "reason")


def q_impute_summary(spark, d):
    _, _, summary = _auto(spark, d)
    return summary


POLICY_RULES = [(["o_totalprice"], "median", 50.0), (["o_orderpriority"], "mode", 30.0),
                (["o_custkey"], "median", 30.0)]


def orders_policy(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey",
                    _null_if(k % 10 == 0, F.col("o_totalprice")).alias("o_totalprice"),
                    _null_if(k % 5 < 2, F.col("o_orderpriority")).alias("o_orderpriority"),
                    _null_if(k % 5 < 3, F.col("o_custkey").cast("double")).alias("o_custkey"))


def q_impute_policy(spark, d):
    out = I.impute_policy(orders_policy(spark, d), POLICY_RULES)
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderpriority",
                      "o_custkey")


def _sql_impute_simple(kind: str) -> str:
    g = ORDERS_GAPS_SQL
    if kind == "mean":
        return (f"WITH g AS {g} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) "
                "FROM g)), 4) AS o_totalprice FROM g")
    if kind == "median":
        return (f"WITH g AS {g} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont("
                "o_totalprice, 0.5) FROM g)), 4) AS o_totalprice FROM g")
    if kind == "mode":
        def m(c):
            return (f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM g WHERE {c} IS NOT NULL "
                    "GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
        return (f"WITH g AS {g} SELECT o_orderkey, coalesce(o_totalprice, CAST({m('o_totalprice')} AS DOUBLE)) "
                f"AS o_totalprice, coalesce(o_orderpriority, {m('o_orderpriority')}) AS o_orderpriority FROM g")
    if kind == "constant":
        return (f"WITH g AS {g} SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice, "
                "coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM g")
    return f"WITH g AS {g} SELECT o_orderkey, o_totalprice FROM g WHERE o_totalprice IS NOT NULL"


def _sql_mean_rule(c: str) -> str:
    """IM9 in SQL: mean when distinct values < 0.2 x rows, sample std > 1 and decimals > 0."""
    prec = f"max(CASE WHEN {c} IS NOT NULL THEN greatest(1, length(split_part(CAST({c} AS VARCHAR), '.', 2))) END)"
    return (f"(SELECT coalesce(count(DISTINCT {c}) < 0.2 * count(*) AND stddev_samp({c}) > 1 AND {prec} > 0, false) "
            "FROM g)")


def _sql_impute_auto() -> str:
    # decisions: custkey median (config), status mode (text), totalprice and price_k by the
    # mean/mode rule, orderdate ffill (datetime fallback), o_none unchanged (no value to carry)
    def mode_txt(c):
        return (f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM g WHERE {c} IS NOT NULL "
                "GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")

    def by_rule(c):
        return (f"coalesce({c}, CASE WHEN {_sql_mean_rule(c)} THEN (SELECT avg({c}) FROM g) "
                f"ELSE CAST({mode_txt(c)} AS DOUBLE) END)")
    return (f"WITH g AS {ORDERS_AUTO_SQL}\n"
            "SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(o_custkey, 0.5) FROM g)) AS o_custkey,\n"
            f" coalesce(o_orderstatus, {mode_txt('o_orderstatus')}) AS o_orderstatus,\n"
            f" {by_rule('o_totalprice')} AS o_totalprice,\n"
            f" round({by_rule('o_price_k')}, 4) AS o_price_k,\n"
            " CAST(coalesce(o_orderdate, last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS "
            "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS VARCHAR) AS o_orderdate, o_none FROM g")


# method "rule": mean or mode by the profile rule, evaluated in SQL
AUTO_LOG = [("o_orderkey", "unchanged", "numeric", False, "", False),
            ("o_custkey", "median", "numeric", False, "", True),
            ("o_orderstatus", "mode", "string", False, "", True),
            ("o_totalprice", "rule", "numeric", False, "", True),
            ("o_price_k", "rule", "numeric", False, "", True),
            ("o_orderdate", "ffill", "datetime", True, "datetime column without use for mode; used: ffill", False),
            ("o_none", "unchanged", "numeric", True, "numeric column without use for mode, ffill; used: unchanged",
             False)]


def _sql_impute_log() -> str:
    parts = []
    for c, m, t, fb, reason, filled_all in AUTO_LOG:
        after = "0" if filled_all else f"count(*) - count({c})"
        if m == "ffill":  # a leading gap has nothing to carry forward
            after = (f"(SELECT count(*) FROM (SELECT last_value({c} IGNORE NULLS) OVER (ORDER BY o_orderkey "
                     "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM g) WHERE f IS NULL)")
        method = f"CASE WHEN {_sql_mean_rule(c)} THEN 'mean' ELSE 'mode' END" if m == "rule" else f"'{m}'"
        parts.append(f"SELECT '{c}' AS \"column\", {method} AS method, count(*) - count({c}) AS missing_before, "
                     f"{after} AS missing_after, '{t}' AS dtype, {str(fb).lower()} AS fallback, "
                     f"'{reason}' AS reason FROM g")
    return f"WITH g AS {ORDERS_AUTO_SQL}\n" + _union(parts)


def _sql_impute_summary() -> str:
    log = _sql_impute_log()
    return (f"WITH l AS ({log})\n"
            "SELECT 'total_missing_before' AS metric, CAST(sum(missing_before) AS VARCHAR) AS value FROM l\n"
            "UNION ALL SELECT 'total_missing_after', CAST(sum(missing_after) AS VARCHAR) FROM l\n"
            "UNION ALL SELECT 'columns_processed', CAST(count(*) AS VARCHAR) FROM l\n"
            "UNION ALL SELECT 'method:' || method, CAST(count(*) AS VARCHAR) FROM l GROUP BY method")


def _sql_impute_policy() -> str:
    return ("WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS "
            "o_totalprice, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderpriority END AS o_orderpriority, "
            "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders)\n"
            # totalprice 10 % < 50 -> median; priority 40 % >= 30 -> untouched; custkey 60 % -> untouched
            "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM g)), 4) "
            "AS o_totalprice, o_orderpriority, o_custkey FROM g")


# --------------------------------------------------------------------------- statistics

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_const"]


def lineitem_corr(spark, d):
    return lineitem_gaps(spark, d).withColumn("l_const", F.lit(1.0)).select(*CORR_COLS)


def q_corr_pairs(spark, d):
    out = C.correlation_pairs(lineitem_corr(spark, d))
    return out.select("feature_1", "feature_2", "n", F.round("correlation", 6).alias("correlation"))


def q_corr_pairs_moments(spark, d):
    out = C.correlation_pairs(lineitem_corr(spark, d))
    return out.select("feature_1", "feature_2", "n", F.round("correlation", 6).alias("correlation"))


def q_corr_matrix(spark, d):
    return C.correlation_matrix(lineitem_corr(spark, d), decimals=2)


def customer_groups(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_mktsegment", F.round("c_acctbal", -2).alias("c_acctbal_r"),
                    F.col("c_nationkey").cast("double").alias("c_nationkey"))


def q_posthoc_stats(spark, d):
    out = H.dscf_table(customer_groups(spark, d), "c_mktsegment")
    return out.select("feature", "group_1", "group_2", "n_1", "n_2", F.round("u", 6).alias("u"),
                      F.round("q", 6).alias("q"), "significant")


def q_posthoc_dscf(spark, d):
    out = H.posthoc_dscf(customer_groups(spark, d), "c_mktsegment")
    return out.select("group_1", "group_2", F.round("p_value", 8).alias("p_value"), "feature", "significant")


CORR_SQL_SRC = ("(SELECT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, "
                "l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, 1.0::DOUBLE AS l_const FROM lineitem)")


def _sql_corr_long() -> str:
    parts = []
    for i in range(len(CORR_COLS)):
        for j in range(i + 1, len(CORR_COLS)):
            a, b = CORR_COLS[i], CORR_COLS[j]
            ma, mb = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(
                f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, count({ma}) AS n, "
                f"CASE WHEN count({ma}) < 2 OR stddev_pop({ma}) = 0 OR stddev_pop({mb}) = 0 THEN NULL "
                f"ELSE corr({a}, {b}) END AS correlation FROM g")
    return f"WITH g AS {CORR_SQL_SRC}\n" + _union(parts)


def _sql_corr_pairs() -> str:
    return f"SELECT feature_1, feature_2, n, round(correlation, 6) AS correlation FROM ({_sql_corr_long()})"


def _sql_corr_matrix() -> str:
    diag = _union([f"SELECT '{c}' AS feature_1, '{c}' AS feature_2, CASE WHEN stddev_pop({c}) > 0 THEN 1.0 END "
                   f"AS correlation FROM {CORR_SQL_SRC}" for c in CORR_COLS])
    piv = ", ".join(f"max(CASE WHEN feature_2 = '{c}' THEN round(correlation, 2) + 0.0 END) AS {c}" for c in CORR_COLS)
    return (f"WITH p AS ({_sql_corr_long()}),\n"
            "b AS (SELECT feature_1, feature_2, correlation FROM p UNION ALL "
            f"SELECT feature_2, feature_1, correlation FROM p UNION ALL {diag})\n"
            f"SELECT feature_1 AS feature, {piv} FROM b GROUP BY feature_1")


Q_CRIT_K5 = 3.8576555  # studentized range, k = 5, df = inf, alpha = 0.05


def _sql_posthoc_stats() -> str:
    return _sql_posthoc_ctes() + f"""
SELECT feature, group_1, group_2, n_1, n_2, round(um, 6) AS u,
  round(CASE WHEN var > 0 THEN sqrt(2.0) * abs(um - CAST(n_1 AS DOUBLE) * n_2 / 2.0) / sqrt(var) END, 6) AS q,
  CASE WHEN var > 0 AND sqrt(2.0) * abs(um - CAST(n_1 AS DOUBLE) * n_2 / 2.0) / sqrt(var) > {Q_CRIT_K5}
       THEN 'yes' ELSE 'no' END AS significant FROM q"""


def _sql_posthoc_dscf() -> str:
    """p-values in SQL: the studentized-range tail ``1 - k Int phi(z) (Phi(z) - Phi(z - q))^(k-1) dz``
    with Gauss-Legendre nodes on [-8, 8] (a constant table from numpy's rule) and the normal CDF
    from its series ``1/2 + phi(x) sum x^(2n+1) / (2n+1)!!`` (terms in log space with lgamma)."""
    import numpy as np
    x, w = np.polynomial.legendre.leggauss(H.QUADRATURE_POINTS)
    nodes = ", ".join(f"({float(8.0 * a)!r}, {float(8.0 * b)!r})" for a, b in zip(x, w))
    phi_cdf = """(SELECT CASE WHEN {x} = 0 THEN 0.5 ELSE 0.5 + sign({x}) * exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) *
        sum(exp((2 * n + 1) * ln(abs({x})) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))) END
        FROM range(0, 400) t(n))"""
    return _sql_posthoc_ctes() + f""",
qq AS (SELECT feature, group_1, group_2, CASE WHEN var > 0 THEN sqrt(2.0) * abs(um - CAST(n_1 AS DOUBLE) * n_2 / 2.0)
        / sqrt(var) END AS qv FROM q),
k AS (SELECT count(DISTINCT c_mktsegment) AS k FROM customer),
nodes AS (SELECT * FROM (VALUES {nodes}) t(z, w)),
ev AS (SELECT qq.feature, qq.group_1, qq.group_2, qq.qv, nodes.z, nodes.w,
        {phi_cdf.format(x="nodes.z")} AS pz, {phi_cdf.format(x="(nodes.z - qq.qv)")} AS pzq
        FROM qq, nodes WHERE qq.qv IS NOT NULL),
pv AS (SELECT feature, group_1, group_2,
        least(1.0, greatest(0.0, 1.0 - (SELECT k FROM k) * sum(w * exp(-0.5 * z * z) / sqrt(2 * pi())
          * power(least(1.0, greatest(0.0, pz - pzq)), (SELECT k FROM k) - 1)))) AS p
        FROM ev GROUP BY ALL),
allp AS (SELECT qq.feature, qq.group_1, qq.group_2, pv.p FROM qq LEFT JOIN pv USING (feature, group_1, group_2)),
both_dirs AS (SELECT group_1, group_2, p, feature FROM allp UNION ALL SELECT group_2, group_1, p, feature FROM allp
        UNION ALL SELECT g, g, 1.0, f.feature FROM gs, (SELECT DISTINCT feature FROM d) f)
SELECT group_1, group_2, round(p, 8) AS p_value, feature, CASE WHEN p < 0.05 THEN 'yes' ELSE 'no' END AS significant
FROM both_dirs"""


def _sql_posthoc_ctes() -> str:
    return f"""WITH d AS (SELECT c_mktsegment AS g, 'c_acctbal_r' AS feature, round(c_acctbal, -2) AS v FROM customer
  UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer),
gs AS (SELECT DISTINCT g FROM d),
pr AS (SELECT a.g AS group_1, b.g AS group_2 FROM gs a JOIN gs b ON a.g < b.g),
x AS (SELECT d.feature, pr.group_1, pr.group_2, d.g, d.v FROM d JOIN pr ON d.g = pr.group_1 OR d.g = pr.group_2),
r AS (SELECT *, rank() OVER (PARTITION BY feature, group_1, group_2 ORDER BY v)
        + (count(*) OVER (PARTITION BY feature, group_1, group_2, v) - 1) / 2.0 AS ar FROM x),
tv AS (SELECT feature, group_1, group_2, v, count(*) AS t FROM x GROUP BY ALL),
ti AS (SELECT feature, group_1, group_2, sum((t * t * t - t) / 12.0) AS ties FROM tv GROUP BY ALL),
s AS (SELECT feature, group_1, group_2, count(*) FILTER (WHERE g = group_1) AS n_1,
        count(*) FILTER (WHERE g = group_2) AS n_2, sum(ar) FILTER (WHERE g = group_1) AS r1 FROM r GROUP BY ALL),
u AS (SELECT s.*, ti.ties, CAST(n_1 AS DOUBLE) * n_2 + n_1 * (n_1 + 1) / 2.0 - r1 AS u1,
        CAST(n_1 + n_2 AS DOUBLE) AS nn FROM s JOIN ti USING (feature, group_1, group_2)),
q AS (SELECT *, least(u1, CAST(n_1 AS DOUBLE) * n_2 - u1) AS um,
        (CAST(n_1 AS DOUBLE) * n_2 / (nn * (nn - 1))) * ((nn * nn * nn - nn) / 12.0 - ties) AS var FROM u)"""


# --------------------------------------------------------------------------- header, names, selection

HEADER_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def customer_header(spark, d):
    """First three customers (by key) as header rows, with typographic quotes
    around names and blanks where ``(row_idx + col_idx) % 3 = 0``."""
    c = _t(spark, d, "customer")
    c = c.withColumn("c_name", F.concat(F.lit("« "), F.col("c_name"), F.lit(" »")))
    h = HD.header_from_rows(c, "c_custkey", 3)
    return h.withColumn("cell", F.when((F.col("row_idx") + F.col("col_idx")) % 3 == 0, F.lit("")).otherwise(F.col("cell")))


def q_pick_names(spark, d):
    return HD.pick_names(customer_header(spark, d))


def q_header_sources(spark, d):
    return P.counter(HD.pick_names(customer_header(spark, d)), "used_row")


def q_dedupe_names(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return HD.dedupe_names(p, "name", "p_partkey")


def q_find_target(spark, d):
    h = customer_header(spark, d)
    return HD.find_target(HD.pick_names(h), h, "« Customer#00000000").select("col_idx", "name", "mode")


def q_promote_header(spark, d):
    """IO2 on ``orders`` read as text with generic names: the row-2 cells name
    the columns; the body is returned in long form ``o_orderkey, name, value``."""
    o = _t(spark, d, "orders")
    generic = o.select("o_orderkey", *[F.col(c).cast("string").alias(f"COL{i + 1}")
                                       for i, c in enumerate(ORDERS_COLS[1:])])
    header, body = HD.header_table(generic, "o_orderkey", 3)
    names = {r["col_idx"]: r["name"] for r in HD.pick_names(header).collect()}  # one name per column
    promoted = body.select("o_orderkey", *[F.col(f"COL{i + 1}").alias(names[i]) for i in range(len(names))])
    return promoted.unpivot(["o_orderkey"], [col(names[i]) for i in range(len(names))], "name", "value")


def q_drop_identifier(spark, d):
    return HD.drop_identifier(_t(spark, d, "customer"), ["C_Cust Key"])


def q_report_lines(spark, d):
    lines = RP.format_fill_lines(P.fill_rate(orders_gaps(spark, d)))
    parsed = RP.parse_fill_lines(lines)
    return lines.join(parsed, "column_no")


def orders_keep(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    _null_if(k % 7 == 0, F.col("o_totalprice")).alias("o_totalprice"),
                    F.col("o_orderdate").cast("string").alias("o_orderdate"),
                    _null_if(k % 2 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))


def q_keep_filled(spark, d):
    return CO.keep_filled(orders_keep(spark, d), 80.0)


def q_select_numeric(spark, d):
    return CO.select_numeric(orders_gaps(spark, d), exclude=["o_custkey"])


def q_drop_text_columns(spark, d):
    return CO.drop_text_columns(part_text(spark, d))


PART_HINTS = [("P_Brand", "categorical"), ("p retailprice", "numerical")]


def q_classify(spark, d):
    hints = spark.createDataFrame(PART_HINTS, "key string, kind string")
    return CL.classify_features(_t(spark, d, "part"), hints)


def q_classify_text(spark, d):
    return CL.classify_features(part_text(spark, d), use_patterns=False)


# user-supplied cue patterns for the four languages of ``documents``, next to the reference's defaults
DOC_CAT_EXTRA = [r"\bla\b", r"\bthe\b"]
DOC_NUM_EXTRA = [r"\bder\b", r"\bthe\b"]


def q_name_cues(spark, d):
    doc = _t(spark, d, "documents").select("doc_id", "text")
    out = CL.text_cues(doc, "text", CL.CATEGORICAL_PATTERNS + DOC_CAT_EXTRA, CL.NUMERICAL_PATTERNS + DOC_NUM_EXTRA)
    return out.select("doc_id", "cat_hit", "num_hit", "cue_hit", "kind")


def portable_regex(p: str) -> str:
    """Java ``\\b`` (Unicode) rewritten for RE2, whose ``\\b`` is ASCII-only."""
    nw = r"[^\pL\pN_]"
    if p.startswith(r"\(.*?\b"):
        p = r"\((?:.*?" + nw + ")?" + p[len(r"\(.*?\b"):]
    if p.startswith(r"\b"):
        p = "(?:^|" + nw + ")" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + "(?:$|" + nw + ")"
    return p


def _sql_any(key: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({key}, '{portable_regex(p)}')" for p in patterns) + ")"


def _sql_name_cues() -> str:
    key = sql_match_key("text")
    cat = _sql_any("k", CL.CATEGORICAL_PATTERNS + DOC_CAT_EXTRA)
    num = _sql_any("k", CL.NUMERICAL_PATTERNS + DOC_NUM_EXTRA)
    cue = "(" + " OR ".join(f"contains(k, '{c}')" for c in CL.CATEGORICAL_CUES) + ")"
    return (f"WITH t AS (SELECT doc_id, {key} AS k FROM documents)\n"
            f"SELECT doc_id, {cat} AS cat_hit, {num} AS num_hit, {cue} AS cue_hit, "
            f"CASE WHEN {cat} AND NOT {num} THEN 'categorical' WHEN {num} AND NOT {cat} THEN 'numerical' END AS kind "
            "FROM t")


def _sql_header_cells() -> str:
    raws = {"c_name": "concat('« ', c_name, ' »')", "c_nationkey": "CAST(c_nationkey AS VARCHAR)",
            "c_acctbal": "CAST(c_acctbal AS VARCHAR)", "c_mktsegment": "c_mktsegment"}
    cells = _union([f"SELECT {i} AS col_idx, row_idx, {raws[c]} AS raw FROM r" for i, c in enumerate(HEADER_COLS)])
    return ("WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM "
            "(SELECT * FROM customer ORDER BY c_custkey LIMIT 3)),\n"
            f"cells AS ({cells}),\n"
            f"hc AS (SELECT col_idx, row_idx, CASE WHEN (row_idx + col_idx) % 3 = 0 THEN '' ELSE {sql_normalize('raw')} "
            "END AS cell FROM cells)")


def _sql_pick_names() -> str:
    return (_sql_header_cells() + ",\n"
            "w AS (SELECT col_idx, max(CASE WHEN row_idx = 2 AND cell <> '' THEN cell END) AS h2, "
            "max(CASE WHEN row_idx = 1 AND cell <> '' THEN cell END) AS h1, "
            "max(CASE WHEN row_idx = 0 AND cell <> '' THEN cell END) AS h0 FROM hc GROUP BY col_idx)\n"
            "SELECT col_idx, coalesce(h2, h1, h0, '') AS name, CASE WHEN h2 IS NOT NULL THEN 2 WHEN h1 IS NOT NULL "
            "THEN 1 WHEN h0 IS NOT NULL THEN 0 ELSE 2 END AS used_row FROM w")


def _sql_header_sources() -> str:
    return f"SELECT used_row, count(*) AS n FROM ({_sql_pick_names()}) GROUP BY used_row"


def _sql_find_target() -> str:
    prefix = TX.py_match_key("« Customer#00000000")
    return (f"WITH n AS ({_sql_pick_names()})\n"
            f"SELECT col_idx, name, 'derived' AS mode FROM n WHERE starts_with({sql_match_key('name')}, '{prefix}') "
            f"ORDER BY {sql_match_key('name')}, col_idx LIMIT 1")


def _sql_dedupe() -> str:
    return ("SELECT p_partkey, CASE WHEN rn > 1 THEN p_name || '_' || CAST(rn AS VARCHAR) ELSE p_name END AS name "
            "FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")


def _sql_promote_header() -> str:
    cols = ORDERS_COLS[1:]
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS c{i + 1}" for i, c in enumerate(cols))
    names = ", ".join(f"max(CASE WHEN rn = 3 THEN c{i + 1} END) AS n{i + 1}" for i in range(len(cols)))
    body = _union([f"SELECT b.o_orderkey, h.n{i + 1} AS name, b.c{i + 1} AS value FROM b, h"
                   for i in range(len(cols))])
    norm = ", ".join(f"{sql_normalize(f'n{i + 1}')} AS n{i + 1}" for i in range(len(cols)))
    return (f"WITH t AS (SELECT o_orderkey, {casts}, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),\n"
            f"h0 AS (SELECT {names} FROM t WHERE rn <= 3), h AS (SELECT {norm} FROM h0),\n"
            "b AS (SELECT * FROM t WHERE rn > 3)\n" + body)


def _sql_report_lines() -> str:
    parts = []
    for i, c in enumerate(ORDERS_COLS):
        parts.append(f"SELECT {i + 1} AS column_no, count({c}) AS filled, count(*) AS total, "
                     f"round(100.0 * count({c}) / count(*), 2) AS percentage FROM g")
    return (f"WITH g AS {ORDERS_GAPS_SQL}, r AS ({_union(parts)})\n"
            "SELECT column_no, printf('Column %d: Filled=%d, Total=%d, Percentage=%.2f%%', column_no, filled, total, "
            "percentage) AS line, filled, total, CAST(percentage AS DOUBLE) AS percentage FROM r")


def _sql_keep_filled() -> str:
    return ("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice "
            "END AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders")


def _sql_classify(text: bool) -> str:
    src = PART_TEXT_SQL if text else "(SELECT * FROM part)"
    cols = PART_TEXT_COLS
    parts = []
    for i, c in enumerate(cols):
        n = sql_to_number(f"CAST({c} AS VARCHAR)") if text else f"CAST({c} AS DOUBLE)" \
            if c in ("p_partkey", "p_size", "p_retailprice") else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count({n}) AS DOUBLE) / count(*) AS ratio, "
            f"count(DISTINCT {n}) AS n_num, count(DISTINCT {c}) AS n_raw, "
            f"coalesce(bool_and(CASE WHEN {n} IS NOT NULL THEN abs({n} - round_even({n}, 0)) <= 1e-9 END), false) "
            "AS int_like FROM g")
    hint = "" if text else "WHEN \"column\" = 'p_brand' THEN 'categorical' "
    hint_src = "" if text else "WHEN \"column\" = 'p_brand' THEN 'hints' "
    return (f"WITH g AS {src}, s AS ({_union(parts)})\n"
            f"SELECT position, \"column\", CASE {hint}WHEN ratio >= 0.9 THEN CASE WHEN n_num = 0 THEN 'categorical' "
            "WHEN int_like AND n_num <= 10 THEN 'categorical' ELSE 'numerical' END ELSE 'categorical' END AS kind, "
            + (f"CASE {hint_src}ELSE 'heuristic' END AS source, " if not text else "'heuristic' AS source, ") +
            f"CASE {'WHEN \"column\" = ' + chr(39) + 'p_brand' + chr(39) + ' THEN false ' if not text else ''}"
            "WHEN ratio < 0.9 THEN n_raw > 10 ELSE false END AS high_card, "
            f"CASE {'WHEN \"column\" = ' + chr(39) + 'p_brand' + chr(39) + ' THEN false ' if not text else ''}"
            "WHEN ratio >= 0.9 THEN n_num > 0 AND int_like AND n_num <= 10 AND n_num > 5 "
            "ELSE n_raw > 5 AND n_raw <= 10 END AS borderline FROM s")


# --------------------------------------------------------------------------- features, KNN, models

def q_split_hash(spark, d):
    return FE.split_hash(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)


def q_standardize(spark, d):
    li = lineitem_gaps(spark, d).withColumn("l_const", F.lit(1.0))
    cols = ["l_quantity", "l_extendedprice", "l_const"]
    out = FE.standardize(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cols), cols)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in cols])


def q_onehot_long(spark, d):
    return FE.onehot_long(orders_gaps(spark, d), "o_orderkey", ["o_orderpriority", "o_orderstatus"])


def q_feature_matrix_long(spark, d):
    out = FE.feature_matrix_long(orders_gaps(spark, d), "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    return out.select("o_orderkey", "feature", F.round("value", 6).alias("value"))


def part_knn(spark, d):
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey",
                    _null_if(k % 11 == 0, F.col("p_size").cast("double")).alias("p_size"),
                    _null_if(k % 7 == 0, F.col("p_retailprice")).alias("p_retailprice"),
                    _null_if(k % 13 == 0, (k % 97) * 1.5).alias("m3"))


def q_impute_knn(spark, d):
    out = KN.impute_knn(part_knn(spark, d), "p_partkey", ["p_size", "p_retailprice", "m3"], k=3)
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("p_size", "p_retailprice", "m3")])


EMB_DIMS = 64


def embeddings_frame(spark, d):
    e = _t(spark, d, "embeddings")
    return MD.embedding_features(e, "embedding", EMB_DIMS).drop("embedding")


EMB_FEATURES = [f"f{i}" for i in range(EMB_DIMS)]
#: Spark's own numbers of trees and rounds and its depth; the library's defaults are larger.
FOREST, BOOSTED = {"num_trees": 20, "max_depth": 5}, {"max_iter": 20, "max_depth": 5}


def _emb_model(spark, d):
    data = FE.split_hash(embeddings_frame(spark, d), "vec_id", 0.2, 42)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    return MD.train_forest(train, EMB_FEATURES, "label", **FOREST), test


def _importance_facts(imp):
    """What SQL can say about importances: one row per feature, none outside 0..100, 100 in all, ranks by size."""
    total = imp.agg(F.round(F.sum("importance"), 6).alias("total"))
    ranked = imp.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))     # one row per feature
    nxt = F.lead("importance").over(Window.orderBy("rank"))
    return ranked.withColumn("in_order", F.coalesce(nxt <= F.col("importance"), F.lit(True))).crossJoin(F.broadcast(total)) \
        .select("feature", F.col("importance").between(0, 100.000001).alias("in_range"), "in_order", "total")


def _sql_importance_facts(features: str) -> str:
    return f"SELECT feature, TRUE AS in_range, TRUE AS in_order, 100.0::DOUBLE AS total FROM ({features})"


EMB_NAMES_SQL = "SELECT 'f' || i AS feature FROM range(64) r(i)"


def q_train_importance(spark, d):
    model, _ = _emb_model(spark, d)
    return _importance_facts(MD.importances(model, EMB_FEATURES))


def _prediction_facts(out):
    """Every test row with its label; probabilities of all classes that sum to 1, of which the prediction has the largest."""
    prob = F.col("probability")
    return out.select("vec_id", F.col("label").cast("int").alias("label"), F.size(prob).alias("classes"),
                      F.round(F.aggregate(prob, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                      (F.element_at(prob, F.col("prediction") + 1) == F.array_max(prob)).alias("is_largest"))


def _sql_prediction_facts() -> str:
    return ("SELECT vec_id, CAST(label AS INTEGER) AS label, CAST((SELECT max(label) + 1 FROM embeddings WHERE " + _sql_hash("vec_id") +
            " >= 2000) AS INTEGER) AS classes, 1.0::DOUBLE AS total, TRUE AS is_largest FROM embeddings WHERE " + _sql_hash("vec_id") + " < 2000")


def _sql_hash(key: str) -> str:
    return f"('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 10000"


def q_predict(spark, d):
    model, test = _emb_model(spark, d)
    return _prediction_facts(MD.predict(model, test, keep=("vec_id", "label")))


def q_explain_topk(spark, d):
    model, test = _emb_model(spark, d)
    long = EX.explain(MD.forest(model), test, "vec_id", EMB_FEATURES, "label", predicted_only=True).checkpoint()
    # additive: the model's own probability of the predicted class is the base value plus all contributions
    sums = EX.explain_predicted(long).groupBy("row_key", "predicted_class").agg((F.sum("shap_value") + F.first("base_value")).alias("sum"))
    own = MD.predict(model, test, keep=("vec_id",)).select(F.col("vec_id").cast("string").alias("row_key"), "probability")
    checked = sums.join(own, "row_key").select("row_key", (F.abs(F.element_at("probability", (F.col("predicted_class") + 1).cast("int")) - F.col("sum")) < 1e-9).alias("additive"))
    top = EX.explain_topk(long, 5)
    size = F.abs("shap_value")
    before = F.lag(size).over(Window.partitionBy("row_key").orderBy("rank"))
    return top.withColumn("in_order", F.coalesce(before >= size, F.lit(True))).join(checked, "row_key") \
        .select("row_key", "true_class", "rank", "in_order", "additive", F.col("effect").isin("increased", "decreased").alias("labelled"))


def _sql_explain_topk() -> str:
    return ("SELECT CAST(vec_id AS VARCHAR) AS row_key, CAST(label AS VARCHAR) AS true_class, r.rank, TRUE AS in_order, TRUE AS additive, TRUE AS labelled "
            "FROM embeddings, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS rank) r WHERE " + _sql_hash("vec_id") + " < 2000")


def q_explain_global(spark, d):
    model, test = _emb_model(spark, d)
    long = EX.explain(MD.forest(model), test, "vec_id", EMB_FEATURES, "label")
    return EX.explain_global(long).select("feature_name", "class", (F.col("mean_abs_shap") >= 0).alias("valid"))


#: Rounds and depth of the registered multiclass models; the library's defaults are 50 and 6.
SOFTMAX = {"rounds": 5, "max_depth": 3}


def _softmax_model(spark, d):
    data = FE.split_hash(embeddings_frame(spark, d), "vec_id", 0.2, 42)
    return BO.train_softmax(data.where(F.col("split") == "train"), EMB_FEATURES, "label", **SOFTMAX), data.where(F.col("split") == "test")


def q_softmax_importance(spark, d):
    """ML5, ML6 for multiclass boosting: facts of the importances."""
    return _importance_facts(BO.importances_softmax(_softmax_model(spark, d)[0], spark))


def q_softmax_predict(spark, d):
    """ML7 for multiclass boosting: facts of the probabilities of every test row."""
    model, test = _softmax_model(spark, d)
    return _prediction_facts(BO.predict_softmax(model, test, keep=("vec_id", "label")))


def q_softmax_values(spark, d):
    """ML7 for multiclass boosting: prediction, probabilities and margins of every test row."""
    model, test = _softmax_model(spark, d)
    return BO.predict_softmax(model, test, keep=("vec_id", "label"))


def q_importance_values(spark, d):
    """ML6: the importances themselves."""
    return MD.importances(_emb_model(spark, d)[0], EMB_FEATURES)


def q_prediction_values(spark, d):
    """ML7: prediction and probabilities of every test row."""
    model, test = _emb_model(spark, d)
    return MD.predict(model, test, keep=("vec_id", "label"))


def q_explanation_values(spark, d):
    """ML8, SO4: the five largest contributions to each test row's predicted class."""
    model, test = _emb_model(spark, d)
    return EX.explain_topk(EX.explain(MD.forest(model), test, "vec_id", EMB_FEATURES, "label"), 5)


def q_explain_global_sums(spark, d):
    """ML9: mean contributions by feature and class, with a fact that can fail: those of a class add up to its mean probability less the base value."""
    model, test = _emb_model(spark, d)
    long = EX.explain(MD.forest(model), test, "vec_id", EMB_FEATURES, "label")
    means = long.groupBy("class", "feature_name").agg(F.avg("shap_value").alias("mean"), F.first("base_value").alias("base"))
    sums = means.groupBy("class").agg(F.sum("mean").alias("total"), F.first("base").alias("base"), F.count("*").alias("features"))
    own = MD.predict(model, test).select(F.posexplode("probability").alias("class", "p")).groupBy("class").agg(F.avg("p").alias("p"), F.count("*").alias("rows"))
    return sums.join(own.withColumn("class", F.col("class").cast("long")), "class") \
        .select("class", "features", "rows", (F.abs(F.col("total") - (F.col("p") - F.col("base"))) < 1e-9).alias("additive"))


def _sql_explain_global_sums() -> str:
    return ("SELECT c.i AS class, 64::BIGINT AS features, (SELECT count(*) FROM embeddings WHERE " + _sql_hash("vec_id") + " < 2000) AS rows, TRUE AS additive "
            "FROM range((SELECT max(label) + 1 FROM embeddings WHERE " + _sql_hash("vec_id") + " >= 2000)) c(i)")


def _sql_explain_global() -> str:
    return ("SELECT 'f' || f.i AS feature_name, c.i AS class, TRUE AS valid FROM range(64) f(i), "
            "range((SELECT max(label) + 1 FROM embeddings WHERE " + _sql_hash("vec_id") + " >= 2000)) c(i)")


def q_end_to_end(spark, d):
    """ML10 from raw text: three header rows above generic columns (names in the third, one repeated), decimal commas; kinds are found
    from the data and one hint."""
    e = embeddings_frame(spark, d)
    text = e.select("vec_id", F.col("label").cast("string"), F.concat(F.lit("b"), F.col("vec_id") % 4).alias("bucket"),
                    *[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in EMB_FEATURES])
    cols = text.columns[1:]
    names = ["label", "bucket", *EMB_FEATURES[:-1], EMB_FEATURES[0]]                 # the last column repeats a name
    rows = [F.struct(F.lit(r - 3).cast("long").alias("vec_id"), *[F.lit(("", f"group {i % 3}", names[i])[r]).alias(c) for i, c in enumerate(cols)]) for r in range(3)]
    head = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    hints = spark.createDataFrame([("bucket", "categorical")], "key string, kind string")
    _, imp, _, _ = MD.end_to_end(head.unionByName(text), "vec_id", "label", hints=hints, n_header=3, **FOREST)
    return _importance_facts(imp)


def _sql_end_to_end() -> str:
    return _sql_importance_facts("SELECT 'num__f' || CASE WHEN i = 63 THEN '0_2' ELSE CAST(i AS VARCHAR) END AS feature FROM range(64) r(i) "
                                 "UNION ALL SELECT DISTINCT 'cat__bucket_b' || CAST(vec_id % 4 AS VARCHAR) FROM embeddings")


def q_mean_median(spark, d):
    out = Q.mean_median(orders_gaps(spark, d))
    return out.select("column", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


def q_first_values(spark, d):
    return P.first_values(orders_gaps(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice",
                                                     "o_orderpriority"), "o_orderkey", n=3)


def _sql_split_hash() -> str:
    return ("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT "
            "% 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM orders")


def _sql_standardize() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_const"]
    # "+ 0.0" turns DuckDB's -0.0 after rounding into 0.0, as Spark's round gives
    exprs = ", ".join(f"round(({c} - (SELECT avg({c}) FROM g)) / (SELECT CASE WHEN coalesce(stddev_pop({c}), 0) = 0 "
                      f"THEN 1.0 ELSE stddev_pop({c}) END FROM g), 6) + 0.0 AS {c}" for c in cols)
    return (f"WITH g AS (SELECT *, 1.0::DOUBLE AS l_const FROM {LINEITEM_GAPS_SQL})\n"
            f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {exprs} FROM g")


def _sql_onehot() -> str:
    return (f"WITH g AS {ORDERS_GAPS_SQL}\n"
            "SELECT o_orderkey, 'cat__o_orderpriority_' || coalesce(o_orderpriority, 'nan') AS feature, 1.0::DOUBLE AS value "
            "FROM g UNION ALL SELECT o_orderkey, 'cat__o_orderstatus_' || coalesce(o_orderstatus, 'nan'), 1.0::DOUBLE FROM g")


def _sql_feature_matrix() -> str:
    return (f"WITH g AS {ORDERS_GAPS_SQL}\n"
            "SELECT o_orderkey, 'num__o_totalprice' AS feature, round((o_totalprice - (SELECT avg(o_totalprice) FROM g)) "
            "/ (SELECT stddev_pop(o_totalprice) FROM g), 6) + 0.0 AS value FROM g UNION ALL "
            "SELECT o_orderkey, 'cat__o_orderpriority_' || coalesce(o_orderpriority, 'nan'), 1.0 FROM g")


def _sql_impute_knn() -> str:
    return """WITH b AS (SELECT p_partkey AS id,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS x0,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS x1,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 97) * 1.5 END AS x2 FROM part),
cs AS (SELECT * FROM (VALUES (0), (1), (2)) t(c)),
r AS (SELECT b.id AS rid, x0 AS r0, x1 AS r1, x2 AS r2, c FROM b, cs
      WHERE (c = 0 AND x0 IS NULL) OR (c = 1 AND x1 IS NULL) OR (c = 2 AND x2 IS NULL)),
d AS (SELECT * FROM (SELECT b.id AS did, x0 AS d0, x1 AS d1, x2 AS d2, c,
      CASE c WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS y FROM b, cs) WHERE y IS NOT NULL),
p AS (SELECT rid, r.c, did, y,
      (CASE WHEN r0 IS NOT NULL AND d0 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN r1 IS NOT NULL AND d1 IS NOT NULL
       THEN 1 ELSE 0 END + CASE WHEN r2 IS NOT NULL AND d2 IS NOT NULL THEN 1 ELSE 0 END) AS ncom,
      0.0 + CASE WHEN r0 IS NOT NULL AND d0 IS NOT NULL THEN (r0 - d0) ** 2 ELSE 0.0 END
          + CASE WHEN r1 IS NOT NULL AND d1 IS NOT NULL THEN (r1 - d1) ** 2 ELSE 0.0 END
          + CASE WHEN r2 IS NOT NULL AND d2 IS NOT NULL THEN (r2 - d2) ** 2 ELSE 0.0 END AS sq
      FROM r JOIN d ON r.c = d.c),
q AS (SELECT rid, c, y, row_number() OVER (PARTITION BY rid, c ORDER BY sqrt(3.0 / ncom * sq), did) AS rk
      FROM p WHERE ncom > 0),
f AS (SELECT rid, c, avg(y) AS fill FROM q WHERE rk <= 3 GROUP BY rid, c)
SELECT id AS p_partkey,
  round(coalesce(x0, (SELECT fill FROM f WHERE f.rid = b.id AND f.c = 0), (SELECT avg(x0) FROM b)), 6) AS p_size,
  round(coalesce(x1, (SELECT fill FROM f WHERE f.rid = b.id AND f.c = 1), (SELECT avg(x1) FROM b)), 6) AS p_retailprice,
  round(coalesce(x2, (SELECT fill FROM f WHERE f.rid = b.id AND f.c = 2), (SELECT avg(x2) FROM b)), 6) AS m3
FROM b"""


def _sql_mean_median() -> str:
    parts = [f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median "
             "FROM g" for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    return f"WITH g AS {ORDERS_GAPS_SQL}\n" + _union(parts)


def _sql_first_values() -> str:
    cols = {"o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
            "o_orderpriority": "o_orderpriority"}
    parts = [f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY o_orderkey) AS rank, "
             f"coalesce({e}, '') AS value FROM h" for c, e in cols.items()]
    return f"WITH g AS {ORDERS_GAPS_SQL}, h AS (SELECT * FROM g ORDER BY o_orderkey LIMIT 3)\n" + _union(parts)


# --------------------------------------------------------------------------- method choice, report hints

def q_base_methods(spark, d):
    out = I.base_methods(orders_auto(spark, d), AUTO_CONFIG)
    return out.select("position", "column", "n_unique", F.round("std", 4).alias("std"), "precision", "rows", "method")


def q_report_hints(spark, d):
    doc = _t(spark, d, "documents").select(F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("name"),
                                          F.col("text").alias("description"))
    return CL.hints_from_report(doc, cat_patterns=CL.CATEGORICAL_PATTERNS + DOC_CAT_EXTRA,
                                num_patterns=CL.NUMERICAL_PATTERNS + DOC_NUM_EXTRA)


def _sql_base_methods() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_price_k", "o_orderdate", "o_none"]
    numeric = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "dbl", "o_price_k": "dbl", "o_none": "dbl"}
    parts = []
    for i, c in enumerate(cols):
        kind = numeric.get(c)
        if kind:
            prec = ("CASE WHEN count(" + c + ") > 0 THEN 0 END" if kind == "int" else
                    f"max(CASE WHEN {c} IS NOT NULL THEN greatest(1, length(split_part(CAST({c} AS VARCHAR), '.', 2))) END)")
            parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, "
                         f"round(stddev_samp({c}), 4) AS std, CAST({prec} AS INTEGER) AS precision, count(*) AS rows "
                         "FROM g")
        else:
            parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, "
                         "CAST(NULL AS DOUBLE) AS std, CAST(NULL AS INTEGER) AS precision, count(*) AS rows FROM g")
    return (f"WITH g AS {ORDERS_AUTO_SQL}, s AS ({_union(parts)})\n"
            "SELECT position, \"column\", n_unique, std, precision, rows, CASE WHEN \"column\" = 'o_custkey' THEN 'median' "
            "WHEN n_unique < 0.2 * rows AND std > 1 AND precision > 0 THEN 'mean' ELSE 'mode' END AS method FROM s")


def _sql_report_hints() -> str:
    key_n = sql_match_key("concat_ws(' ', source, CAST(doc_id AS VARCHAR))")
    cat = _sql_any("k", CL.CATEGORICAL_PATTERNS + DOC_CAT_EXTRA)
    num = _sql_any("k", CL.NUMERICAL_PATTERNS + DOC_NUM_EXTRA)
    return (f"WITH t AS (SELECT {key_n} AS key, {sql_match_key('text')} AS k FROM documents)\n"
            f"SELECT key, CASE WHEN {cat} AND NOT {num} THEN 'categorical' ELSE 'numerical' END AS kind FROM t "
            f"WHERE key <> '' AND (({cat}) <> ({num}))")


# --------------------------------------------------------------------------- multi-header reads, flattening

def q_parquet_header_rows(spark, d):
    """IO1 on a Parquet file: its first three rows (by ``_metadata.row_index``)
    are header rows; row 2 names the columns; the body in long form.  The table is written in four files by key first: only
    the first of them has header rows."""
    c = _t(spark, d, "customer")
    path = _scratch(spark, "header")
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(path)
    header, body = IO.read_parquet_multi_header(spark, path, 3)
    names = {r["col_idx"]: r["name"] for r in HD.pick_names(header).collect()}  # one per column
    cols = [c for c in body.columns if not c.startswith("_")]
    named = body.select(F.col("c_custkey").cast("long").alias("key"), *[col(c).alias(names[i]) for i, c in enumerate(cols)])
    return named.unpivot(["key"], [col(names[i]) for i in range(len(cols))], "name", "value")


def q_flatten_levels(spark, d):
    return HD.flatten_levels(customer_header(spark, d), "_", "nan")


def _sql_parquet_header_rows() -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS v{i}" for i, c in enumerate(cols))
    names = ", ".join(f"{sql_normalize(f'max(CASE WHEN rn = 2 THEN v{i} END)')} AS n{i}" for i in range(len(cols)))
    body = _union([f"SELECT t.key, h.n{i} AS name, t.v{i} AS value FROM t, h WHERE t.rn >= 3"
                   for i in range(len(cols))])
    return (f"WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS key, {casts}, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer),\n"
            f"h AS (SELECT {names} FROM t)\n" + body)


def _sql_flatten_levels() -> str:
    return (_sql_header_cells() + "\n"
            "SELECT col_idx, string_agg(cell, '_' ORDER BY row_idx) AS name FROM hc WHERE cell <> 'nan' "
            "GROUP BY col_idx")


# --------------------------------------------------------------------------- ranked pairs

def q_corr_ranked(spark, d):
    out = C.ranked_pairs(lineitem_corr(spark, d))
    return out.select("rank", "feature_1", "feature_2", F.round("correlation", 6).alias("correlation"))


def _sql_corr_ranked() -> str:
    return ("SELECT row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, feature_1, feature_2) AS rank, "
            f"feature_1, feature_2, round(correlation, 6) AS correlation FROM ({_sql_corr_long()})")


# --------------------------------------------------------------------------- exact split

def q_split_exact(spark, d):
    return FE.split_hash(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42, exact=True)


def _sql_split_exact() -> str:
    return ("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || "
            "CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) <= ceil(0.2 * count(*) OVER ()) THEN 'test' "
            "ELSE 'train' END AS split FROM orders")


# --------------------------------------------------------------------------- boosted per-class model

def q_train_boosted_importance(spark, d):
    data = FE.split_hash(embeddings_frame(spark, d), "vec_id", 0.2, 42)
    model = MD.train_boosted(data.where(F.col("split") == "train"), EMB_FEATURES, "label", **BOOSTED)
    return _importance_facts(MD.importances(model, EMB_FEATURES))


# --------------------------------------------------------------------------- type report lines

def q_type_report_lines(spark, d):
    """IO11 second format: per column of ``part`` (as text) its kind and three
    seeded samples, formatted as report lines and parsed back."""
    pt = part_text(spark, d)
    kinds = P.numeric_ratio(pt).select("position", "column", "kind")
    samples = (P.sample_per_column(pt, "p_partkey", PART_TEXT_COLS[1:], n=3, seed=42)
               .groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                   F.struct("sample_rank", "value"))), lambda x: x["value"]), ", ").alias("samples")))
    info = kinds.join(samples, "column")  # one row per column on both sides
    lines = RP.format_type_lines(info)
    numbered = lines.select(F.regexp_extract("line", r"^Column (\d+):", 1).cast("int").alias("column_no"), "line")
    return RP.parse_type_lines(lines).join(numbered, "column_no")


def _sql_type_report_lines() -> str:
    kinds = _union([f"SELECT {i} AS position, '{c}' AS \"column\", CASE WHEN count({c}) > count({sql_to_number(c)}) "
                    f"THEN 'text' ELSE 'numeric' END AS kind FROM g" for i, c in enumerate(PART_TEXT_COLS)])
    long = _union([f"SELECT p_partkey, '{c}' AS \"column\", {c} AS value FROM g WHERE {c} IS NOT NULL"
                   for c in PART_TEXT_COLS[1:]])
    return (f"WITH g AS {PART_TEXT_SQL}, k AS ({kinds}), l AS ({long}),\n"
            "r AS (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY "
            "md5(concat_ws(':', '42', \"column\", p_partkey)), p_partkey) AS rk FROM l),\n"
            "s AS (SELECT \"column\", string_agg(value, ', ' ORDER BY rk) AS samples FROM r WHERE rk <= 3 GROUP BY 1)\n"
            "SELECT position + 1 AS column_no, k.\"column\" AS name, kind AS type, samples, "
            "printf('Column %d: Name=''%s'', Type=''%s'', Samples=%s', position + 1, k.\"column\", kind, samples) AS line "
            "FROM k JOIN s ON k.\"column\" = s.\"column\"")


# --------------------------------------------------------------------------- sources and sinks: write, read back

def _scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _customer_text(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.col("c_name"), F.lit(', "x"; é')).alias("c_name"), "c_acctbal", _null_if(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))


CUSTOMER_TEXT_SQL = ("SELECT c_custkey, c_name || ', \"x\"; é' AS c_name, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END "
                     "AS c_mktsegment FROM customer")


def q_csv_round_trip(spark, d):
    """IO4, IO3: written as CSV, read as a plain table."""
    df, path = _customer_text(spark, d), _scratch(spark, "csv")
    IO.write_csv(df, path)
    return IO.read_table(spark, path, "csv", df.schema, escape="\\")


def q_parquet_round_trip(spark, d):
    """IO5: written as Parquet by segment, read as a plain table (IO3)."""
    path = _scratch(spark, "parquet")
    if not IO.write_parquet(_customer_text(spark, d), path, partition_by=["c_mktsegment"]):
        raise ValueError("the table was not written")
    return IO.read_table(spark, path).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def q_report_round_trip(spark, d):
    """IO10: a result table as CSV and as Parquet."""
    rate, path = P.fill_rate(orders_gaps(spark, d)), _scratch(spark, "report")
    IO.write_report(rate, path + "/a", "csv")
    IO.write_report(rate, path + "/b")
    a = IO.read_table(spark, path + "/a", "csv", rate.schema)
    return a.withColumn("fmt", F.lit("csv")).unionByName(IO.read_table(spark, path + "/b").withColumn("fmt", F.lit("parquet")))


def q_metadata_round_trip(spark, d):
    """IO6: final names and header rows, read back as ``col_idx, name, row0..row2``."""
    header, path = customer_header(spark, d), _scratch(spark, "meta")
    names = [r["name"] for r in HD.pick_names(header).orderBy("col_idx").collect()]        # one per column
    IO.write_metadata(spark, names, header, path)
    got = spark.createDataFrame(list(enumerate(IO.read_json_value(spark, path + "/columns_normalized"))), "col_idx int, name string")
    rows = IO.read_table(spark, path + "/header_rows", "csv", "row_idx int, " + ", ".join(f"`{i}` string" for i in range(len(names))))
    long = rows.unpivot(["row_idx"], [col(str(i)) for i in range(len(names))], "c", "cell")
    wide = long.groupBy(F.col("c").cast("int").alias("col_idx")).agg(*[F.coalesce(F.max(F.when(F.col("row_idx") == r, F.col("cell"))), F.lit("")).alias(f"row{r}") for r in range(3)])
    return got.join(wide, "col_idx")


def q_bundle_round_trip(spark, d):
    """IO7, IO8: a data set split into train and test with its description."""
    data, path = FE.split_hash(_customer_text(spark, d), "c_custkey"), _scratch(spark, "bundle")
    IO.save_bundle(spark, path, data, {"target": "c_mktsegment", "numerical": ["c_acctbal"]}, partition_by=["split"])
    back, meta = IO.load_bundle(spark, path)
    return back.select("c_custkey", "split", *[F.col(c) for c in meta["numerical"]], F.col(meta["target"]).alias("target"))


def q_model_round_trip(spark, d):
    """IO9: a saved and loaded model gives the same probabilities."""
    model, test = _emb_model(spark, d)
    path = _scratch(spark, "model")
    IO.save_model(model, path)
    a = MD.predict(model, test, keep=("vec_id",)).select("vec_id", F.col("probability").alias("p"))
    b = MD.predict(IO.load_model(path), test, keep=("vec_id",))
    return a.join(b, "vec_id").select("vec_id", (F.col("p") == F.col("probability")).alias("same"))


def q_header_rows_round_trip(spark, d):
    """IM12: filled data beside their untouched header rows; both read back in one long table."""
    header, path = customer_header(spark, d), _scratch(spark, "filled")
    data = I.impute_constant(_customer_text(spark, d), {"c_mktsegment": "none"})
    IO.write_with_header_rows(spark, header, data, path)
    rows = IO.read_table(spark, path + "/header_rows", "csv", "row_idx long, `0` string, `1` string, `2` string, `3` string")
    head = rows.select(F.lit("header").alias("part"), F.col("row_idx").alias("row"), F.coalesce(F.col("3"), F.lit("")).alias("last"))
    return head.unionByName(IO.read_table(spark, path + "/data").select(F.lit("data").alias("part"), F.col("c_custkey").cast("long").alias("row"), F.col("c_mktsegment").alias("last")))


def _sql_header_rows_round_trip() -> str:
    return (_sql_header_cells() + "\nSELECT 'header' AS part, CAST(row_idx AS BIGINT) AS row, cell AS last FROM hc WHERE col_idx = 3 "
            "UNION ALL SELECT 'data', CAST(c_custkey AS BIGINT), CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_mktsegment END FROM customer")


def _sql_metadata_round_trip() -> str:
    cells = ", ".join(f"max(CASE WHEN row_idx = {r} THEN cell END) AS row{r}" for r in range(3))
    return (f"WITH n AS ({_sql_pick_names()}), w AS ({_sql_header_cells()} SELECT col_idx, {cells} FROM hc GROUP BY col_idx)\n"
            "SELECT n.col_idx, n.name, row0, row1, row2 FROM n JOIN w ON n.col_idx = w.col_idx")


def q_csv_multi_header(spark, d):
    """IO1 on text in several files: three header rows in the first, separator ``;``, quoted separators."""
    body = _customer_text(spark, d).select(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), "c_mktsegment")
    path = _scratch(spark, "lines")
    quoted = F.concat(F.lit('"'), F.replace(F.col("c_name"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = body.select(F.col("c_custkey").cast("long").alias("k"), F.concat_ws(";", "c_custkey", quoted, "c_acctbal", F.coalesce("c_mktsegment", F.lit(""))).alias("value"))
    head = spark.sql("SELECT * FROM VALUES (-3L, 'x;;y;'), (-2L, 'Id;Person;;'), (-1L, ';«Name»;Balance;Segment') AS t(k, value)")
    lines.unionByName(head).repartitionByRange(5, "k").sortWithinPartitions("k").select("value").write.text(path)
    header, rows = IO.read_multi_header(spark, path, 3, sep=";")
    names = [r["name"] for r in HD.pick_names(header).orderBy("col_idx").collect()]        # one per column
    named = IO.apply_names(rows, names)
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("_file").orderBy("_offset")))
    return first.select(F.col(names[0]).cast("long").alias("key"), F.concat_ws("|", *[F.col(f"`{n}`") for n in names]).alias("cells"), F.lit("|".join(names)).alias("names"))


def _sql_csv_multi_header() -> str:
    return (f"SELECT CAST(c_custkey AS BIGINT) AS key, concat_ws('|', c_custkey, c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment) AS cells, "
            f"'Id|\"Name\"|Balance|Segment' AS names FROM ({CUSTOMER_TEXT_SQL})")


def q_csv_quoted_newlines(spark, d):
    """IO1 with newlines inside quoted cells."""
    path = _scratch(spark, "newlines")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit('\n""second"" line"')).alias("value"))
    head = spark.sql("SELECT * FROM VALUES (-2, 'a,\"b\nc\"'), (-1, 'Key,Name') AS t(k, value)")
    c.unionByName(head).repartitionByRange(2, "k").sortWithinPartitions("k").select("value").write.text(path)
    header, rows = IO.read_multi_header(spark, path, 2, multi_line=True)
    return rows.select(F.col("_c0").cast("long").alias("key"), F.col("_c1").alias("text"))


def q_csv_wide_records(spark, d):
    """IO1: records with more cells than the header, and newlines inside quotes over many splits."""
    path, k = _scratch(spark, "wide"), F.col("o_orderkey")
    more = F.when(k % 11 == 0, F.concat(F.lit(',"extra\n'), k.cast("string"), F.lit('"'))).when(k % 13 == 0, F.lit(",,last")).otherwise("")
    o = _t(spark, d, "orders").select(k.alias("k"), F.concat(k, F.lit(',"'), F.col("o_orderpriority"), F.lit('\n, ""x"""'), more).alias("value"))
    head = spark.sql("SELECT * FROM VALUES (-2L, 'a,\"b\nc\"'), (-1L, 'Key,Name') AS t(k, value)")
    o.unionByName(head).repartitionByRange(2, "k").sortWithinPartitions("k").select("value").write.text(path)
    header, rows = IO.read_multi_header(spark, path, 2, multi_line=True)
    return rows.select(F.col("_c0").cast("long").alias("key"), F.col("_c1").alias("text"), F.col("_c2").alias("third"), F.col("_c3").alias("fourth"))


# --------------------------------------------------------------------------- options

def q_placeholder_names(spark, d):
    """PR2, PR3: cells that count as empty, and a default name."""
    h = customer_header(spark, d)
    odd = h.withColumn("cell", F.when(F.col("col_idx") == 1, F.lit("nan")).when((F.col("col_idx") == 2) & (F.col("row_idx") > 0), F.lit("Unnamed: 2_level")).otherwise(F.col("cell")))
    return HD.pick_names(odd, placeholder_regex=HD.PLACEHOLDER_PATTERN, default="column {idx}")


def _sql_placeholder_names() -> str:
    return (_sql_header_cells() + ", o AS (SELECT col_idx, row_idx, CASE WHEN col_idx = 1 THEN 'nan' WHEN col_idx = 2 AND row_idx > 0 THEN "
            "'Unnamed: 2_level' ELSE cell END AS cell FROM hc), e AS (SELECT col_idx, row_idx, CASE WHEN cell = '' OR cell = 'nan' OR cell LIKE 'Unnamed: 2%' "
            "THEN NULL ELSE cell END AS cell FROM o)\nSELECT col_idx, coalesce(arg_max(cell, row_idx) FILTER (cell IS NOT NULL), 'column ' || col_idx) AS name, "
            "CAST(coalesce(max(row_idx) FILTER (cell IS NOT NULL), 2) AS INTEGER) AS used_row FROM e GROUP BY col_idx")


def q_split_xy(spark, d):
    """PR8: both sides, joined again by the kept key."""
    x, y = CO.split_xy(orders_gaps(spark, d), "o_orderpriority", keep=["o_orderkey"])
    return x.select("o_orderkey", "o_totalprice").join(y, "o_orderkey").withColumn("columns", F.lit(",".join(x.columns)))


def q_existing_columns(spark, d):
    """PR12: of the wanted names those that exist, in the order asked for."""
    o = _t(spark, d, "orders")
    return o.select(*[col(c) for c in CO.existing(o, ["o_orderstatus", "nothing", "o_orderkey", "O_CUSTKEY"])])


def q_impute_policy_knn(spark, d):
    """IM11 with a knn rule: the related columns are filled enough, so they are imputed together."""
    out = I.impute_policy(part_knn(spark, d), [(["p_size", "p_retailprice", "m3"], "knn", 50.0)], default_numeric=None, key="p_partkey", k=3)
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("p_size", "p_retailprice", "m3")])


def q_impute_integers(spark, d):
    """IM1, IM2, IM6 on integer columns: the filled columns are doubles."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", *[_null_if(k % m == 0, F.col("o_custkey")).alias(c) for c, m in (("mean_", 7), ("median_", 5), ("line_", 3))])
    out = O.interpolate(I.impute_median(I.impute_mean(o, ["mean_"]), ["median_"]), ["line_"], "o_orderkey")
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("mean_", "median_", "line_")])


def _sql_impute_integers() -> str:
    return ("WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS b, "
            "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS c, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),\n"
            "w AS (SELECT *, last_value(c IGNORE NULLS) OVER p AS pv, max(CASE WHEN c IS NOT NULL THEN pos END) OVER p AS pp, "
            "first_value(c IGNORE NULLS) OVER n AS nv, min(CASE WHEN c IS NOT NULL THEN pos END) OVER n AS np FROM g "
            "WINDOW p AS (ORDER BY pos ROWS UNBOUNDED PRECEDING), n AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))\n"
            "SELECT o_orderkey, round(coalesce(CAST(a AS DOUBLE), (SELECT avg(a) FROM g)), 6) AS mean_, "
            "round(coalesce(CAST(b AS DOUBLE), (SELECT quantile_cont(b, 0.5) FROM g)), 6) AS median_, "
            "round(CASE WHEN c IS NOT NULL THEN CAST(c AS DOUBLE) WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN CAST(pv AS DOUBLE) "
            "ELSE pv + (nv - pv) * ((pos - pp)::DOUBLE / (np - pp)) END, 6) AS line_ FROM w")


def q_sign_labels(spark, d):
    """TX9: the sign label of every balance."""
    return _t(spark, d, "customer").select("c_custkey", TX.sign_label(F.col("c_acctbal")).alias("sign"))


# --------------------------------------------------------------------------- registry

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the type-aware imputation of ``orders`` (injected gaps in five
    columns, profile job -> fill plan -> one select) at sf0.001."""
    return q_impute_auto(spark, SMOKE_DIR)


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "fill_rate": q_fill_rate,
        "missing_report_top20": q_missing_report_top20,
        "total_missing": q_total_missing,
        "column_profile": q_column_profile,
        "type_profile": q_type_profile,
        "type_totals": q_type_totals,
        "describe_object": q_describe_object,
        "mode_by_string": q_mode_by_string,
        "mode_by_value": q_mode_by_value,
        "group_counts": q_group_counts,
        "sample_per_column": q_sample_per_column,
        "numeric_ratio": q_numeric_ratio,
        "normalize_text": q_normalize_text,
        "match_key": q_match_key,
        "decimal_comma": q_decimal_comma,
        "ffill": q_ffill,
        "ffill_by_user": q_ffill_by_user,
        "ffill_limit": q_ffill_limit,
        "bfill": q_bfill,
        "bfill_limit_by_user": q_bfill_limit_by_user,
        "interpolate_linear": q_interpolate_linear,
        "interpolate_time": q_interpolate_time,
        "interpolate_both_by_user": q_interpolate_both_by_user,
        "interpolate_nearest": q_interpolate_nearest,
        "row_slice": q_row_slice,
        "skip_rows": q_skip_rows,
        "positions_by_user": q_positions_by_user,
        "impute_mean": q_impute_mean,
        "impute_median": q_impute_median,
        "impute_mode": q_impute_mode,
        "impute_constant": q_impute_constant,
        "drop_rows": q_drop_rows,
        "impute_auto": q_impute_auto,
        "impute_log": q_impute_log,
        "impute_summary": q_impute_summary,
        "impute_policy": q_impute_policy,
        "corr_pairs": q_corr_pairs,
        "corr_pairs_moments": q_corr_pairs_moments,
        "corr_matrix": q_corr_matrix,
        "posthoc_stats": q_posthoc_stats,
        "posthoc_dscf": q_posthoc_dscf,
        "pick_names": q_pick_names,
        "header_sources": q_header_sources,
        "dedupe_names": q_dedupe_names,
        "find_target": q_find_target,
        "promote_header": q_promote_header,
        "drop_identifier": q_drop_identifier,
        "report_lines": q_report_lines,
        "keep_filled": q_keep_filled,
        "select_numeric": q_select_numeric,
        "drop_text_columns": q_drop_text_columns,
        "classify": q_classify,
        "classify_text": q_classify_text,
        "name_cues": q_name_cues,
        "split_hash": q_split_hash,
        "standardize": q_standardize,
        "onehot_long": q_onehot_long,
        "feature_matrix_long": q_feature_matrix_long,
        "impute_knn": q_impute_knn,
        "mean_median": q_mean_median,
        "first_values": q_first_values,
        "train_importance": q_train_importance,
        "predict": q_predict,
        "explain_topk": q_explain_topk,
        "explain_global": q_explain_global,
        "end_to_end": q_end_to_end,
        "base_methods": q_base_methods,
        "report_hints": q_report_hints,
        "parquet_header_rows": q_parquet_header_rows,
        "flatten_levels": q_flatten_levels,
        "corr_ranked": q_corr_ranked,
        "split_exact": q_split_exact,
        "train_boosted_importance": q_train_boosted_importance,
        "importance_values": q_importance_values,
        "softmax_importance": q_softmax_importance,
        "softmax_predict": q_softmax_predict,
        "softmax_values": q_softmax_values,
        "prediction_values": q_prediction_values,
        "explanation_values": q_explanation_values,
        "explain_global_sums": q_explain_global_sums,
        "type_report_lines": q_type_report_lines,
        "csv_round_trip": q_csv_round_trip,
        "parquet_round_trip": q_parquet_round_trip,
        "report_round_trip": q_report_round_trip,
        "metadata_round_trip": q_metadata_round_trip,
        "bundle_round_trip": q_bundle_round_trip,
        "model_round_trip": q_model_round_trip,
        "header_rows_round_trip": q_header_rows_round_trip,
        "csv_multi_header": q_csv_multi_header,
        "csv_quoted_newlines": q_csv_quoted_newlines,
        "csv_wide_records": q_csv_wide_records,
        "mode_by_string_float": q_mode_by_string_float,
        "placeholder_names": q_placeholder_names,
        "split_xy": q_split_xy,
        "existing_columns": q_existing_columns,
        "impute_policy_knn": q_impute_policy_knn,
        "impute_integers": q_impute_integers,
        "sign_labels": q_sign_labels,
    }


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _sql_fill_rate() -> str:
    parts = []
    for i, c in enumerate(ORDERS_COLS):
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS filled, count(*) AS total, "
                     f"CAST(round(100.0 * count({c}) / count(*), 2) AS DOUBLE) AS percentage FROM g")
    return f"WITH g AS {ORDERS_GAPS_SQL}\n" + _union(parts)


def _sql_missing_report() -> str:
    parts = []
    for i, c in enumerate(ORDERS_COLS):
        parts.append(f"SELECT {i} AS pos, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
                     f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*), 6) AS missing_percentage, "
                     f"'{ORDERS_KIND[c]}' AS data_type FROM g")
    return (f"WITH g AS {ORDERS_GAPS_SQL}, r AS ({_union(parts)})\n"
            "SELECT \"column\", missing_count, missing_percentage, data_type FROM r "
            "ORDER BY missing_percentage DESC, pos LIMIT 20")


def _sql_total_missing() -> str:
    miss = " + ".join(f"(count(*) - count({c}))" for c in ORDERS_COLS)
    return (f"WITH g AS {ORDERS_GAPS_SQL}\n"
            f"SELECT CAST({miss} AS BIGINT) AS total_missing, CAST(count(*) * {len(ORDERS_COLS)} AS BIGINT) "
            "AS total_cells FROM g")


def _sql_column_profile() -> str:
    numeric = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
               "l_quantity": "dbl", "l_extendedprice": "dbl", "l_discount": "dbl", "l_tax": "dbl"}
    parts = []
    for i, c in enumerate(LINEITEM_COLS):
        kind = numeric.get(c)
        if kind:
            prec = ("CASE WHEN count(" + c + ") > 0 THEN 0 END" if kind == "int" else
                    f"max(CASE WHEN {c} IS NOT NULL THEN greatest(1, length(split_part(CAST({c} AS VARCHAR), '.', 2))) END)")
            parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", round(avg({c}), 4) AS mean, "
                         f"round(stddev_samp({c}), 4) AS std, CAST({prec} AS INTEGER) AS precision, "
                         f"count(DISTINCT {c}) AS n_unique FROM g")
        else:
            parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS mean, "
                         f"CAST(NULL AS DOUBLE) AS std, CAST(NULL AS INTEGER) AS precision, "
                         f"count(DISTINCT {c}) AS n_unique FROM g")
    return f"WITH g AS {LINEITEM_GAPS_SQL}\n" + _union(parts)


def _sql_type_profile() -> str:
    parts = []
    for i, c in enumerate(PART_TEXT_COLS):
        n = sql_to_number(c)
        int_like = f"abs({n} - round_even({n}, 0)) <= 1e-9 AND isfinite({n})"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null, count({n}) AS numeric, "
            f"round(CAST(count({n}) AS DOUBLE) / count(*), 6) AS ratio_numeric, "
            f"coalesce(bool_and(CASE WHEN {n} IS NOT NULL THEN {int_like} END), false) AS int_like, "
            f"CASE WHEN count({c}) > count({n}) THEN 'text' ELSE 'numeric' END AS kind, "
            f"count(DISTINCT {n}) AS n_unique_numeric FROM g")
    return f"WITH g AS {PART_TEXT_SQL}\n" + _union(parts)


def _sql_describe_object() -> str:
    cols = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority",
            "o_custkey": "CAST(o_custkey AS VARCHAR)"}
    long = _union([f"SELECT '{c}' AS \"column\", {e} AS value FROM g WHERE {e} IS NOT NULL"
                   for c, e in cols.items()])
    return (f"WITH g AS {ORDERS_GAPS_SQL}, l AS ({long}),\n"
            "f AS (SELECT \"column\", value, count(*) AS n FROM l GROUP BY 1, 2),\n"
            "r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rn FROM f)\n"
            "SELECT \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
            "max(CASE WHEN rn = 1 THEN value END) AS top, max(CASE WHEN rn = 1 THEN n END) AS freq "
            "FROM r GROUP BY 1")


def _sql_mode_by_string_float() -> str:
    cols = {"price": "CAST(p_retailprice AS FLOAT)", "tied": "CAST(CASE WHEN p_partkey % 2 = 0 THEN 12000000.0 ELSE 1.5 END AS FLOAT)",
            "tenths": "CAST(CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 7) / 10.0 END AS FLOAT)"}
    long = _union([f"SELECT '{c}' AS \"column\", CAST({v} AS VARCHAR) AS value FROM part WHERE {v} IS NOT NULL" for c, v in cols.items()])
    return (f"WITH f AS (SELECT \"column\", value, count(*) AS n FROM ({long}) GROUP BY 1, 2),\n"
            "m AS (SELECT \"column\", max(n) AS n FROM f GROUP BY 1)\n"
            "SELECT \"column\", min(value) AS mode, any_value(m.n) AS mode_count, count(*) AS tie_count FROM f JOIN m USING (\"column\", n) GROUP BY 1")


def _sql_mode(tie: str) -> str:
    cols = {"p_size": ("CAST(p_size AS VARCHAR)", "CAST(p_size AS DOUBLE)"),
            "p_brand": ("p_brand", "NULL"), "p_type": ("p_type", "NULL"),
            "p_retailprice": ("CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS VARCHAR)",
                              "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END"),
            "p_scaled": ("CAST(p_retailprice * pow(10.0, p_partkey % 30 - 12) AS VARCHAR)", "p_retailprice * pow(10.0, p_partkey % 30 - 12)"),
            "p_tied": ("CASE WHEN p_partkey % 2 = 0 THEN '12000000.0' ELSE '1.5' END", "CASE WHEN p_partkey % 2 = 0 THEN 12000000.0 ELSE 1.5 END")}
    long = _union([f"SELECT '{c}' AS \"column\", {s} AS value, {v} AS num FROM part WHERE {s} IS NOT NULL"
                   for c, (s, v) in cols.items()])
    order = "n DESC, num ASC NULLS LAST, value" if tie == "value" else "n DESC, value"
    return (f"WITH l AS ({long}),\n"
            "f AS (SELECT \"column\", value, any_value(num) AS num, count(*) AS n FROM l GROUP BY 1, 2),\n"
            f"r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY {order}) AS rn, "
            "max(n) OVER (PARTITION BY \"column\") AS mx FROM f)\n"
            "SELECT \"column\", max(CASE WHEN rn = 1 THEN value END) AS mode, max(CASE WHEN rn = 1 THEN n END) "
            "AS mode_count, count(CASE WHEN n = mx THEN 1 END) AS tie_count FROM r GROUP BY 1")


def _sql_group_counts() -> str:
    vals = ", ".join(f"('{a}', '{b}')" for a, b in STATUS_LABELS)
    return ("WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)\n"
            f"SELECT c.o_orderstatus, c.n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total, m.label FROM c "
            f"LEFT JOIN (VALUES {vals}) m(code, label) ON c.o_orderstatus = m.code")


def _sql_sample() -> str:
    cols = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type",
            "p_size": "CAST(p_size AS VARCHAR)", "p_retailprice": "CAST(p_retailprice AS VARCHAR)"}
    long = _union([f"SELECT p_partkey, '{c}' AS \"column\", {e} AS value FROM part" for c, e in cols.items()])
    return (f"WITH l AS ({long}),\n"
            "r AS (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY "
            "md5(concat_ws(':', '42', \"column\", CAST(p_partkey AS VARCHAR))), p_partkey) AS sample_rank FROM l)\n"
            "SELECT \"column\", sample_rank, value FROM r WHERE sample_rank <= 3")


def _sql_numeric_ratio() -> str:
    return f"SELECT \"column\", ratio_numeric, n_unique_numeric, int_like FROM ({_sql_type_profile()})"


def _sql_type_totals() -> str:
    return f"SELECT kind, count(*) AS n_columns FROM ({_sql_type_profile()}) GROUP BY 1"


def _sql_normalize_text() -> str:
    return (f"SELECT doc_id, {sql_normalize('text')} AS normalized, {sql_normalize('text', False)} AS name_form "
            f"FROM {DOCS_WRAPPED_SQL}")


def _sql_match_key() -> str:
    key = sql_match_key("text")
    prefix = TX.py_match_key(" «The")
    return (f"SELECT doc_id, {key} AS key, replace({key}, ' ', '') AS id_key, "
            f"starts_with({key}, '{prefix}') AS starts_the FROM {DOCS_WRAPPED_SQL}")


def _sql_decimal_comma() -> str:
    txt = "CASE WHEN p_partkey % 50 = 0 THEN 'n,a' ELSE replace(CAST(p_retailprice AS VARCHAR), '.', ',') END"
    return f"SELECT p_partkey, {txt} AS txt, {sql_to_number(f'replace({txt}, {chr(39)},{chr(39)}, {chr(39)}.{chr(39)})')} AS value FROM part"


def _own_oracle_sql() -> dict[str, str]:
    return {
        "fill_rate": _sql_fill_rate(),
        "missing_report_top20": _sql_missing_report(),
        "total_missing": _sql_total_missing(),
        "column_profile": _sql_column_profile(),
        "type_profile": _sql_type_profile(),
        "type_totals": _sql_type_totals(),
        "describe_object": _sql_describe_object(),
        "mode_by_string": _sql_mode("string"),
        "mode_by_value": _sql_mode("value"),
        "group_counts": _sql_group_counts(),
        "sample_per_column": _sql_sample(),
        "numeric_ratio": _sql_numeric_ratio(),
        "normalize_text": _sql_normalize_text(),
        "match_key": _sql_match_key(),
        "decimal_comma": _sql_decimal_comma(),
        "ffill": _sql_ordered("coalesce(value, pv)"),
        "ffill_by_user": _sql_ordered("coalesce(value, pv)", part="user_id"),
        "ffill_limit": _sql_ordered("coalesce(value, CASE WHEN pos - pp <= 2 THEN pv END)"),
        "bfill": _sql_ordered("coalesce(value, nv)"),
        "bfill_limit_by_user": _sql_ordered("coalesce(value, CASE WHEN np - pos <= 1 THEN nv END)", part="user_id"),
        "interpolate_linear": _sql_ordered(LINEAR_SQL),
        "interpolate_time": _sql_ordered(TIME_SQL, order="ts", x="CAST(epoch_us(ts) AS DOUBLE)"),
        "interpolate_both_by_user": _sql_ordered(BOTH1_SQL, part="user_id"),
        "interpolate_nearest": _sql_ordered(NEAREST_SQL),
        "row_slice": _sql_slice(),
        "skip_rows": _sql_skip(),
        "positions_by_user": _sql_positions(),
        "impute_mean": _sql_impute_simple("mean"),
        "impute_median": _sql_impute_simple("median"),
        "impute_mode": _sql_impute_simple("mode"),
        "impute_constant": _sql_impute_simple("constant"),
        "drop_rows": _sql_impute_simple("drop"),
        "impute_auto": _sql_impute_auto(),
        "impute_log": _sql_impute_log(),
        "impute_summary": _sql_impute_summary(),
        "impute_policy": _sql_impute_policy(),
        "corr_pairs": _sql_corr_pairs(),
        "corr_pairs_moments": _sql_corr_pairs(),
        "corr_matrix": _sql_corr_matrix(),
        "posthoc_stats": _sql_posthoc_stats(),
        "posthoc_dscf": _sql_posthoc_dscf(),
        "pick_names": _sql_pick_names(),
        "header_sources": _sql_header_sources(),
        "dedupe_names": _sql_dedupe(),
        "find_target": _sql_find_target(),
        "promote_header": _sql_promote_header(),
        "drop_identifier": "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "report_lines": _sql_report_lines(),
        "keep_filled": _sql_keep_filled(),
        "select_numeric": f"SELECT o_orderkey, o_totalprice FROM {ORDERS_GAPS_SQL}",
        "drop_text_columns": f"SELECT p_partkey, p_retailprice FROM {PART_TEXT_SQL}",
        "classify": _sql_classify(False),
        "classify_text": _sql_classify(True),
        "name_cues": _sql_name_cues(),
        "split_hash": _sql_split_hash(),
        "standardize": _sql_standardize(),
        "onehot_long": _sql_onehot(),
        "feature_matrix_long": _sql_feature_matrix(),
        "impute_knn": _sql_impute_knn(),
        "mean_median": _sql_mean_median(),
        "first_values": _sql_first_values(),
        "base_methods": _sql_base_methods(),
        "report_hints": _sql_report_hints(),
        "parquet_header_rows": _sql_parquet_header_rows(),
        "flatten_levels": _sql_flatten_levels(),
        "corr_ranked": _sql_corr_ranked(),
        "split_exact": _sql_split_exact(),
        "type_report_lines": _sql_type_report_lines(),
        "train_importance": _sql_importance_facts(EMB_NAMES_SQL),
        "train_boosted_importance": _sql_importance_facts(EMB_NAMES_SQL),
        "softmax_importance": _sql_importance_facts(EMB_NAMES_SQL),
        "softmax_predict": _sql_prediction_facts(),
        "explain_global_sums": _sql_explain_global_sums(),
        "predict": _sql_prediction_facts(),
        "end_to_end": _sql_end_to_end(),
        "explain_topk": _sql_explain_topk(),
        "explain_global": _sql_explain_global(),
        "csv_round_trip": CUSTOMER_TEXT_SQL,
        "parquet_round_trip": CUSTOMER_TEXT_SQL,
        "report_round_trip": f"SELECT * FROM ({_sql_fill_rate()}) CROSS JOIN (VALUES ('csv'), ('parquet')) f(fmt)",
        "metadata_round_trip": _sql_metadata_round_trip(),
        "bundle_round_trip": f"SELECT c_custkey, CASE WHEN {_sql_hash('c_custkey')} < 2000 THEN 'test' ELSE 'train' END AS split, c_acctbal, c_mktsegment AS target FROM ({CUSTOMER_TEXT_SQL})",
        "model_round_trip": f"SELECT vec_id, TRUE AS same FROM embeddings WHERE {_sql_hash('vec_id')} < 2000",
        "header_rows_round_trip": _sql_header_rows_round_trip(),
        "csv_multi_header": _sql_csv_multi_header(),
        "csv_wide_records": "SELECT CAST(o_orderkey AS BIGINT) AS key, o_orderpriority || chr(10) || ', \"x\"' AS text, "
                            "CASE WHEN o_orderkey % 11 = 0 THEN 'extra' || chr(10) || o_orderkey END AS third, "
                            "CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 THEN 'last' END AS fourth FROM orders",
        "mode_by_string_float": _sql_mode_by_string_float(),
        "csv_quoted_newlines": "SELECT CAST(c_custkey AS BIGINT) AS key, c_name || chr(10) || '\"second\" line' AS text FROM customer",
        "placeholder_names": _sql_placeholder_names(),
        "split_xy": f"SELECT o_orderkey, o_totalprice, o_orderpriority, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate' AS columns FROM {ORDERS_GAPS_SQL}",
        "existing_columns": "SELECT o_orderstatus, o_orderkey FROM orders",
        "impute_policy_knn": _sql_impute_knn(),
        "impute_integers": _sql_impute_integers(),
        "sign_labels": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'increased' ELSE 'decreased' END AS sign FROM customer",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | ({} if LLM is None else LLM.queries() | {"pipeline": corpus_pipeline.run})


def oracle_sql() -> dict[str, str]:
    pipeline = {} if LLM is None or corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return _own_oracle_sql() | ({} if LLM is None else LLM.oracle_sql() | pipeline)
