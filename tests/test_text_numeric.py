from pyspark.sql import functions as F

from wideprep.functions import numeric as N
from wideprep.functions import text as TX

TRICKY = ["  a b  ", "«quoted» ‘x’", "a​b﻿", "x — y – z", "tab\tand\nnewline", None,
          "　wide space ", "it's", "Straße", "a\x1cb"]


def test_normalize_matches_python_twin(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TRICKY)], "i int, s string")
    got = {r["i"]: (r["n"], r["n2"], r["k"], r["ik"]) for r in df.select(
        "i", TX.normalize_text("s").alias("n"), TX.normalize_name("s").alias("n2"),
        TX.match_key("s").alias("k"), TX.id_match_key("s").alias("ik")).collect()}
    for i, s in enumerate(TRICKY):
        assert got[i] == (TX.py_normalize_text(s), TX.py_normalize_text(s, False), TX.py_match_key(s),
                          TX.py_id_match_key(s)), s


def test_to_number_formats(spark):
    vals = ["1.5", " 2 ", "1e3", ".5", "5.", "-3", "+4", "1,5", "2f", "1.0d", "1_0", "abc", "", "inf", "-Infinity",
            "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(N.to_number("v")).collect()]
    want = [1.5, 2.0, 1000.0, 0.5, 5.0, -3.0, 4.0, None, None, None, None, None, None, float("inf"),
            float("-inf"), None]
    assert got == want


def test_decimal_comma(spark):
    df = spark.createDataFrame([("1,5",), ("abc",), ("2",)], "v string")
    assert [r[0] for r in df.select(TX.decimal_comma_to_double("v")).collect()] == [1.5, None, 2.0]


def test_decimal_places(spark):
    from pyspark.sql import types as T
    vals = [3.0, 0.25, 12.125, 1234.5, 0.1, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(N.decimal_places(F.col("v"), T.DoubleType())).collect()]
    assert got == [1, 2, 3, 1, 1, None]


def test_integer_like(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (1e-10 + 3,), (float("inf"),)], "v double")
    assert [r[0] for r in df.select(N.is_integer_like("v")).collect()] == [True, False, True, False]


def test_regex_cues_unicode_boundaries(spark):
    df = spark.createDataFrame([("группа риска",), ("подгруппа",), ("масса, кг",)], "t string")
    got = [r[0] for r in df.select(TX.regex_any("t", [r"\bгруппа\b", r"\bкг\b"])).collect()]
    assert got == [True, False, True]
