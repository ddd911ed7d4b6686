"""Every public operator once on tiny data (catches broken code paths early)."""

import os

import pytest
from pyspark.sql import functions as F

from wideprep.operators import classify as CL
from wideprep.operators import columns as CO
from wideprep.operators import correlate as C
from wideprep.operators import impute as I
from wideprep.operators import ordered as O
from wideprep.operators import profile as P
from wideprep.operators import quantile as Q
from wideprep.plans import header as HD
from wideprep.sources import io as IO
from wideprep.sources import reports as RP


@pytest.fixture()
def small(spark):
    rows = [(1, 2.5, "a", True), (2, None, "b", False), (3, 4.0, None, True), (4, 4.0, "a", None), (5, 1.0, "c", True)]
    return spark.createDataFrame(rows, "id long, x double, s string, b boolean")


def test_profiles(small):
    assert P.type_profile(small).count() >= 1
    d = {r["column"]: r for r in P.describe_object(small, ["s"]).collect()}
    assert (d["s"]["count"], d["s"]["unique"], d["s"]["top"], d["s"]["freq"]) == (4, 3, "a", 2)
    assert {r["column"]: r["mode"] for r in P.mode(small, ["x"], tie="value").collect()}["x"] == "4.0"
    fv = P.first_values(small, "id", ["s"], n=3).orderBy("rank").collect()
    assert [r["value"] for r in fv] == ["a", "b", ""]
    assert P.numeric_distinct(small, ["x"]).first()["n_unique_numeric"] == 3
    assert P.counter(small, "s").count() == 4
    mm = {r["column"]: r for r in Q.mean_median(small, ["x"]).collect()}
    assert abs(mm["x"]["median"] - 3.25) < 1e-12


def test_group_counts_missing_policies(spark, small):
    labels = spark.createDataFrame([("a", "A")], "code string, label string")
    keep = {r["s"]: r["label"] for r in P.group_counts(small, "s", labels, on_missing="keep").collect()}
    assert keep["a"] == "A" and keep["b"] == "b"
    with pytest.raises(KeyError):
        P.group_counts(small, "s", labels, on_missing="error")


def test_imputers(small):
    m = {r["id"]: r for r in I.impute_mode(small, ["s", "b"]).collect()}
    assert m[3]["s"] == "a" and m[4]["b"] is True
    c = {r["id"]: r["x"] for r in I.impute_constant(small, {"x": 0.0}).collect()}
    assert c[2] == 0.0
    assert I.drop_rows(small, ["x", "s"]).count() == 3
    md = {r["id"]: r["x"] for r in I.impute_median(small, ["x"]).collect()}
    assert md[2] == 3.25


def test_columns_and_reports(spark, small, tmp_out):
    x, y = CO.split_xy(small, "b", keep=("id",))
    assert "b" not in x.columns and y.columns == ["id", "b"]
    assert CO.existing(small, ["s", "zz", "id"]) == ["s", "id"]
    assert CO.keep_filled(small, 79.0).columns == ["id", "x", "s", "b"]
    assert CO.keep_filled(small, 80.0).columns == ["id"]
    info = spark.createDataFrame([(0, "x", "numeric", "1, 2")], "position int, column string, kind string, samples string")
    back = RP.parse_type_lines(RP.format_type_lines(info)).first()
    assert (back["name"], back["type"], back["samples"]) == ("x", "numeric", "1, 2")
    path = os.path.join(tmp_out, "lines.txt")
    with open(path, "w") as f:
        f.write("Column 1: Filled=3, Total=4, Percentage=75.00%\nnoise\n")
    assert RP.parse_fill_lines(RP.read_lines(spark, path)).count() == 1
    IO.write_report(small, os.path.join(tmp_out, "rep"), "csv")
    assert IO.read_table(spark, os.path.join(tmp_out, "rep"), "csv").count() == 5


def test_classify_patterns_and_hints(spark):
    df = spark.createDataFrame([(1, 2.0, 70.5, "x")], "`Группа крови` int, `Масса, кг` double, `Рост` double, t string")
    out = {r["column"]: (r["kind"], r["source"]) for r in CL.classify_features(df).collect()}
    assert out["Группа крови"] == ("categorical", "name") and out["Масса, кг"] == ("numerical", "name")
    rep = spark.createDataFrame([("Рост", "рост, кг"), ("X", "тип 1")], "name string, description string")
    hints = {r["key"]: r["kind"] for r in CL.hints_from_report(rep).collect()}
    assert hints == {"рост": "numerical", "x": "categorical"}
    out2 = {r["column"]: (r["kind"], r["source"]) for r in
            CL.classify_features(df, hints=CL.hints_from_report(rep).withColumnRenamed("key", "key")).collect()}
    assert out2["Рост"] == ("numerical", "hints")


def test_correlation_matrix_and_ranked(small):
    m = C.correlation_matrix(small, ["id", "x"]).collect()
    assert len(m) == 2
    r = C.ranked_pairs(small, ["id", "x"]).first()
    assert r["rank"] == 1


def test_ordered_small_paths(small):
    assert [r["id"] for r in O.slice_rows(small, "id", 1, 3).orderBy("id").collect()] == [2, 3]
    pos = {r["id"]: r["position"] for r in O.with_positions(small, "id", n_buckets=2).collect()}
    assert pos == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    near = {r["id"]: r["x"] for r in O.interpolate(small, ["x"], "id", method="nearest").collect()}
    assert near[2] == 2.5


def test_header_helpers(spark):
    df = spark.createDataFrame([(0, "h0", "a"), (1, "h1", "b"), (2, "h2", "c"), (3, "1", "2")], "k int, p string, q string")
    header, body = HD.header_table(df, "k", 3)
    assert body.count() == 1 and header.count() == 6
    names = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert HD.duplicate_report(names).first()["n"] == 2
    with pytest.raises(ValueError):
        HD.header_table(df.where("k < 3"), "k", 3)


def test_exact_split_and_unknown_categories(spark):
    from wideprep.operators import features as FE
    df = spark.range(0, 997).withColumnRenamed("id", "k")
    out = FE.split_hash(df, "k", 0.2, 42, exact=True)
    assert out.where("split = 'test'").count() == 200          # ceil(0.2 * 997)
    approx = FE.split_hash(df, "k", 0.2, 42)
    assert 150 < approx.where("split = 'test'").count() < 250
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    test = spark.createDataFrame([(4, "a"), (5, "zz")], "id int, c string")
    dic = FE.fit_categories(train, ["c"])
    assert sorted(r["category"] for r in dic.collect()) == ["a", "b", "nan"]
    enc = {r["id"]: r["feature"] for r in FE.onehot_long(test, "id", ["c"], dic).collect()}
    assert enc == {4: "cat__c_a"}                                # unseen 'zz' -> all zeros


def test_tune_for_input(spark, tmp_out):
    from wideprep.session import input_bytes, tune_for_input
    path = os.path.join(tmp_out, "f.txt")
    with open(path, "w") as f:
        f.write("x" * 1000)
    assert input_bytes(spark, path) == 1000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = tune_for_input(spark, 100 * 1024 ** 4)           # 100 TB
    assert s["spark.sql.shuffle.partitions"] == "409600"  # one per 256 MB, no cap
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 * 1024 * 1024)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
