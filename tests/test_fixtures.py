"""Synthetic fixtures modelled on FIXTURES.md (F1 header grid, F3 mixed table)."""

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wideprep.operators import impute as I
from wideprep.plans import header as HD
from wideprep.sources import io as IO


def mixed(spark):
    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(40):
        rows.append((
            i,
            None if i in (0, 1, 7, 20, 21, 22, 39) else float(i % 6) + 0.5,          # num_a: runs at start, middle, end
            None if i % 9 == 4 else (10 if i % 3 == 0 else 2),                      # int_code: mode tie 10 vs 2 by text
            None if i % 5 == 2 else (i % 4 == 0),                                  # bool_c
            None if i in (0, 13) else base + dt.timedelta(days=i),                  # ts_d: leading gap
            None if i % 7 == 3 else ["x", "y", "y", "z"][i % 4],                    # str_e
            None,                                                                   # all_null
            3.0,                                                                    # const
        ))
    schema = ("row_id long, num_a double, int_code int, bool_c boolean, ts_d timestamp, str_e string, "
              "all_null double, const double")
    return spark.createDataFrame(rows, schema)


def test_apply_filling_mixed_types(spark):
    df = mixed(spark)
    filled, log, summary = I.apply_filling(df, order_by="row_id")
    lg = {r["column"]: r for r in log.collect()}
    assert lg["row_id"]["method"] == "unchanged" and not lg["row_id"]["fallback"]
    assert lg["bool_c"]["method"] == "mode"
    assert lg["str_e"]["method"] == "mode"
    assert lg["ts_d"]["method"] == "ffill" and lg["ts_d"]["fallback"]
    assert lg["ts_d"]["missing_after"] == 1                   # leading gap has nothing to carry
    assert lg["all_null"]["method"] == "unchanged" and lg["all_null"]["missing_after"] == 40
    assert lg["const"]["missing_before"] == 0
    out = filled.orderBy("row_id").toPandas()
    # int_code mode: 10 and 2 tie in count? otherwise the more frequent; ties go to the smaller text '10'
    counts = pd.Series([10 if i % 3 == 0 else 2 for i in range(40) if i % 9 != 4]).value_counts()
    want = 10 if counts[10] == counts[2] else counts.idxmax()
    assert (out.loc[[i for i in range(40) if i % 9 == 4], "int_code"] == want).all()
    assert out["ts_d"].isna().sum() == 1 and out.loc[13, "ts_d"] == out.loc[12, "ts_d"]
    s = {r["metric"]: r["value"] for r in summary.collect()}
    assert int(s["total_missing_after"]) == 41


def test_header_grid_to_unique_names(spark, tmp_out):
    path = os.path.join(tmp_out, "f1.csv")
    lines = ["Блок А,,,Блок Б,",
             "Возраст,Пол,,Рост,Рост",
             '"«Возраст,\u00a0лет»",,Вес — кг,,a_2',       # quoted comma, NBSP, guillemets, em dash
             "1,2,3,4,5", "6,7,8,9,10"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    header, body = IO.read_multi_header(spark, path, 3)
    names = HD.pick_names(header)
    assert {r["col_idx"]: (r["name"], r["used_row"]) for r in names.collect()} == {
        0: ('"Возраст, лет"', 2), 1: ("Пол", 1), 2: ("Вес - кг", 2), 3: ("Рост", 1), 4: ("a_2", 2)}
    dup = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a_2")], "col_idx int, name string")
    uniq = {r["col_idx"]: r["name"] for r in HD.dedupe_names(dup, "name", "col_idx").collect()}
    assert len(set(uniq.values())) == 3 and uniq[0] == "a"
    final = [r["name"] for r in names.orderBy("col_idx").collect()]
    named = IO.apply_names(body, final)
    assert named.columns[2:] == final and named.count() == 2


def test_identifier_drop_by_spaces_and_case(spark):
    df = spark.createDataFrame([(1, 2)], "`№ пациента` int, x int")
    assert HD.drop_identifier(df, ["№Пациента"]).columns == ["x"]


def test_policy_with_knn_group(spark):
    rng = np.random.default_rng(17)
    n = 200
    pdf = pd.DataFrame({"id": np.arange(n), "lab": rng.normal(10, 2, n), "m1": rng.normal(size=n),
                        "m2": rng.normal(size=n), "other": rng.normal(size=n), "sparse": rng.normal(size=n)})
    pdf.loc[pdf.index % 10 == 0, "lab"] = np.nan          # 10 % -> median rule
    pdf.loc[pdf.index % 8 == 1, "m1"] = np.nan            # kNN group, 87.5 % filled
    pdf.loc[pdf.index % 9 == 2, "m2"] = np.nan
    pdf.loc[pdf.index % 5 == 3, "other"] = np.nan         # 20 % -> default median
    pdf.loc[pdf.index % 2 == 0, "sparse"] = np.nan        # 50 % -> left alone
    sdf = spark.createDataFrame(pdf)
    out = I.impute_policy(sdf, [(["lab"], "median", 50.0), (["m1", "m2"], "knn", 70.0)], key="id").toPandas()
    out = out.sort_values("id").reset_index(drop=True)
    assert out[["lab", "m1", "m2", "other"]].notna().all().all()
    assert out["sparse"].isna().sum() == 100
    assert np.isclose(out.loc[0, "lab"], pdf["lab"].median())
    assert np.isclose(out.loc[3, "other"], pdf["other"].median())
    from test_knn_explain import brute_knn
    want = brute_knn(pdf, ["m1", "m2"])
    assert np.allclose(out[["m1", "m2"]].to_numpy(), want)
