import datetime as dt
import os

import numpy as np
import pandas as pd

from wideprep.operators import model as MD
from wideprep.operators import ordered as O
from wideprep.plans import header as HD
from wideprep.sources import io as IO


def test_interpolate_datetime_linear_and_time(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0, base), (1, None), (2, None), (3, base + dt.timedelta(hours=3)), (10, None), (12, base + dt.timedelta(hours=12))]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz")
    got = {r["k"]: r["t"] for r in O.interpolate(df, ["t"], "k", n_buckets=2).collect()}
    assert got[1] == base + dt.timedelta(hours=1) and got[2] == base + dt.timedelta(hours=2)
    assert got[10] == base + dt.timedelta(hours=7, minutes=30)          # linear: halfway by position
    got = {r["k"]: r["t"] for r in O.interpolate(df, ["t"], "k", method="index", n_buckets=2).collect()}
    assert got[10] == base + dt.timedelta(hours=10)                     # by the key's value


def test_model_save_and_load(spark, tmp_out):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(120, 3)), columns=["a", "b", "c"]).assign(label=lambda d: (d.a > 0) * 1)
    sdf = spark.createDataFrame(pdf)
    model = MD.train_forest(sdf, ["a", "b", "c"], "label", num_trees=3)
    path = os.path.join(tmp_out, "model")
    IO.save_model(model, path)
    again = IO.load_model(path)
    p1 = MD.predict(model, sdf).toPandas()
    p2 = MD.predict(again, sdf).toPandas()
    assert (p1.prediction == p2.prediction).all()


def test_metadata_and_header_preserving_write(spark, tmp_out):
    header = spark.createDataFrame([(0, 0, "Group"), (1, 0, ""), (0, 1, "Age"), (1, 1, "Sex")],
                                   "col_idx int, row_idx int, cell string")
    names = [r["name"] for r in HD.pick_names(header, priority=(1, 0)).orderBy("col_idx").collect()]
    IO.write_metadata(spark, names, header, os.path.join(tmp_out, "meta"))
    assert IO.read_json_value(spark, os.path.join(tmp_out, "meta", "columns_normalized")) == ["Age", "Sex"]
    data = spark.createDataFrame([(30, "f")], "Age int, Sex string")
    IO.write_with_header_rows(spark, header, data, os.path.join(tmp_out, "out"))
    rows = spark.read.option("header", True).csv(os.path.join(tmp_out, "out", "header_rows")).collect()
    assert len(rows) == 2
    assert spark.read.parquet(os.path.join(tmp_out, "out", "data")).count() == 1


def test_interpolate_timestamp_and_date_types(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0, base, dt.date(2024, 1, 1)), (1, None, None),
                                (2, base + dt.timedelta(hours=2), dt.date(2024, 1, 3))],
                               "k long, t timestamp, d date")
    r = {x["k"]: x for x in O.interpolate(df, ["t", "d"], "k").collect()}
    assert r[1]["t"] == base + dt.timedelta(hours=1) and r[1]["d"] == dt.date(2024, 1, 2)
