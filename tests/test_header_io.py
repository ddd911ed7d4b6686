import os

import pytest
from pyspark.sql import functions as F

from wideprep.plans import header as HD
from wideprep.sources import io as IO
from wideprep.sources import reports as RP


def test_read_multi_header_and_names(spark, tmp_out):
    path = os.path.join(tmp_out, "grid.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("Group,,Lab\n")
        f.write("Age, years,Unnamed: 2,Glucose\n")
        f.write(",«Sex»,Glucose\n")
        f.write("1,2,3,4\n5,6,7,8\n")
    header, body = IO.read_multi_header(spark, path, 3)
    names = HD.pick_names(header, placeholder_regex=HD.PLACEHOLDER_PATTERN).orderBy("col_idx").collect()
    assert [(r["name"], r["used_row"]) for r in names] == [("Age", 1), ('"Sex"', 2), ("Glucose", 2), ("Glucose", 1)]
    assert body.count() == 2
    assert [r["_c0"] for r in body.orderBy("_offset").collect()] == ["1", "5"]


def test_too_few_rows_is_an_error(spark, tmp_out):
    path = os.path.join(tmp_out, "short.csv")
    with open(path, "w") as f:
        f.write("a\nb\nc\n")
    with pytest.raises(ValueError):
        IO.read_multi_header(spark, path, 3)


def test_dedupe_resolves_collisions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "b")], "i int, name string")
    got = {r["i"]: r["name"] for r in HD.dedupe_names(df, "name", "i", n_buckets=2).collect()}
    assert len(set(got.values())) == 5
    assert got[1] == "a" and got[2] == "a_2" and got[4] == "a_3"
    dup = {r["i"]: r["name"] for r in HD.dedupe_names(df, "name", "i", style="_dup").collect()}
    assert dup[2] == "a_dup1"


def test_find_target_and_error(spark):
    names = spark.createDataFrame([(0, "Id"), (1, "Группа наблюдения"), (2, "Группа крови")],
                                  "col_idx int, name string")
    header = spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (2, 0, "Target z")], "col_idx int, row_idx int, cell string")
    r = HD.find_target(names, header, "группа").first()
    assert (r["col_idx"], r["mode"]) == (2, "derived")      # sorted by key: "крови" < "наблюдения"
    assert r["matched"] == [2, 1]
    assert HD.find_target(names, header, "группа", tie="first").first()["col_idx"] == 1
    r = HD.find_target(names, header, "target").first()
    assert (r["col_idx"], r["mode"]) == (2, "scanned_row_0")
    with pytest.raises(ValueError):
        HD.find_target(names, header, "nothing")


def test_drop_identifier(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Patient ID` int, patient_id int, x int")
    assert HD.drop_identifier(df, ["patient id"]).columns == ["patient_id", "x"]


def test_report_roundtrip(spark):
    rate = spark.createDataFrame([(0, 5, 8, 62.5), (1, 8, 8, 100.0)], "position int, filled long, total long, percentage double")
    lines = RP.format_fill_lines(rate)
    junk = spark.createDataFrame([("garbage",)], "line string")
    parsed = RP.parse_fill_lines(lines.select("line").unionByName(junk)).orderBy("column_no").collect()
    assert [(r.column_no, r.filled, r.total, r.percentage) for r in parsed] == [(1, 5, 8, 62.5), (2, 8, 8, 100.0)]


def test_writers_and_bundle(spark, tmp_out):
    df = spark.createDataFrame([(1, 2.5, "x")], "id int, `a b,(c)` double, s string")
    assert IO.write_parquet(df, os.path.join(tmp_out, "p"))
    assert spark.read.parquet(os.path.join(tmp_out, "p")).columns == ["id", "a b,(c)", "s"]
    IO.write_csv(df, os.path.join(tmp_out, "c"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_out, "c")).count() == 1
    IO.save_bundle(spark, os.path.join(tmp_out, "b"), df.withColumn("split", F.lit("train")),
                   {"target": "s", "numerical": ["a b,(c)"]}, partition_by=["split"])
    data, meta = IO.load_bundle(spark, os.path.join(tmp_out, "b"))
    assert meta["target"] == "s" and data.count() == 1


def test_multi_file_header(spark, tmp_out):
    d = os.path.join(tmp_out, "parts")
    os.makedirs(d)
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("A,B\nx,y\nAge,Sex\n1,m\n2,f\n")
    with open(os.path.join(d, "part-1.csv"), "w") as f:
        f.write("3,m\n4,f\n")
    with open(os.path.join(d, "_SUCCESS"), "w") as f:
        f.write("")
    header, body = IO.read_multi_header(spark, d, 3)
    assert [r["name"] for r in HD.pick_names(header).orderBy("col_idx").collect()] == ["Age", "Sex"]
    assert sorted(r["_c0"] for r in body.collect()) == ["1", "2", "3", "4"]
    d2 = os.path.join(tmp_out, "parts2")
    os.makedirs(d2)
    for i in range(2):
        with open(os.path.join(d2, f"p{i}.csv"), "w") as f:
            f.write(f"A,B\nx,y\nAge,Sex\n{i}1,m\n{i}2,f\n")
    _, body2 = IO.read_multi_header(spark, d2, 3, header_in_every_file=True)
    assert sorted(r["_c0"] for r in body2.collect()) == ["01", "02", "11", "12"]


def test_parquet_header_rows_only_in_the_first_file(spark, tmp_out):
    path = os.path.join(tmp_out, "pq")
    spark.range(40).select(F.col("id").cast("string").alias("a")).repartitionByRange(4, F.col("a").cast("int")) \
        .sortWithinPartitions(F.col("a").cast("int")).write.parquet(path)
    _, body = IO.read_parquet_multi_header(spark, path, 3)
    assert sorted(int(r["a"]) for r in body.collect()) == list(range(3, 40))
    _, each = IO.read_parquet_multi_header(spark, path, 3, header_in_every_file=True)
    assert each.count() == 40 - 4 * 3


def test_quoted_newlines_are_read_or_refused(spark, tmp_out):
    path = os.path.join(tmp_out, "q.csv")
    with open(path, "w") as f:
        f.write('a,b\nx,y\n1,"two\nlines"\n2,"say ""hi"""\n')
    _, body = IO.read_multi_header(spark, path, 2, multi_line=True)
    assert [(r["_c0"], r["_c1"]) for r in body.orderBy("_offset").collect()] == [("1", "two\nlines"), ("2", 'say "hi"')]
    with pytest.raises(Exception, match="unpaired quote"):
        IO.read_multi_header(spark, path, 2)[1].collect()


def test_offsets_keep_the_order_over_splits(spark, tmp_out):
    path = os.path.join(tmp_out, "long.csv")
    with open(path, "w") as f:
        f.write("h\n" + "".join(f"{i}\n" for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        _, body = IO.read_multi_header(spark, path, 1)
        assert body.rdd.getNumPartitions() > 1
        assert [int(r["_c0"]) for r in body.orderBy("_offset").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_float_text_is_the_shortest_plain_text(spark):
    from wideprep.functions.numeric import decimal_places, float_text
    from pyspark.sql import types as T
    values = [12000000.0, 1.5, 0.0001, 1e-05, 1.5e-18, 1e16, 9999999999999998.0, 123456789.25, -0.002, 1e300, -2.5e-7, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", float_text(F.col("v")).alias("t"), decimal_places(F.col("v"), T.DoubleType()).alias("p")).collect()
    assert [r.t for r in got] == [repr(r.v) for r in got]
    assert {r.v: r.p for r in got}[1.5e-18] == 19 and {r.v: r.p for r in got}[12000000.0] == 1


def test_checkpoint_folder_must_be_shared(spark):
    from wideprep import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster())


def quoted_csv(rng, n, width=4):
    """Rows with separators, doubled quotes and newlines inside quoted cells, some wider than the header."""
    def cell():
        kind = rng.integers(0, 6)
        if kind == 0:
            return "x" * int(rng.integers(0, 5))
        if kind == 1:
            return 'say "hi", ' + "y" * int(rng.integers(0, 9))
        if kind == 2:
            return "line\n" * int(rng.integers(1, 40)) + "end"
        if kind == 3:
            return "\n\n"
        return str(rng.integers(0, 10**6))
    return [[str(i)] + [cell() for _ in range(int(rng.integers(width - 2, width + 3)))] for i in range(n)]


def test_quoted_newlines_are_read_by_many_tasks(spark, tmp_out):
    """Records that cross one split or several come out whole, in order, and in as many columns as the widest has."""
    import csv

    import numpy as np
    rows = {f"p{k}.csv": quoted_csv(np.random.default_rng(k), 700) for k in range(2)}
    rows["p0.csv"][350][1] = "a\nb" * 3000                # longer than two splits
    for name, body in rows.items():
        with open(os.path.join(tmp_out, name), "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerows([["a", "b", 'c\n"c"', ""], ["x", "y"]] if name == "p0.csv" else [])
            w.writerows(body)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        header, body = IO.read_multi_header(spark, tmp_out, 2, multi_line=True)
        got = body.orderBy("_file", "_offset").collect()
        assert IO._scan_lines(spark, tmp_out).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    wide = max(len(r) for v in rows.values() for r in v)
    want = [[c if c else None for c in r] + [None] * (wide - len(r)) for name in sorted(rows) for r in rows[name]]
    assert [[r[f"_c{i}"] for i in range(wide)] for r in got] == want
    assert len({(r["_file"], r["_offset"]) for r in got}) == 1400
    assert header.count() == 2 * wide and header.where("row_idx = 0 AND col_idx = 2").first()["cell"] == 'c "c"'


def test_no_cell_is_lost(spark, tmp_out):
    path = os.path.join(tmp_out, "w.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,2\n3,4,5\n"x,1","y ""q"", z",,"",7\n')
    header, body = IO.read_multi_header(spark, path, 1)
    assert [tuple(r)[2:] for r in body.orderBy("_offset").collect()] == [
        ("1", "2", None, None, None), ("3", "4", "5", None, None), ("x,1", 'y "q", z', None, None, "7")]
    assert [r["name"] for r in HD.pick_names(header).orderBy("col_idx").collect()][:2] == ["a", "b"] and header.count() == 5
    with pytest.raises(Exception, match="more cells than 3"):
        IO.read_multi_header(spark, path, 1, width=3)[1].collect()
    assert len(IO.read_multi_header(spark, path, 1, width=9)[1].columns) == 11


def test_an_odd_number_of_quotes_raises(spark, tmp_out):
    path = os.path.join(tmp_out, "odd.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"2\n3,4\n')
    with pytest.raises(Exception, match="unpaired quote in"):
        IO.read_multi_header(spark, path, 1, multi_line=True)[1].collect()
