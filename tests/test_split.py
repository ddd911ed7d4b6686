"""The exact split against a sort of the hashes."""

import hashlib
import math

from pyspark.sql import functions as F

from wideprep.operators import features as FE


def _hash(k):
    return int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:15], 16)


def test_exact_split_takes_the_smallest_hashes_of_each_stratum(spark):
    sizes = {"a": 1, "b": 333, None: 20, "": 7}
    rows = [(f"{g}-{i}", g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, g string").repartition(3)
    for share in (0.0, 0.2, 0.35, 1.0):
        got = {r["k"] for r in FE.split_hash(df, "k", share, exact=True, stratify="g").where("split = 'test'").collect()}
        want = {k for g in sizes for k, _ in sorted(((k, _hash(k)) for k, h in rows if h == g), key=lambda x: x[1])[:math.ceil(round(share * sizes[g], 9))]}
        assert got == want
    whole = FE.split_hash(df, "k", 0.2, exact=True)
    assert whole.columns == ["k", "g", "split"]
    best = sorted((k for k, _ in rows), key=_hash)[:math.ceil(0.2 * len(rows))]
    assert {r["k"] for r in whole.where("split = 'test'").collect()} == set(best)


def test_exact_split_of_odd_tables(spark):
    none = spark.createDataFrame([], "k long, g string")
    assert FE.split_hash(none, "k", exact=True).count() == 0 == FE.split_hash(none, "k", exact=True, stratify="g").count()
    nulls = spark.createDataFrame([(None, "x"), (1, None)], "k long, g string")
    assert FE.split_hash(nulls, "k", 0.5, exact=True).where(F.col("split") == "test").count() == 1


def test_exact_split_does_not_shuffle_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = FE.split_hash(df, "k", exact=True)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
