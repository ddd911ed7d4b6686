import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_price_k", "o_orderdate",
                          "o_none"]
    assert sum(r["o_totalprice"] is None for r in rows) == 0


def test_every_query_has_a_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    # the model queries return facts that SQL can state, so each has its formulation
    for name in ("train_importance", "train_boosted_importance", "predict", "explain_topk", "explain_global", "end_to_end"):
        assert name in qs and name in sql
