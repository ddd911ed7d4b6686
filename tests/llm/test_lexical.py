"""Lexical search against a plain loop over all documents, bounds that hold, and the share of pairs that they exclude."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wideprep.llm import lexical as X
from wideprep.llm import queries as Q

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for key, t in sorted(set(items), key=str):
        asked.setdefault(key, []).extend(terms(t))
    out = []
    for key, words in asked.items():
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, (0, 0) if i is None else (1, i), i))
        out += [(key, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:top], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    names = [f"w{i}" for i in range(150)] + ["Straße", "ÉTÉ", "été", "İx", "9", "a_b", "x" * 300]
    weight = [1 / (i + 1) for i in range(len(names))]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(names, weight, k=n))
    docs = [(i, text(rnd.choice([1, 2, 5, 20, 60, 300]))) for i in range(500)]
    docs += [(7, text(10))] * 30 + [(None, text(10)), (None, None), (600, None), (601, ""), (602, " ,.; "), (603, text(40_000)), (604, "W1 w1 W1")]
    docs += [(700 + i, "copy of w3 W4 w5 w5 w149") for i in range(100)]
    items = [(i, text(rnd.choice([1, 3, 15]))) for i in range(25)] + [(30, None), (31, " ! "), (32, "nowhere"), (None, "w149 w148"), (33, "w3 w3 w5"), (33, "w149"), (33, "w149")]
    return docs, items


def tables(spark, docs, items):
    docs = [(i, t, "clash", 1) for i, t in docs]
    return spark.createDataFrame(docs, "doc_id long, text string, item string, t int").repartition(5), \
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")


def test_rank_equals_a_plain_loop(spark, corpus):
    got = X.rank(*tables(spark, *corpus), top=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(*corpus, 5)
    # Repeated rows of equal score may stand in any order, but they are equal in all columns.
    assert result(got) == want


def test_blocks_of_queries_shuffled_candidates_and_kept_index(spark, corpus, monkeypatch):
    docs, items = tables(spark, *corpus)
    index = X.build(docs).checkpoint()
    want = result(X.rank(docs, items, top=3, index=index))
    assert want == brute(*corpus, 3)
    monkeypatch.setattr(X, "QUERY_BYTES", 200)
    monkeypatch.setattr(X, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(X, "WIDTH", 16)
    assert result(X.rank(docs, items, top=3, index=index)) == want


def test_bounds_hold_for_every_pair(corpus):
    docs, items = corpus
    q = X.Queries([t for _, t in items if terms(t)])
    column = pa.array([t for _, t in docs], pa.string())
    n, row, term, tf = q.counts(column)
    df = np.bincount(term, minlength=q.n_terms).astype(float)
    s = X.Scoring(int((n > 0).sum()), int(n.sum()), df)
    gains = np.zeros((len(docs), q.n_terms), np.int64)
    gains[row, term] = s.weight[term] * X.Scoring.gain(tf, s.damp(n)[row])
    exact = np.add.reduceat(gains[:, q.terms], q.edges[:-1], axis=1).T
    seen, loose, excluded = 0, 0, 0
    for rows, counts, most, widths, cut in X.signatures(column):
        block = {"terms": counts, "most": most, "width": widths, "slices": cut}
        for lo, bound in X.bounds(block, q, s):
            true = exact[:, rows[lo:lo + bound.shape[1]]]
            assert (bound >= true).all()
            seen, loose, excluded = seen + true.shape[1], loose + (bound[true == 0] > 0).sum(), excluded + (true == 0).sum()
    assert seen == (n > 0).sum() and loose < 0.05 * excluded


def test_bounds_exclude_most_pairs(spark):
    docs = spark.read.parquet(f"{SF[:-3]}01/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    items = [r.text for r in spark.read.parquet(f"{SF[:-3]}01/benchmark.parquet").collect()]
    q, index = X.Queries(items), X.build(docs, "id", "t").checkpoint()
    s = X.frequencies(docs, q, "t")
    n_docs = docs.count()
    bar = np.full(len(items), np.iinfo(np.int64).max)
    assert X.candidates(index, q, s, bar).count() == 0
    scored = X.exact(docs, X.grouped(X.firsts(index, q, s, X.FIRSTS * 20)), q, s, np.ones(len(items), np.int64), True).collect()
    for i in range(len(items)):
        own = sorted((r.score for r in scored if r.item == i), reverse=True)
        bar[i] = own[19] if len(own) >= 20 else 1
    assert X.candidates(index, q, s, bar).count() < 0.35 * n_docs * len(items)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "X y"), ("c", "z")], "`my.id` string, body string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    found = X.rank(docs, items, "my.id", "body").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]
    assert X.rank(docs.limit(0), items, "my.id", "body").count() == 0
    none = X.rank(docs, items.limit(0), "my.id", "body")
    assert none.count() == 0 and [t for _, t in none.dtypes] == ["string", "int", "string", "bigint"]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(Q.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in Q.op11_lexical_search(spark, SF).collect()) == want and len(want) > 100
