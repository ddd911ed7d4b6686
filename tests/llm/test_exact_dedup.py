"""Exact deduplication against a plain loop, with odd rows, hot groups and digests that collide."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wideprep.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, digest string, norm int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    best, size = {}, Counter(norm)
    for (i, t), k in zip(rows, norm):
        rank = (-len(t or ""), (0, 0) if i is None else (1, i))
        best[k] = min(best.get(k, (rank, i)), (rank, i), key=lambda x: x[0])
    out, kept = [], set()
    for (i, t), k in zip(rows, norm):
        stays = best[k][0] == (-len(t or ""), (0, 0) if i is None else (1, i)) and k not in kept
        kept |= {k} if stays else set()
        out.append((i, best[k][1], size[k], stays, hashlib.sha256(k.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [(i, rnd.choice(["a b", "ab", " a\tb ", "a\x0bb\n", "a b", "A b", "ä b", "b a", "", "  ", None, "x" * rnd.randint(1, 3)])) for i in range(400)]
    out += [(7, "a b")] * 50 + [(None, "a b"), (None, None), (None, None), (500, "long " * 30_000), (501, " ".join(["long"] * 30_000))]
    out += [(1000 + i, "hot text") for i in range(500)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(7)


def result(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_groups_equal_a_plain_loop(spark, rows):
    got = X.groups(table(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(got) == brute(rows)


def test_repeats_longer_than_a_piece(spark, monkeypatch, rows):
    monkeypatch.setattr(X, "PIECE", 8)
    assert result(X.groups(table(spark, rows))) == brute(rows)


def test_equal_digests_do_not_merge_unequal_texts(spark, rows):
    weak = lambda norm: (F.length(norm) % 2).cast("string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.groups(table(spark, rows), digest=weak, salts=3).collect())
    assert got == Counter({k: n for k, n in Counter(x[:4] for x in brute(rows).elements()).items()})
    kept = X.keep_one(table(spark, rows), digest=weak)
    assert kept.count() == sum(n for x, n in brute(rows).items() if x[3])


def test_keep_one_returns_whole_rows(spark, rows):
    got = X.keep_one(table(spark, rows))
    assert got.columns == ["doc_id", "text", "digest", "norm"]
    assert Counter(r.doc_id for r in got.collect()) == Counter(x[0] for x in brute(rows).elements() if x[3])
    assert {(r.digest, r.norm) for r in got.collect()} == {("clash", 1)}


def test_text_ids_empty_tables_and_names_with_dots(spark):
    named = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "z")], "`a.id` string, `the text` string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in X.groups(named, "a.id", "the text").collect()}
    assert got == {("b", "a", False), ("a", "a", True), (None, None, True)}
    none = table(spark, [(1, "a")]).limit(0)
    assert X.groups(none).count() == 0 and X.keep_one(none).count() == 0
