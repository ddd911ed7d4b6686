"""Whitening against numpy on the whole table: odd vectors, copies, blocks that tables do not fill."""

import numpy as np
import pytest

from wideprep.llm import queries as Q
from wideprep.llm import whitening as X

SF = "/root/testdata/sf0.001"


def brute(vectors, components=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-values) if values[i] > 1e-10 * values.max()][:components]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ (basis[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def compare(rows, vectors, components=16):
    """``rows`` in the order of ``vectors``, each with all its components."""
    n, deviation, white, explained = brute(vectors, components)
    k = white.shape[1]
    got = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert len(got) == len(vectors) * k and {r.n for r in got} == {n}
    assert [r.component for r in got] == list(range(1, k + 1)) * len(vectors)
    assert [r.deviation for r in got[::k]] == deviation.tolist()
    z = np.array([r.whitened for r in got]).reshape(-1, k)
    assert np.abs(z - white * np.sign((z * white).sum(axis=0))).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.3])
    return np.concatenate([base, np.repeat(base[:1], 40, axis=0), base[:5] + 1e-6]).astype(np.float32).astype(float).tolist()


def test_whitened_rows_equal_numpy(spark, vectors, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 7)
    odd = [None, [], [None, 1.0, 1.0, 1.0, 1.0], [float("nan")] + [1.0] * 4, [float("inf")] + [1.0] * 4, [1.0, 2.0]]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(1000 + i, v, "clash") for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(5)
    compare(X.whiten(table).collect(), vectors)


def test_several_column_blocks_and_fewer_components(spark, vectors, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 16)
    monkeypatch.setattr(X, "BLOCK_COLUMNS", 2)
    monkeypatch.setattr(X, "CHUNK", 3)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    compare(X.whiten(table, components=3).collect(), vectors, 3)


def test_tables_without_variance_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert X.whiten(spark.createDataFrame([], schema)).count() == 0
    assert X.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    line = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 2.0]), (3, [4.0, 2.0])]        # one dimension varies
    got = X.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {r.n for r in got} == {3} and got[0].explained == pytest.approx(1)
    assert sum(r.vec_id is None for r in got) == 2


def test_query_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    compare(Q.op12_whitening(spark, SF).collect(), [list(r.embedding) for r in table])
