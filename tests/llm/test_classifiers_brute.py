"""Pooled features and scores of the three classifiers against plain loops on odd texts; held-out figures of their queries."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wideprep.llm import langid, learn, quality, toxicity
from wideprep.llm import queries as Q

SF = "/root/testdata/sf0.01"
rnd = random.Random(8)
WORDS = ["Ärger", "the", "THE", "x", "été", "a1", "longerword", "longerwords", "日本語", "o'neil", "9"]
TEXTS = [None, "", " .,; ", "one", "x x", "\x00a\x7fb"] + [rnd.choice([" ", ", ", "\n"]).join(rnd.choices(WORDS, k=n)) for n in (3, 31, 32, 33, 34, 64, 65, 400, 3000)] + [""]
COLUMN = pa.array(TEXTS, pa.string())


def words(text):
    return re.findall(r"[0-9A-Za-z\x80-\xff]+", (text or "").encode().decode("latin-1"))


def plain_toxicity(model, text):
    """Filter by filter and block by block, a word at a time."""
    n_f = len(toxicity.WIDTHS) * toxicity.FILTERS
    vectors = []
    for w in words(text):
        ids, _ = toxicity.features(pa.array([w.encode("latin-1").decode()], pa.string()))
        vectors.append(model.table[ids[0]].sum(axis=0).astype(float))
    vectors += [model.table[np.zeros(1 + len(toxicity.PREFIXES), int)].sum(axis=0).astype(float)] * (max(toxicity.WIDTHS) - 1)
    responses = []
    for i in range(len(words(text))):
        row = []
        for k, width, col in toxicity.places():
            for f in range(toxicity.FILTERS):
                row.append(sum(vectors[i + j] @ model.conv[:, col + j * toxicity.FILTERS + f] for j in range(width)) + model.bias[k * toxicity.FILTERS + f])
        responses.append(row)
    if not responses:
        return np.zeros(2 * n_f), toxicity.NOTHING
    best = [np.maximum(np.max(responses[i:i + toxicity.BLOCK], axis=0), 0) for i in range(0, len(responses), toxicity.BLOCK)]
    pooled = np.r_[np.max(best, axis=0), np.mean(best, axis=0)]
    return pooled, pooled @ model.out + model.base[0]


def test_toxicity_pool_and_score_equal_a_plain_loop(monkeypatch):
    model = toxicity.Model(3)
    model.bias[:] = 0.1
    model.cuts[:] = 0.25
    model.scale = 1.7
    for chunk in (toxicity.CHUNK, 40):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        ids, before = toxicity.features(COLUMN)
        assert np.diff(before).tolist() == [len(words(t)) for t in TEXTS]
        pooled, scores = model.pool(ids, before), model.score(ids, before)
        for i, t in enumerate(TEXTS):
            if len(words(t)) > 500:
                continue
            want, logit = plain_toxicity(model, t)
            assert np.allclose(pooled[i], want, atol=1e-4)
            assert scores[i] == pytest.approx(1 / (1 + np.exp(-np.clip((logit - 0.25) / 1.7, -60, 60))), abs=1e-4)


def test_quality_pool_equals_a_plain_loop():
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    ids, before = quality.tokens(COLUMN)
    for chunk in (1 << 16, 50):
        got = quality.pool(ids, before, vectors, chunk)
        for d in range(len(TEXTS)):
            own = ids[before[d]:before[d + 1]]
            n = max(1, len(own))
            v = vectors[own].astype(float)
            mean = v.sum(axis=0) / n
            spread = np.sqrt(np.maximum((v ** 2).sum(axis=0) / n - mean ** 2, 0))
            pairs = []
            for gap in range(1, quality.REACH + 1):
                pairs += [sum(v[i] @ v[i + gap] for i in range(len(own) - gap)) / n, sum(own[i] == own[i + gap] for i in range(len(own) - gap)) / n]
            assert np.allclose(got[d], np.r_[mean, spread, pairs, np.log1p(len(own))], atol=2e-3)


def test_language_scores_equal_a_plain_loop():
    model = langid.Model(["a", "b", "c"], 5)
    model.table = np.random.default_rng(6).normal(size=model.table.shape).astype(np.float32)
    model.bias[:], model.temperature = (0.1, -0.2, 0.3), 1.3
    codes, before = langid.subwords(COLUMN)
    got = model.probabilities(codes, before)
    for d, t in enumerate(TEXTS):
        alone, own = langid.subwords(pa.array([t], pa.string()))          # whatever stands before or after it
        assert sorted(codes[before[d]:before[d + 1]].tolist()) == sorted(alone.tolist()) and own[-1] == len(alone)
        z = model.bias.astype(float) + (sum(model.table[c].astype(float) for c in alone) / len(alone) if len(alone) else 0)
        e = np.exp((z - z.max()) / 1.3)
        assert np.allclose(got[d], e / e.sum(), atol=1e-5)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, label, least", [("op2_toxicity", "toxic", 0.65), ("op3_quality", "quality", 0.95)])
def test_held_out_auc(spark, query, label, least):
    found = {r.doc_id: r for r in getattr(Q, query)(spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in found and found[r.doc_id].held_out and r[label] is not None]
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in found.values())
    assert auc(np.array([found[r.doc_id].score for r in rows]), np.array([r[label] for r in rows])) > least


def test_held_out_languages(spark):
    found = Q.op6_langid(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out and lang[r.doc_id] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held) > 200
