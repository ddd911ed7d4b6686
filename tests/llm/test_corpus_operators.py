"""Mixing, sharding, chat formatting, classifiers and the pipeline against brute force, SQL and held-out rows."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wideprep.llm import arrow_text, chat, langid, learn, mixing, quality, sharding, toxicity
from wideprep.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["word"] * rnd.randint(0, 30)), "en", "big" if i % 3 else rnd.choice(["a", "b", "é", "Z", None]), 1, "c") for i in range(300)]
    rows += [(5, "five five", None, "big", None, None)] * 4 + [(None, "x y", "en", "a", 1, "c"), (400, None, "en", "a", None, None), (401, "", None, "empty", 0, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_targets_are_water_filling():
    assert mixing.targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333]
    assert mixing.targets([10, 0, 90]) == [20.0, 0.0, 130.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rnd = random.Random(2)
    for _ in range(200):
        sizes = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 9))]
        got = mixing.targets(sizes)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))


def test_mix_comes_near_its_targets_and_is_stable(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    by = {}
    for r in got:
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] = max(s[1], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for (size, target), (taken, longest) in by.items():
        assert abs(taken - target) <= max(longest, 8)          # one row, or the one group of repeated rows
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))


def test_take_repeats_rows_as_planned(docs):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r.doc_id, r.size)] += r.copies
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    got = Counter((r.doc_id, len((r.text or "").split())) for r in taken.collect())
    assert got == +want
    assert mixing.take(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_refinement_reaches_single_hashes(spark, monkeypatch):
    """One bit a level: the same rows as with the usual levels."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    usual = sorted(tuple(r) for r in mixing.mix(rows).collect())
    monkeypatch.setattr(mixing, "LEVEL_BITS", 1)
    assert sorted(tuple(r) for r in mixing.mix(rows).collect()) == usual


def test_shards_are_contiguous_and_even(docs):
    got = sharding.shards(docs, n=8).collect()
    source = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == source
    total = sum(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.slot for r in order] == [i for s in range(8) for i in range(sum(r.shard == s for r in order))]
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in order]
    assert ids == sorted(ids)
    for s in range(8):
        assert abs(sum(r["size"] for r in order if r.shard == s) - total / 8) <= max(r["size"] for r in got)


def test_place_keeps_whole_rows(docs, tmp_path):
    clash = docs.withColumn("shard", F.lit("old"))
    for frame in (clash, clash.limit(0)):
        got = sharding.place(frame)
        assert sorted(got.columns) == sorted([*docs.columns, "shard", "slot"])
        assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, frame.select(*docs.columns).collect()))
    assert got.count() == 0


def test_place_tells_files_of_a_partitioned_table_apart(spark, tmp_path):
    """One task's files in the folders of a partitioned table share a name."""
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).alias("part"))
    rows.coalesce(1).write.partitionBy("part").parquet(str(tmp_path / "t"))
    given = spark.read.parquet(str(tmp_path / "t"))
    names = [r[0] for r in given.select("_metadata.file_name").distinct().collect()]
    assert len(names) == 1
    got = sharding.place(given)
    assert Counter(map(tuple, got.select(*given.columns).collect())) == Counter(map(tuple, given.collect()))
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.shards(given).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in got.collect()} == want


def test_hot_rows_spread_over_shards(spark):
    same = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    counts = [r["count"] for r in sharding.shards(same).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1


def test_chat_round_trip(spark):
    nasty = ["<|end|>\n", "&lt;|user|&gt;", "a<|assistant|>\nb", "", None, "\\### Assistant: </turn> ok", "&amp;amp;", "x\n" * 3]
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "odd|>\n<role"]), rnd.choice(nasty)) for c in range(30) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "assistant", "null id"), (50, None, "user", "no number"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (60, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.examples(df).withColumn("turns", chat.parse(F.col("formatted"))) \
        .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_len"))).collect()
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        own = sorted((m for m in made if m.conv_id == c), key=lambda m: m.example)
        assert [m.example for m in own] == [i for i, t in enumerate(turns) if t[2] == "assistant" or i == len(turns) - 1]
        for m in own:
            assert [tuple(x) for x in m.turns] == [t[2:] for t in turns[:m.example + 1]]
            assert m.loss == (turns[m.example][3] if turns[m.example][2] == "assistant" else "")
            assert m.last == (m.example == len(turns) - 1)
    assert chat.examples(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    norm = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    blank = lambda rows: [tuple(-1 if v is None else v for v in r) for r in rows]
    assert norm(blank(map(tuple, got.select(*columns).collect()))) == norm(blank(want.fetchall()))


def test_words_of_arrow_buffers():
    texts = ["Ab, cd", None, "", "é1 x" * 3, "  ", "end"]
    raw, offsets = arrow_text.string_buffers(pa.array(texts).slice(0))
    starts, ends, before = arrow_text.runs(arrow_text.WORD_BYTES[raw], offsets)
    words = [raw[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert words == ["Ab", "cd", "é1", "xé1", "xé1", "x", "end"] and before.tolist() == [0, 2, 2, 2, 6, 6, 7]
    hashes, (prefix,) = arrow_text.hash_words(raw, starts, ends, (2,))
    assert hashes[3] == hashes[4] and len(set(hashes.tolist())) == 6 and prefix[0] == 0 and prefix[2] != 0
    part = arrow_text.string_buffers(pa.array(texts).slice(3, 2))
    assert part[1].tolist() == [0, 15, 17]
    cut = list(arrow_text.slices(iter([pa.record_batch({"t": pa.array(texts)})]), "t", 6))
    assert [b.num_rows for b in cut] == [3, 1, 2]


def _labelled(n, seed, bad="vile"):
    rnd = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = list(rnd.choice(vocab, rnd.integers(20, 120)))
        label = int(i % 4 == 0)
        for _ in range(3 * label):
            words[rnd.integers(len(words))] = bad + str(rnd.integers(3))
        texts.append(" ".join(words))
        labels.append(label)
    return texts, np.array(labels)


def test_toxicity_learns_and_pools_in_any_chunk(monkeypatch):
    texts, labels = _labelled(400, 1)
    model = toxicity.fit(pa.table({"text": texts, "label": labels, "lang": ["en"] * 400}), least_seen=4000)
    new, want = _labelled(200, 2)
    ids, before = toxicity.features(pa.array([*new, "", None, "?!", new[0] * 50]))
    score = model.score(ids, before)
    assert ((score[:200] >= 0.5) == want).mean() > 0.95
    assert score[200] == score[201] == score[202] < 0.5 and ((score >= 0) & (score <= 1)).all()
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.abs(model.score(ids, before) - score).max() < 1e-4


def test_training_gradient_is_right():
    """A step along the gradient of one batch lowers its loss for every kind of parameter."""
    texts, labels = _labelled(40, 3)
    ids, before = toxicity.features(pa.array(texts))
    weight = np.ones(40, np.float32)

    class Probe:
        def step(self, grads, rows):
            self.grads, self.rows = grads, rows

    for name in ("table", "conv", "bias", "out", "base"):
        model, probe = toxicity.Model(2), Probe()
        model.table *= 4
        model.live[0] = False
        model.table[0] = 0
        loss = toxicity._train_batch(model, probe, ids, before, labels.astype(np.float32), weight)
        grad, at = probe.grads[name], probe.rows.get(name, slice(None))
        param = getattr(model, name)
        step = 1e-3 / max(1e-9, float(np.sqrt((grad ** 2).sum())))
        param[at] -= step * grad
        after = toxicity._train_batch(model, Probe(), ids, before, labels.astype(np.float32), weight)
        want = step * float((grad ** 2).sum())
        assert loss - after == pytest.approx(want, rel=0.25, abs=2e-6), name


def test_quality_pools_and_calibrates():
    good = ["the old house stands near the river and the wood " * 4, "a man walks by the house and the river " * 3]
    bad = ["the&&& old$$$ house### stands*** near&&& " * 5, "RIVER!! WOOD!! MAN!! WALKS!! " * 6]
    texts = [x[:len(x) - k] for k in range(60) for x in good + bad]
    labels = np.array([1, 1, 0, 0] * 60, float)
    ids, before = quality.tokens(pa.array(texts))
    total = np.zeros(quality.BUCKETS * quality.DIM)
    quality.count_contexts(ids, before, total, *quality.index_vectors())
    v = total.reshape(quality.BUCKETS, -1)
    v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    x = quality.pool(ids, before, v)
    assert np.abs(x - quality.pool(ids, before, v, chunk=37)).max() < 1e-4
    net = quality.Network().fit(x.astype(float), labels)
    assert ((net.score(x) >= 0.7) == labels).mean() > 0.98
    empty = quality.pool(*quality.tokens(pa.array(["", None, " "])), v)
    assert not empty.any() and np.isfinite(net.score(empty)).all()


def test_context_vectors_count_the_whole_corpus(spark):
    rows = spark.createDataFrame([(i, "red blue green red") for i in range(50)] + [(99, None)], "doc_id long, text string").repartition(5)
    got = quality.context_vectors(rows)
    ids, before = quality.tokens(pa.array(["red blue green red"] * 50))
    total = np.zeros(quality.BUCKETS * quality.DIM)
    quality.count_contexts(ids, before, total, *quality.index_vectors())
    assert set(np.flatnonzero(got.any(axis=1))) <= set(ids.tolist()) and set(np.flatnonzero(total.reshape(-1, quality.DIM).any(axis=1))) == set(ids.tolist())
    assert not quality.context_vectors(rows.limit(0)).any()


def test_language_id(spark):
    english, french = "the quick brown fox jumps over this lazy dog ", "le renard brun saute par dessus ce chien paresseux "
    rows = [(i, (english if i % 2 else french) * (1 + i % 5), "en" if i % 2 else "fr", "s", 1, "x") for i in range(200)]
    rows += [(300, None, "en", None, None, None), (301, "12 - 7 !", "en", None, None, None), (302, "x" * 300_000, None, "s", 1, None), (None, "the dog", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("size string", "language string"))
    model = langid.train(df, folds=3, held_out=1)
    got = {r.doc_id: r.language for r in langid.predict(df, model).collect()}
    held = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(got) == len(rows) and all(got[r[0]].lang == r[2] for r in held)
    assert got[300].lang == got[301].lang == "und" and got[300].score == 0 and got[301].rejected
    assert got[302].lang in ("en", "fr") and 0 <= got[302].score <= 1
    nothing = langid.train(df.limit(0))
    assert {r.language.lang for r in langid.predict(df, nothing).collect()} == {"und"}


def test_language_id_learns_rare_languages(spark, monkeypatch):
    """Languages that a uniform sample of the corpus misses, or holds once, are learned and predicted."""
    rnd = random.Random(6)
    vocab = {x: ["".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(60)]
             for x, letters in (("aa", "abcdefg"), ("bb", "efghijkl"), ("cc", "mnopqrst"), ("dd", "stuvwxyz"))}
    langs = ["aa"] * 6000 + ["bb"] * 2000 + ["cc"] * 9 + ["dd"] * 3
    rows = [(i, " ".join(rnd.choices(vocab[x], k=20)), x) for i, x in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert learnt == set(vocab)
    model = langid.train(df, sample=200)
    assert model.names == sorted(vocab)
    got = {r.doc_id: r.language.lang for r in langid.predict(df, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[2] in ("cc", "dd"))
    assert sum(got[r[0]] == r[2] for r in rows) >= 0.99 * len(rows)
    for seed in range(8):       # the only row of a language is never held back
        table = pa.table({"text": [r[1] for r in rows[:40] + rows[-1:]], "lang": ["aa"] * 40 + ["dd"]})
        model = langid.fit(table, seed=seed)
        assert model.names[int(model.probabilities(*langid.subwords(pa.array([rows[-2][1]]))).argmax())] == "dd"


def test_subwords_stay_in_their_row():
    codes, before = langid.subwords(pa.array(["ab", None, "", "abc d", "ab"]))
    each = [codes[a:b].tolist() for a, b in zip(before[:-1], before[1:])]
    assert each[0] == each[4] and len(each[0]) == 3 and each[1] == each[2] == [] and len(each[3]) == 3 + 2 + 1
    assert [c.tolist() for c in langid.subwords(pa.array([], pa.string()))] == [[], [0]]


def test_classifiers_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = docs.withColumn("score", F.lit("clash"))
    for found in (toxicity.score(some, toxicity.train(docs, none)), quality.score(some, quality.train(docs, none))):
        assert found.where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_long_texts_do_not_displace_short_ones(spark):
    """The sample's bytes are bounded; the longest texts go first, and every group keeps its share."""
    rows = [(i, "short text " * (1 + i % 3), 1) for i in range(300)] + [(1000 + i, "long " * 20_000, 1) for i in range(100)]
    rows += [(2000, "often " * 20, 1)] * 2000 + [(3000 + i, "long " * 3000, 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(sorted({(r[0], r[2]) for r in rows}), "doc_id long, label int")
    for room, want in ((400_000, {0, 1}), (100 << 20, {0, 1}), (70_000, {0, 1}), (3000, {1})):
        wanted = learn.draw(docs, labels, "label", lambda counts: {0: 200, 1: 200}, max_bytes=room)
        table = learn.gather(docs, wanted).to_pydict()
        ones = {i for i, x in zip(table["doc_id"], table["label"]) if x == 1}
        assert sum(map(len, table["text"])) <= room and set(table["label"]) == want
        assert len(ones) == 200 or room < 10_000
        assert room > 1 << 20 or all(i < 1000 for i in ones)
        assert room < 1 << 20 or (len(set(table["doc_id"])) == 240 and any(i >= 1000 for i in ones))
    assert learn.draw(docs.limit(0), labels, "label", lambda counts: {}).count() == 0


def test_rare_language_of_long_texts_is_learned(spark, monkeypatch):
    rows = [(i, "the quick brown fox " * 40, "en") for i in range(400)] + [(1000 + i, "renard brun saute " * 3000, "fr") for i in range(9)]
    monkeypatch.setattr(learn.draw, "__defaults__", tuple(200_000 if x == learn.SAMPLE_BYTES else x for x in learn.draw.__defaults__))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df))
    assert got.where("language.lang != lang").count() == 0


def test_calibration_helpers():
    assert learn.best_threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1])) == 1.5
    z = np.random.default_rng(0).normal(0, 4, 4000)
    y = (np.random.default_rng(1).random(4000) < learn.sigmoid(z / 2)).astype(int)
    assert learn.temperature(z, y) == pytest.approx(2, rel=0.2)
    ids, sums = learn.sum_rows(np.array([3, 1, 3]), np.ones((3, 2)))
    assert ids.tolist() == [1, 3] and sums.tolist() == [[1, 1], [2, 2]]


def test_pipeline_against_its_operators(spark, tmp_path):
    """Every stage works on what the stage before left, and decides as the operator alone does."""
    import corpus_pipeline
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    left = given
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, SF).write.parquet(str(tmp_path / str(k)))
        before, left = left, spark.read.parquet(str(tmp_path / str(k)))
        ids, old = [r.doc_id for r in left.collect()], [r.doc_id for r in before.collect()]
        if k < 4:
            assert left.columns == given.columns
        if k == 1:
            classes = {r.doc_id: r.component_id for r in Q.simhash.near_duplicates(before.select("doc_id", "text")).collect()}
            assert sorted(ids) == sorted(set(classes.values()))
        elif k == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            hits = Q.decontaminate.scan(before, bench).where(~Q.decontaminate.is_contaminated())
            assert sorted(ids) == sorted(r.doc_id for r in hits.collect())
        elif k == 3:
            assert Counter(ids) == +Counter({r.doc_id: r.copies for r in mixing.mix(before).collect()})
        elif k == 4:
            assert Counter(ids) == Counter(old)
            bytes_ = [r[1] for r in left.groupBy("shard").agg(F.sum(F.octet_length("text") + 1)).collect()]
            assert max(bytes_) - min(bytes_) <= 2 * max(len(r.text.encode()) + 1 for r in left.collect())
        assert set(ids) <= set(old)


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, 5), (3, "x " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hits", F.lit(1))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= 2 * frame.count()
            assert set(docs.columns) <= set(out.columns), name
