"""SimHash, decontamination, fingerprints and page differencing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wideprep.llm import components, decontaminate, fingerprints, pages, simhash
from wideprep.llm.arrow_text import window_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, tied, repeated and very long rows, and an extra column with a clashing name."""
    rnd = random.Random(3)
    words = [f"w{i}é" for i in range(40)]
    body = [" ".join(rnd.choices(words, k=60)) for _ in range(12)]
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(body)]
    rows += [(20, body[0], "en", "s", 1, "x"), (20, body[0], "en", "s", 1, "x"), (20, body[1], None, None, None, None)]
    rows += [(21, "", "en", "s", 0, None), (22, None, "en", "s", None, None), (None, body[2], None, "s", 2, "y"), (None, None, None, None, None, None)]
    rows += [(23, " ".join(rnd.choices(words, k=60_000)), "en", "t", 9, "z"), (24, "One", "en", "t", 3, "z"), (25, "one two", "en", "t", 3, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _fp(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _classes(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_match_brute_force(odd):
    rows = odd.collect()
    fps = [_fp(r.text) for r in rows]
    label = _classes(fps)
    want = []
    for r, f, c in zip(rows, fps, label):
        ids = [x.doc_id for x, y in zip(rows, label) if y == c and x.doc_id is not None]
        want.append((r.doc_id, f, min(ids) if ids else None, r.score))
    got = simhash.near_duplicates(odd.withColumn("fp", F.lit("clash"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(g.doc_id, g.fp % (1 << 64), g.component_id, g.score) for g in got], key=key) == sorted(want, key=key)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(label))
    assert {r.doc_id for r in kept.collect()} == {w[2] for w in want}


@pytest.mark.parametrize("tile,blocks", [(4, None), (2048, None), (2048, 4), (7, 5), (3, 6)])
def test_links_find_every_class(spark, tile, blocks):
    rnd = random.Random(tile)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))) for s in seeds for _ in range(25)} | {rnd.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % (1 << 64): r.root for r in components.connected_components(simhash.links(df, 3, tile, blocks)).collect()}
    label = _classes(fps)
    groups = {}
    for f, c in zip(fps, label):
        groups.setdefault(c, []).append(f)
    for g in groups.values():
        assert len({found.get(f) for f in g}) == 1
        assert (len(g) == 1) == (g[0] not in found)


def test_tile_pairs_hold_every_link_and_skip_the_rest(spark):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1, 7, 1 << 63}
    fps |= {f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for f in list(fps)[:150]}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    tiles, pairs = simhash.tile_pairs(df, 3, 4)
    held = [x for r in tiles.collect() for x in np.frombuffer(r.fps, np.uint64).tolist()]
    assert sorted(held) == sorted(fps)
    met = set()
    for r in pairs.collect():
        a, b = (np.frombuffer(x, np.uint64).tolist() for x in (r.fps, r.fps2))
        found = {frozenset((x, y)) for x in a for y in b if x != y}
        assert r.first == r.first2 or not found & met            # no pair of fingerprints is compared twice
        met |= found
    want = {frozenset((x, y)) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3}
    counts = lambda x: [(x >> 16 * k & 0xFFFF).bit_count() for k in range(4)]
    near = {frozenset((x, y)) for x in fps for y in fps if x < y and sum(abs(p - q) for p, q in zip(counts(x), counts(y))) <= 3}
    assert want <= met == near and len(near) < len(fps) ** 2 / 10


def test_tile_links_are_a_spanning_forest():
    u, v = simhash.compare_tiles(np.arange(8, dtype=np.uint64), None, 3)
    assert len(u) == 7 and len(set(u.tolist())) == 7
    chain = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)
    assert len(simhash.compare_tiles(chain, None, 1)[0]) == 63
    assert len(simhash.compare_tiles(chain[:3], chain[40:], 3)[0]) == 0
    assert len(simhash.compare_tiles(chain[:3], chain[3:6], 3)[0]) == 5


def test_components_of_a_chain_and_an_empty_table(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "u long, v long")
    found = {r.node: r.root for r in components.connected_components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(none, bench).count() == 0
    paired = fingerprints.with_next(none.select("doc_id", "text"), "doc_id", F.xxhash64("text"), {"s": fingerprints.sketch(F.col("text"))}, ["text"])
    assert paired.count() == 0
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contamination(text, items):
    w = _words(text)
    hit, names = set(), set()
    for item, t in items:
        b = _words(t)
        n = min(13, len(b))
        for k in range(len(b) - n + 1 if b else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == b[k:k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item) if item is not None else "null")
    return len(w), len(hit), sorted(names)


def test_scan_matches_brute_force_on_both_ways(spark, odd):
    rnd = random.Random(5)
    texts = [r.text for r in odd.where("length(text) between 10 and 10000").collect()]
    items = [(7, texts[0][20:180]), (8, texts[1]), (9, "ONE"), (10, "one-two"), (11, ""), (12, None), (None, texts[3][:90]), (8, texts[4]), (13, " ".join(rnd.choices(texts[5].split(), k=14)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.where("doc_id is null or doc_id != 23").withColumn("hits", F.lit(1))
    key = lambda r: (str(r.doc_id), str(r.text))
    for limit in (decontaminate.MAX_SET_BYTES, 0):
        got = sorted(decontaminate.scan(docs, bench, max_set_bytes=limit).collect(), key=key)
        assert [(r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in got] == [_contamination(r.text, items) for r in got]
        assert len(got) == docs.count()
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = [n for n in (_contamination(r.text, items) for r in docs.collect()) if n[1] and 20 * n[1] >= n[0]]
    assert bad and kept.count() == docs.count() - len(bad)
    for r in decontaminate.cut_spans(docs, bench).where("text is not null").collect():
        assert not any(w in ("one", "two") for w in _words(r.text))


def test_spans_are_the_same_on_both_ways(spark, odd):
    """The shuffled join reports the broadcast set's spans, and cut_spans takes it for a large benchmark."""
    texts = [r.text for r in odd.where("length(text) between 10 and 10000").collect()]
    edge = ("ONE", "  É-" + texts[0] + " !! ", texts[1][:70] + " gap " + texts[1][70:], None)
    docs = odd.unionByName(spark.createDataFrame([(30 + i, t, "en", "s", 1, "x") for i, t in enumerate(edge)], SCHEMA))
    items = [(7, texts[0][20:180]), (7, texts[0][60:240]), (8, texts[1]), (9, "one"), (10, "one-two"), (11, ""), (12, None), (None, texts[3][:90])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda df: sorted(map(str, df.collect()))
    for wanted in (bench, bench.limit(0)):
        whole = decontaminate.scan(docs, wanted)
        assert norm(decontaminate.scan(docs, wanted, max_set_bytes=-1)) == norm(whole)
    assert decontaminate.scan(docs, bench).where("size(hits.spans) > 1").count() and not whole.where("size(hits.spans) > 0").count()
    cut = decontaminate.cut_spans(docs, bench, max_set_bytes=-1)
    assert cut.columns == docs.columns and norm(cut) == norm(decontaminate.cut_spans(docs, bench))
    assert norm(cut) != norm(docs)


def test_cut_spans_does_not_broadcast_a_large_benchmark(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "_scan", None)
    bench = spark.createDataFrame([(1, "one two"), (2, "zz " * (decontaminate.MAX_SET_BYTES // 3 + 1))], "item_id long, text string")
    assert {r.text for r in decontaminate.cut_spans(odd.where("doc_id in (24, 25)"), bench).collect()} == {"One", ""}


def test_long_text_is_scanned_whole(spark, odd):
    long = odd.where("doc_id = 23").first().text
    tail = " ".join(long.split()[-20:])
    found = decontaminate.scan(odd.where("doc_id = 23"), spark.createDataFrame([(1, tail)], "item_id long, text string")).first()
    assert found.hits.n_words == 60_000 and found.hits.n_hit >= 20 and found.hits["items"] == ["1"]
    assert found.hits.spans[-1].end == len(long.encode())


def test_window_hashes_do_not_depend_on_the_block(monkeypatch):
    words = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = window_hashes(words, 13)
    monkeypatch.setattr("wideprep.llm.arrow_text.BLOCK", 700)
    assert (window_hashes(words, 13) == whole).all()
    assert (window_hashes(words[100:], 13) == whole[100:]).all()


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_and_merge(spark, odd):
    rows = [r for r in odd.collect()]
    got = {(r.doc_id, r.text): r.s for r in odd.select("doc_id", "text", fingerprints.sketch(F.col("text")).alias("s")).collect()}
    assert got[(22, None)] == got[(21, "")] == [] and got[(0, rows[0].text)] == got[(20, rows[0].text)] if (0, rows[0].text) in got else True
    pair = odd.where("doc_id = 23").selectExpr("text as a", "substring(text, 60000) as b")
    s = pair.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "ab"], fingerprints.sketch(F.concat_ws(" ", "a", "b")).alias("ab"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    r = s.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("b"), F.col("a")).alias("c"),
                 fingerprints.distinct_shingles(F.col("a")).alias("n"), "ta", "tb").first()
    a, b = _shingles(r.ta), _shingles(r.tb)
    assert abs(r.j - _jaccard(a, b)) < 0.15 and r.c > 0.8 and abs(r.n / len(a) - 1) < 0.3
    parts = odd.withColumn("g", F.col("source")).select("g", fingerprints.sketch(F.col("text")).alias("sketch"))
    merged = {x.g: x.sketch for x in fingerprints.merge_parts(parts, ["g"]).collect()}
    for g, own in merged.items():
        union = sorted(set().union(*[set(x.sketch) for x in parts.collect() if x.g == g]))
        assert own == union[:fingerprints.K]


def test_with_next_wraps_and_orders(spark, odd):
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(rows, "doc_id", F.col("text"), {}, ["doc_id", "text"]).collect()
    order = sorted(rows.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text.encode()))
    want = [(r.doc_id, r.text, n.doc_id, n.text) for r, n in zip(order, order[1:] + order[:1])]
    key = lambda x: tuple(map(str, x))
    assert sorted([(g.doc_id, g.text, g.next_doc_id, g.next_text) for g in got], key=key) == sorted(want, key=key)
    one = fingerprints.with_next(rows.where("doc_id = 24"), "doc_id", F.col("text"), {}, ["doc_id"]).collect()
    assert [r.next_doc_id for r in one] == [24]


def test_op4_against_brute_force(spark):
    from wideprep.llm.queries import op4_fingerprints
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in op4_fingerprints(spark, SF).collect()}
    errors = []
    for r, n in zip(docs, docs[1:] + docs[:1]):
        cut = len(r.text) // 3
        edited = r.text[:len(r.text) - cut] + n.text[:cut]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(g.near_edited - _jaccard(_shingles(r.text), _shingles(edited))))
    assert np.mean(errors) < 0.04 and max(errors) < 0.25


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rnd = random.Random(bits)
    for _ in range(400):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        at = pages.align(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and len(at) == _lcs(a, b) and all(a[i] in rest for i in at)


def test_lines_and_zones():
    got = pages.lines('<head><title>T</title><body class="has-sidebar"><header>Site</header><div class="cookie-notice">We use</div><script>x="</p>"</script>'
                      '<div id=content><h2>A &amp; b&nbsp;c</h2><p>one <b>bold</b> two<br>three<div hidden>no</div><ul><li>a<li>b</ul>'
                      '<div class="post-comments"><article>c1</article></div></div><aside>q</aside> tail 1 < 2 <!-- never')
    assert [t for z, t in got if z == pages.OPEN] == ["A & b c", "one bold two three", "a", "b", "tail 1 < 2"]
    assert {t for z, t in got if z == pages.ASIDE} == {"Site", "We use", "no", "c1", "q"}
    assert pages.lines(None) == pages.lines("") == []
    assert len(pages.lines("<p>x" * 20_000)) == 20_000 and pages.lines("<a " * 5000) != []


def test_pages_lose_shared_lines_and_keep_articles(spark):
    plain = "<div>Home</div><div>Top stories</div><p>{0} is a long line of the article itself.</p><p>And {0} goes on with much more text of its own here.</p><div>All rights</div>"
    marked = "<nav>Menu {0}</nav><article><h1>{0}</h1><p>quoted line</p></article><footer>&copy; x</footer>"
    rows = [(i, f"http://a.example/{i}", plain.format(f"Page{i}")) for i in range(6)]
    rows += [(10 + i, f"https://b.example/x/{i}?q=1", marked.format(i)) for i in range(4)]
    rows += [(20, "http://solo.example/", "<p>alone</p>"), (21, None, "<p>no host</p>"), (22, "http://a.example/9", None), (None, "http://a.example/0", plain.format("Page0"))]
    rows += [(30 + i, f"http://c.example/{i}", "<p>a copy</p>") for i in range(3)] + [(12, "https://b.example/x/2?q=1", marked.format(2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = pages.main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.url and "a.example" in r.url and not r.url.endswith("/9"):
            name = f"Page{r.url[-1]}"
            assert r.text == f"{name} is a long line of the article itself.\nAnd {name} goes on with much more text of its own here." and r.n_shared == 3
        elif r.url and "b.example" in r.url:
            assert r.text == f"{(r.page_id or 0) - 10}\nquoted line"
    by = {r.page_id: r.text for r in got}
    assert by[20] == "alone" and by[21] == "no host" and by[22] == "" and by[30] == by[32] == "a copy"


def test_op1_extracts_the_articles(spark):
    import html

    from wideprep.llm.queries import op1_pagediff
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op1_pagediff(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_columns_named_like_inner_ones_pass_through(spark):
    html = "<html><body><nav>menu</nav><article><p>one two</p></article></body></html>"
    rows = [(i, f"http://h.x/{i}", html, "a", "b", "c", "d", None) for i in range(3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, row string, partner string, text string")
    got = pages.main_text(table, keep=["page_id", "html", "host", "path", "row", "partner", "text"]).collect()
    assert [(r.html, r.host, r.path, r.row, r.partner, r.text) for r in got] == [(html, "a", "b", "c", "d", "one two")] * 3
    docs = spark.createDataFrame([(i, f"text {i}", "x", 7) for i in range(5)], "doc_id long, text string, next_text string, s int")
    paired = fingerprints.with_next(docs, "doc_id", F.xxhash64("text"), {"s": fingerprints.sketch(F.col("text"))}, ["text", "s"])
    assert {r.doc_id: r.next_text for r in paired.collect()} == {0: "text 4", **{i: f"text {i - 1}" for i in range(1, 5)}}


def test_shards_keep_clashing_columns(spark):
    from wideprep.llm import sharding
    docs = spark.createDataFrame([(i, "x" * i, i + 100, "p", "q") for i in range(6)], "doc_id long, text string, size long, part string, salt string")
    got = sharding.shards(docs, keep=["size", "part", "salt", "doc_id", "text"], n=2).collect()
    assert {(r.doc_id, r.size, r.part, r.salt, r.text) for r in got} == {(i, i + 1, "p", "q", "x" * i) for i in range(6)}


def test_repeated_ids_give_one_training_example(spark):
    from wideprep.llm import quality
    docs = spark.createDataFrame([(i % 9, f"word{i % 3} other{i % 5} more") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    seen = []
    fit = quality.Network.fit
    try:
        quality.Network.fit = lambda self, x, y, **kw: seen.append(len(y)) or fit(self, x, y, **kw)
        quality.train(docs, labels, epochs=1)
    finally:
        quality.Network.fit = fit
    assert seen and seen[0] <= 9
