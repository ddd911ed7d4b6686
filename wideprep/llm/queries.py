"""Registered queries of the training-data operators (``queries``) and their DuckDB SQL (``oracle_sql``).

Each query applies one operator with its production parameters to its whole table and derives
the contract's columns from the operator's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideprep.llm import chat, decontaminate, exact_dedup, fingerprints, langid, learn, lexical, mixing, pages, quality, sharding, simhash, toxicity, whitening


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_pagediff(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_text(_t(spark, d, "pages").select("page_id", "url", "html"))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, _t(spark, d, "labels")), keep=["doc_id"])
    return found.select("doc_id", (learn.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, _t(spark, d, "labels")), keep=["doc_id"])
    return found.select("doc_id", (learn.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = fingerprints.with_next(docs, "doc_id", F.xxhash64("text"), {"sketch": fingerprints.sketch(F.col("text"))}, ["text", "sketch"])
    n = F.length("text")
    cut = (n / 3).cast("int")      # floor: n is not negative
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    out = out.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.encode(F.col("sketch")).alias("fingerprint"),
        fingerprints.encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("n_shingles"))


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", (learn.fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mix(_t(spark, d, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: Replays the operator without histograms: running sums over the sources' rows by hash.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source),
weighted AS (
  SELECT source, n, list_extract([5, 2, 1], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)) AS w FROM src),
ranked AS (
  SELECT *, row_number() OVER o AS rn, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM weighted WHERE n > 0 WINDOW o AS (ORDER BY 2.0 * n / w, w, n)),
level AS (SELECT arg_min(room / w_left, rn) AS l FROM ranked WHERE room / w_left <= 2.0 * n / w),
wanted AS (
  SELECT source, n, CASE WHEN n = 0 THEN 0.0 WHEN l IS NULL OR l * w > 2 * n THEN 2.0 * n ELSE l * w END AS target FROM weighted, level),
budgets AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(floor(target / n), 2) END AS whole,
    target - CASE WHEN n = 0 THEN 0 ELSE least(floor(target / n), 2) END * n AS budget FROM wanted),
grouped AS (SELECT source, h, sum(size) AS g FROM sized GROUP BY source, h),
summed AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY h) AS upto FROM grouped)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, b.n AS source_size, CAST(b.target AS DOUBLE) AS target,
  CAST(s.size * (b.whole + CASE WHEN b.budget > 0 AND (q.upto <= b.budget OR (q.upto - q.g <= b.budget AND q.upto - b.budget < b.budget - (q.upto - q.g)))
    THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source JOIN summed q ON s.source IS NOT DISTINCT FROM q.source AND s.h = q.h
"""


def op8_chat(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.examples(turns.unionByName(added))
    back = F.when(F.col("last"), chat.parse(F.col("formatted")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
    read = made.select("conv_id", "example", back.alias("turns"), F.length("formatted").alias("chars"),
                       chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_len")).alias("loss")) \
        .select("conv_id", "example", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), digest).alias("digest"), "chars", "loss")
    found = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("losses.loss"), "")
    return found.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: All columns but the template's own length follow from the turns; that length is replayed with window sums.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, length(role) + length(text) + 13
    + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(replace(role || text, '<', ''), '>', ''))) AS chars FROM t),
placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM shown)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shards(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.scan(_t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_at AS (SELECT item, w, least(len(w), 13) AS l, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM item_at),
lengths AS (SELECT DISTINCT l FROM item_windows),
doc_at AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM words, lengths WHERE len(w) >= l),
hits AS (
  SELECT d.doc_id, d.i, d.l, b.item FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM doc_at) d
  JOIN item_windows b ON d.l = b.l AND d.win = b.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: CRC-32 by its definition: a table from the reflected polynomial, then one step a byte.
OP9_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
  row_number() OVER (ORDER BY doc_id) AS pos FROM sized),
placed AS (SELECT *, CAST(before * 8 // total AS INT) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(size - 1), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c // 256, t[1 + CAST(xor(c % 256, b) AS INT)])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed, crc
"""


def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.rank(_t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark"))


#: Scores every document that shares a term with an item: no signatures, no bounds.
OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
corpus AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM words),
held AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM words) GROUP BY r, t),
asked AS (
  SELECT item_id, t, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM held GROUP BY t), corpus),
sized AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * docs) // terms AS m FROM words, corpus WHERE len(w) > 0),
scores AS (
  SELECT item_id, s.r, any_value(s.doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN sized s ON s.r = held.r GROUP BY item_id, s.r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(_t(spark, d, "embeddings").select("vec_id", "embedding"))


def op13_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.groups(_t(spark, d, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS FIRST) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
  sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_pagediff, op2_toxicity, op3_quality, op4_fingerprints, op5_simhash, op6_langid, op7_mixing, op8_chat, op9_sharding, op10_decontaminate,
                                    op11_lexical_search, op12_whitening, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op8_chat": OP8_SQL, "op9_sharding": OP9_SQL, "op10_decontaminate": OP10_SQL,
            "op11_lexical_search": OP11_SQL, "op13_exact_dedup": OP13_SQL}
