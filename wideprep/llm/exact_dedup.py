"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical without the ASCII white space ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with
the most code points in its original text, then the smallest ``doc_id``, stays.  Winners are combined in three stages, and each
groups by the digest *and* the full normalised text, so that equal digests alone never merge two texts:

1. inside a task, before anything is shuffled (the partial step of the first aggregate);
2. among the tasks' winners of one (digest, salt): a hot text is dealt over ``SALTS`` groups by a hash of the id;
3. among the at most ``SALTS`` salt winners of a text.

The way back is light.  Stage 3 leaves one row per (digest, salt) without its text, and rows find their group by these two;
only where a digest turned out to hold several texts do its rows meet by full text again.

A null text is the empty text; empty and blank texts equal each other.  A null ``doc_id`` is smaller than any other.  Rows that
agree in ``doc_id``, length and normalised text are repeats: all of them are returned, one of them may be the row that stays.
An empty table gives no rows.  Columns with clashing names are no matter: ``groups`` reads ``doc_id`` and ``text`` alone,
``keep_one`` returns the columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.session import checkpoint_dir

BLANKS = r"[\x20\x09-\x0D]"
#: Groups that the copies of one text are dealt over before their winners meet.
SALTS = 32
#: Repeats of a row are written out in pieces of this many.
PIECE = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _parts(docs: DataFrame, doc_id: str, text: str, digest, salts: int, *more: Column) -> DataFrame:
    """Digest, salt and normalised text of every row, its id, length and the columns ``more``."""
    raw, key = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    rows = docs.select(normalised(raw).alias("norm"), F.length(raw).cast("long").alias("n_chars"), key.alias("id"), *more)
    # Keys that cannot be null: a join on them adds no filter that computes the digest a second time.
    return rows.select(F.coalesce(digest(F.col("norm")), F.lit("")).alias("digest"),
                       F.coalesce(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), F.lit(0)).alias("salt"), "*")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, salts: int = SALTS) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    checkpoint_dir(docs.sparkSession)
    parts = _parts(docs, doc_id, text, digest, salts)
    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("id").alias("id"))
    salted = parts.groupBy("digest", "salt", "norm").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    texts, digests = Window.partitionBy("digest", "norm"), Window.partitionBy("digest")
    merged = salted.repartition("digest") \
        .select("digest", "salt", "norm", F.min("best").over(texts).alias("best"), F.sum("n").over(texts).alias("group_size"),
                F.dense_rank().over(digests.orderBy("norm")).alias("nth")) \
        .withColumn("n_texts", F.max("nth").over(digests)) \
        .select("digest", "salt", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_chars"), "group_size", "n_texts",
                F.when(F.col("n_texts") > 1, F.col("norm")).alias("norm")).checkpoint()
    single, shared = merged.where("n_texts = 1").drop("norm"), merged.where("n_texts > 1")
    light = parts.groupBy("digest", "salt", "id", "n_chars").agg(F.count("*").alias("n"))
    found = light.join(single, ["digest", "salt"])
    if not shared.isEmpty():        # unequal texts of one digest: their rows meet by text
        of_text = parts.groupBy("digest", "salt", "id", "n_chars", "norm").agg(F.count("*").alias("n"))
        found = found.unionByName(of_text.join(shared, ["digest", "salt", "norm"]).drop("norm"))
    piece = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / PIECE).cast("int")))
    copy = F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int")))
    first = (F.col("piece") == 0) & (F.col("copy") == 1)
    return found.withColumn("piece", piece).withColumn("copy", copy).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (first & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, salts: int = SALTS) -> DataFrame:
    """The row of each group that stays, with all its columns.  Whole rows take the way of the three stages; repeats
    are told apart by their text and their other columns (maps and variants aside)."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    parts = _parts(docs, doc_id, text, digest, salts, F.col(f"`{text}`").alias("raw"),
                   F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rank = F.struct((-F.col("n_chars")).alias("neg"), F.col("id").alias("id"), F.col("raw").alias("raw"), F.col("tie").alias("tie"))
    salted = parts.withColumn("rank", rank).groupBy("digest", "salt", "norm").agg(F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"))
    return salted.groupBy("digest", "norm").agg(F.min_by("row", "rank").alias("row")).select("row.*")
