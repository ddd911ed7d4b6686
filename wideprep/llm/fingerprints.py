"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes (48 bits) of a text's shingles of
``words`` words; fewer words make one shingle, none an empty sketch.  Equal texts have equal sketches.
The sketch of a union of texts' shingles is the bottom k of their sketches (``merge``,
``merge_parts``), so parts can be sketched anywhere and merged in any order.

Null texts are empty texts.  Two empty sketches resemble each other fully, an empty and another not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideprep.session import shuffle_partitions

WORDS = 5
K = 128
HASH_BITS = 48
#: Range buckets per shuffle partition when rows are paired with their successor.
BUCKETS_PER_PARTITION = 8
#: Rank error of the bucket bounds is at most rows / accuracy.
LEAST_ACCURACY = 10_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct shingle hashes of the lower-cased text, ascending."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")

    def hashes(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(words)]), 64 - HASH_BITS))

    # The words are bound once as a lambda variable; a plain reference could be inlined and split per shingle.
    found = F.transform(F.array(parts), lambda w: F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k))
    return found[0]


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch per group.  Only a group's k smallest hashes of each task leave it: a group of any
    number of parts never meets whole in one task."""
    best = Window.partitionBy(*by).orderBy("h")
    rows = parts.select(*by, F.explode_outer(column).alias("h")).distinct()
    return rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1) \
        .groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both sketches hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    kth = F.element_at(a, -1) + F.lit(1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (kth / F.lit(float(1 << HASH_BITS))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too (1 for an empty a)."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def encode(a: Column) -> Column:
    """A sketch as a string: its hashes, 6 bytes each, in base 64."""
    digits = HASH_BITS // 4
    raw = F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), digits, "0")), ""))
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are greater than ``key``, in two steps of sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    greater = lambda values: F.size(F.filter(values, lambda b: b > key))
    all_, coarse = F.lit(bounds), greater(F.lit(bounds[::step]))
    rest = F.slice(all_, (F.greatest(coarse, F.lit(1)) - 1) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + greater(rest))


def with_next(rows: DataFrame, key: str, tie: Column, derive: dict[str, Column], lead: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` for each column c of ``lead``: its value in the next row by descending ``key`` (a long; null last;
    equal keys by ``tie``), and in the first row after the last.

    Rows are shuffled once, into range buckets of the key; the first row of each bucket is sent to the bucket before, too,
    where it follows the last.  ``derive`` adds columns after the shuffle.  Two light jobs on the key alone come first; they
    bring one bound and one key per bucket to the driver.  Rows that share a key share a bucket.  Columns of ``rows`` named like a
    result are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop(*[f"next_{c}" for c in lead])
    n_parts = shuffle_partitions(spark)
    n = BUCKETS_PER_PARTITION * n_parts
    own = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = rows.select(own.alias("k"))
    cuts = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], max(LEAST_ACCURACY, 4 * n)).alias("b")).first()["b"]
    bounds = sorted(set(cuts or []), reverse=True)
    firsts = dict(keys.groupBy(_bucket(F.col("k"), bounds).alias("b")).agg(F.max("k")).collect())
    held = sorted(firsts)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    size = range(len(bounds) + 1)
    first, prev = F.lit([firsts.get(b, 0) for b in size]), F.lit([before.get(b, 0) for b in size])
    home = F.struct(F.col("__b").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(prev, F.col("__b")).alias("b"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("__k", own).withColumn("__b", _bucket(F.col("__k"), bounds)) \
        .withColumn("__home", F.explode(F.when(F.col("__k") == F.get(first, F.col("__b")), F.array(home, guest)).otherwise(F.array(home)))) \
        .withColumn("__b", F.col("__home.b")).withColumn("__guest", F.col("__home.guest")).drop("__home") \
        .repartition(n_parts, "__b").withColumn("__tie", tie).withColumns(derive)
    order = Window.partitionBy("__b").orderBy("__guest", F.col("__k").desc(), "__tie")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in lead]) \
        .where(~F.col("__guest")).drop("__k", "__b", "__guest", "__tie")
