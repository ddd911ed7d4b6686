"""Exact quantiles by selection on order-preserving integers (AGG9 median).

Spark's exact ``percentile`` keeps every value of a group in one task's memory, which a billion-row column
does not survive.  Here every double gets a 64-bit integer of the same order (its IEEE 754 bits, negated
for negative numbers), and the value at a rank is found digit by digit, ``BITS`` bits a level:

1. One pass counts the cells by column and leading digit (at most ``2**BITS`` bins a column): numpy reads the
   bits of each Arrow batch and counts them there, Spark sums the batches' counts, in every task first.  The bins' running counts name the bin that holds each wanted rank.
2. A second pass counts the next digit inside these bins only.
3. A third pass reduces what lies in the bins that are left, some 2**-20 of a column's value range each, to a
   frequency table (column, key, count), written to the checkpoint folder.  Copies of a value collapse
   into one row before any shuffle, so a hot value is a number, not rows.
4. The remaining digits are read off that table.

As soon as the bins that are left hold at most ``2**BITS`` cells each, their keys take the place of digits and the next pass is the last.

No accuracy is chosen, no bracket can miss and the work does not depend on how values are spread.  A bin list is at
most ``2**BITS`` small entries however long the column.  Linear interpolation between the values at the two ranks around
``p * (n - 1)`` gives the same answer as pandas / NumPy ``linear`` quantiles.  The result (one row
per column and probability) reaches the driver, where keys become values again.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideprep.functions.numeric import NUMERIC_TYPES, nan_to_null
from wideprep.operators._util import AGG_CHUNK, chunks, col, union_all, unpivot
from wideprep.session import checkpoint_dir

#: Bits of a digit; four digits make a key.
BITS = 16
#: Digits read from the whole table before the rest is written out.
SCANNED = 2


def numeric_wide(df: DataFrame, columns=None) -> DataFrame:
    """The numeric columns as doubles, NaN as null."""
    names = [f.name for f in df.schema.fields
             if (columns is None or f.name in columns) and isinstance(f.dataType, NUMERIC_TYPES)]
    return df.select(*[nan_to_null(col(c).cast("double")).alias(c) for c in names])


def numeric_long(df: DataFrame, columns=None) -> DataFrame:
    """``column, v`` (double) for every non-missing numeric cell."""
    wide = numeric_wide(df, columns)
    return unpivot(wide, [], wide.columns, "column", "v").where(F.col("v").isNotNull())


def _keys(values: np.ndarray) -> np.ndarray:
    """The keys of doubles (no NaN): the bits, negated for negative numbers; -0.0 as 0.0."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits)


def with_key(long: DataFrame, value: str = "v", out: str = "key") -> DataFrame:
    """Add the 64-bit integer ``out`` that orders like the double ``value`` (-0.0 as 0.0; no NaN)."""
    key = F.pandas_udf(lambda v: pd.Series(_keys(v.to_numpy())), "long")
    return long.withColumn(out, key(F.col(value)))


def key_value(key: int) -> float:
    """The double of a key."""
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


def _counts(wide: DataFrame, inside: dict[str, list[int]] | None, above: int, shift: int) -> DataFrame:
    """``column, prefix, key, n``: the cells of the double columns ``wide`` by the digits of their key down to bit ``shift`` (the lower bits
    of ``key`` are 0), counted within each Arrow batch.  ``prefix`` is the key from bit ``above``; only cells whose prefix is in ``inside`` count
    (None: all, prefix 0)."""
    if len(wide.columns) > AGG_CHUNK:       # a batch holds so many columns at most
        return union_all([_counts(wide.select(*[col(c) for c in part]), inside, above, shift) for part in chunks(wide.columns)])
    names = wide.columns
    wanted = None if inside is None else [np.array(sorted(inside.get(c, ())), np.int64) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(names)):
                if wanted is not None and not len(wanted[i]):
                    continue
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                key = _keys(v[~np.isnan(v)])
                if wanted is not None:
                    key = key[np.isin(key >> above, wanted[i])]
                bins, n = np.unique(key >> shift, return_counts=True)
                found.append((i, bins, n))
            if found:
                bins = np.concatenate([b for _, b, _ in found])
                prefix = np.zeros(len(bins), np.int64) if wanted is None else bins >> (above - shift)
                column = pa.array(names).take(pa.array(np.repeat([i for i, _, _ in found], [len(b) for _, b, _ in found]), pa.int64()))
                yield pa.RecordBatch.from_arrays([column, pa.array(prefix), pa.array(bins << shift), pa.array(np.concatenate([n for _, _, n in found]).astype(np.int64))],
                                                 names=["column", "prefix", "key", "n"])

    return wide.mapInArrow(run, "column string, prefix long, key long, n long")


def _bin_lists(rows: DataFrame, shift: int) -> DataFrame:
    """``column, prefix, bins``: for each column and prefix of ``rows`` (``column, prefix, key, n``) its counts by digit, in order."""
    counts = rows.groupBy("column", "prefix", F.shiftright("key", shift).alias("bin")).agg(F.sum("n").alias("n"))
    return counts.groupBy("column", "prefix").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def _at_rank(bins: str, rank: Column, before: Column) -> Column:
    """The bin that holds ``rank`` (0-based), its count and the count below it, ``before`` being the count below the first bin."""
    start = F.struct(before.cast("long").alias("upto"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("n"))

    def step(at, b):
        here = at.bin.isNull() & (at.upto + b.n > rank)
        return F.struct((at.upto + b.n).alias("upto"), F.when(here, b.bin).otherwise(at.bin).alias("bin"), F.when(here, at.upto).otherwise(at.below).alias("below"),
                        F.when(here, b.n).otherwise(at.n).alias("n"))

    return F.aggregate(bins, start, step)


def _narrow(spark, lists: DataFrame, targets: list[tuple]) -> list[tuple]:
    """``targets`` (column, rank, prefix, count below the prefix, count in it) one digit further."""
    side = spark.createDataFrame([t[:4] for t in targets], "column string, rank long, prefix long, before long")
    found = lists.join(F.broadcast(side), ["column", "prefix"])          # one row per column and rank
    found = found.select("column", "rank", _at_rank("bins", F.col("rank"), F.col("before")).alias("f"))
    return [(r["column"], r["rank"], r["f"]["bin"], r["f"]["below"], r["f"]["n"]) for r in found.collect()]


def _inside(spark, rows: DataFrame, targets: list[tuple], shift: int) -> DataFrame:
    """The rows in the targets' bins, with the bin as ``prefix``."""
    side = spark.createDataFrame(sorted({(c, p) for c, _, p, *_ in targets}), "column string, prefix long")
    return rows.withColumn("prefix", F.shiftright("key", shift)).join(F.broadcast(side), ["column", "prefix"])


def exact_quantiles(df: DataFrame, columns=None, probs=(0.5,)) -> DataFrame:
    """``column, prob, value`` exact linear-interpolated quantiles per numeric column; a column without values has no row."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    wide, rows = numeric_wide(df, columns), None
    shift = 64 - BITS
    lists = _bin_lists(_counts(wide, None, 64, shift), shift)
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b.n)
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.least(F.floor(r) + 1, F.col("total") - 1)) for r in place])))
    first = lists.withColumn("total", total).withColumn("rank", F.explode(ranks)) \
        .select("column", "rank", "total", _at_rank("bins", F.col("rank"), F.lit(0)).alias("f")).collect()
    totals = {r["column"]: r["total"] for r in first}
    targets, level = [(r["column"], r["rank"], r["f"]["bin"], r["f"]["below"], r["f"]["n"]) for r in first], 1
    while targets and shift:
        last, above = max(t[4] for t in targets) <= 1 << BITS, shift
        shift = 0 if last else shift - BITS
        if rows is not None:
            digits = rows = _inside(spark, rows, targets, above)
        else:
            inside: dict[str, list[int]] = {}
            for c, _, prefix, *_ in targets:
                inside.setdefault(c, []).append(prefix)
            written = level == SCANNED and not last
            digits = _counts(wide, inside, above, 0 if written else shift)
            if written:
                digits = rows = digits.groupBy("column", "prefix", "key").agg(F.sum("n").alias("n")).checkpoint()
        level += 1
        targets = _narrow(spark, _bin_lists(digits, shift), targets)
    at = {(c, rank): key_value(key) for c, rank, key, *_ in targets}
    out = []
    for c, n in sorted(totals.items()):
        for p in probs:
            r = float(p) * (n - 1)
            k = math.floor(r)
            low, high = at[(c, k)], at[(c, min(k + 1, n - 1))]
            out.append((c, float(p), low if r == k else low + (r - k) * (high - low)))
    return spark.createDataFrame(out, "column string, prob double, value double")


def median(df: DataFrame, columns=None) -> DataFrame:
    """``column, median`` per numeric column (exact)."""
    return exact_quantiles(df, columns, (0.5,)).select("column", F.col("value").alias("median"))


def mean_median(df: DataFrame, columns=None) -> DataFrame:
    """AGG9: ``column, mean, median`` per numeric column, missing values ignored."""
    long = numeric_long(df, columns)
    means = long.groupBy("column").agg(F.avg("v").alias("mean"))
    return means.join(median(df, columns), "column", "left")
