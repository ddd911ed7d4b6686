"""Contiguous shards of near equal bytes by global prefix sums.

Rows are range-partitioned and sorted by id once (a light table: no texts).  Each partition's bytes and rows
are summed, the running sums of those totals give every partition its offset, and a window inside the
partition adds the rows' own prefix.  A row whose preceding bytes are b of B goes to shard
``b * shards // B``: every shard ends within one row of its equal target.

A null text has no bytes (size 1, crc32 0).  Null ids sort first.  Ties in the id are ordered by size and crc32;
rows equal in all of these are interchangeable and are spread by a salt, so that repeated rows fill no single
partition.  Extra columns are ignored by ``shards`` and
pass through ``place``, which replaces columns named shard or slot.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideprep.session import checkpoint_dir, shuffle_partitions

SHARDS = 8


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHARDS,
           keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (place in the shard, from 0) of every row,
    and the (light) columns ``keep`` (those named like a result are replaced by it)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    kept = {f"__keep{i}": c for i, c in enumerate(keep or []) if c not in ("doc_id", "size", "text_crc32", "shard", "slot")}
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    light = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("salt"),
                        *[F.col(f"`{c}`").alias(k) for k, c in kept.items()])
    order = ["doc_id", "size", "text_crc32", "salt"]
    ranged = light.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order) \
        .withColumn("part", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("part_bytes"),
                            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_rows"),
                            F.sum("bytes").over(all_parts).alias("total"))
    own = Window.partitionBy("part").orderBy(*order)
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.select("*", before.alias("before"), F.row_number().over(own).alias("row")) \
        .join(F.broadcast(offsets), "part") \
        .select("doc_id", "size", "text_crc32", *kept,
                F.expr(f"int((part_bytes + before) * {n} div total)").alias("shard"), (F.col("part_rows") + F.col("row") - 1).alias("pos"))
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))                 # one row per shard
    return placed.join(F.broadcast(first), "shard") \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("first")).cast("long").alias("slot"),
                *[F.col(k).alias(c) for k, c in kept.items()])


def place(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHARDS) -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot``.  Rows are told apart by their place (path and row) in the Parquet files they
    are read from; a table that is not read from files is written to the shared checkpoint folder first."""
    where = ["__file", "__at"]
    try:
        marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")], F.col("_metadata.file_path").alias(where[0]), F.col("_metadata.row_index").alias(where[1]))
    except AnalysisException:
        path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/sharding-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        return place(docs.sparkSession.read.parquet(path), doc_id, text, n)
    found = shards(marked, doc_id, text, n, keep=where).select(*where, "shard", "slot")
    return marked.join(found, where).drop(*where)
