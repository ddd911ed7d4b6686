"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step groups by node
with a partial minimum before the shuffle and joins it back, so a node with very many edges is
combined early and its join can be split by adaptive execution.  Each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideprep.session import checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)`` of longs; the root is the smallest node."""
    checkpoint_dir(edges.sparkSession)
    now = edges.where("u != v").distinct().checkpoint()
    state = _state(now)
    while state[0]:
        now = _small_star(_large_star(now)).checkpoint()
        state, before = _state(now), state
        if state == before:
            break
    return now.select("u", "v").union(now.select("v", "v").distinct()).toDF("node", "root")
