"""Mixing sources to target weights by hash-threshold histograms.

Every row has a size (its words) and a hash of its id and text.  Sources, in code point order with
null last, take turns with the weights and share ``share`` of all sizes; no target exceeds ``most``
times its source's size, and what that leaves over goes to the others by weight.  A source whose target
is r times its size is taken floor(r) times whole, and once more where the hash lies below the source's
threshold.  Budgets are nested: a larger target only ever adds rows.

The threshold is found without sorting: sizes are summed by source and hash bucket, running sums over the
buckets name the one in which the budget ends, and only that bucket is histogrammed again, finer, until
it is a single hash value; the value is taken if that brings the sum nearer to the target.
Work is one grouped sum a level with a partial sum before the shuffle; a hot source only adds to sums.

A null text has size 0.  Rows that agree in id and text share their fate.  A null source is a source of its
own.  Extra columns pass through.  An empty table gives no rows.  One row per source reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideprep.session import checkpoint_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
#: Sources up to which their one-row-each table is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an md5 of id and text (expressible in any SQL)."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, none above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if level * weight[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else level * weight[i]
        if not full:
            break
        left -= sum(out[i] for i in sorted(full))
        open_ = [i for i in open_ if i not in full]
    return out


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``__source`` (a sortable, never null key), ``__size`` and ``__h``."""
    text_col, source_col = F.col(f"`{text}`"), F.col(f"`{source}`").cast("string")
    return docs.select(*[F.col(f"`{c}`") for c in keep or []],
                       F.coalesce(F.concat(F.lit("0"), source_col), F.lit("1")).alias("__source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
                       row_hash(F.col(f"`{doc_id}`"), text_col).alias("__h"))


def _with_sources(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    side = rows.sparkSession.createDataFrame(table, "__source string, " + schema)
    return rows.join(F.broadcast(side) if len(table) <= MAX_BROADCAST_SOURCES else side, "__source")


def plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> list[dict]:
    """For each source of ``sized`` rows: its size, target, whole copies, and the hash below which one
    copy more is taken."""
    totals = sorted(tuple(r) for r in rows.groupBy("__source").agg(F.sum("__size")).collect())
    out = []
    for (key, n), t in zip(totals, targets([n for _, n in totals], weights, share, most)):
        whole = min(int(t // n), int(most)) if n else 0
        out.append({"key": key, "size": n, "target": t, "whole": whole, "budget": t - whole * n,
                    "prefix": 0, "below": 0, "limit": 0})
    shift, open_ = HASH_BITS, [s for s in out if s["budget"] > 0]
    while open_:
        step = min(LEVEL_BITS, shift)
        inside = _with_sources(rows, [(s["key"], s["prefix"], float(s["budget"] - s["below"])) for s in open_], "prefix long, room double")
        bins = inside.where(F.shiftright("__h", shift) == F.col("prefix")) \
            .groupBy("__source", "room", F.shiftright("__h", shift - step).alias("bin")) \
            .agg(F.sum("__size").alias("n"), (F.min("__h") == F.max("__h")).alias("single"))
        run = Window.partitionBy("__source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        edge = bins.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))) \
            .where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("n") > F.col("room")))
        found = {r["__source"]: r for r in edge.collect()}
        still = []
        for s in open_:
            r = found.get(s["key"])
            if r is None:       # the budget holds all of the bucket (it can only miss by rounding)
                s["limit"] = (s["prefix"] + 1) << shift
                continue
            s["below"], s["prefix"] = s["below"] + r["before"], r["bin"]
            if r["single"] or shift == step:
                near = s["below"] + r["n"] - s["budget"] < s["budget"] - s["below"]
                s["limit"] = (r["bin"] + int(near)) << (shift - step)
            else:
                still.append(s)
        shift, open_ = shift - step, still
    return out


def _copies(rows: DataFrame, found: list[dict]) -> DataFrame:
    side = [(s["key"], s["size"], s["target"], s["whole"], s["limit"]) for s in found]
    out = _with_sources(rows, side, "source_size long, target double, __whole long, __limit long")
    return out.withColumn("copies", F.col("__whole") + (F.col("__h") < F.col("__limit")).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Id and ``size``, ``source_size``, ``target``, ``taken``, ``copies`` of every row: how often the mix
    takes it, and its words in all."""
    checkpoint_dir(docs.sparkSession)
    rows = sized(docs, doc_id, text, source, [doc_id]).checkpoint()
    return _copies(rows, plan(rows, weights, share, most)) \
        .select(F.col(f"`{doc_id}`"), F.col("__size").alias("size"), "source_size", "target",
                (F.col("__size") * F.col("copies")).alias("taken"), "copies")


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.  Texts are filtered in place, not shuffled."""
    checkpoint_dir(docs.sparkSession)
    found = plan(sized(docs, doc_id, text, source).checkpoint(), weights, share, most)
    whole = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"), F.col(f"`{source}`").alias("__src"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return _copies(sized(whole, "__id", "__text", "__src", ["__row"]), found).where("copies > 0") \
        .select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
