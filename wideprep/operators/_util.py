"""Small shared helpers for operators (column quoting, one-row stacking, chunking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregates per ``agg`` call: keeps generated code under the JVM method limit
# for tables with hundreds or thousands of columns.  Columns are chunked and
# each chunk reads only its own Parquet columns.
AGG_CHUNK = 200


def q(name: str) -> str:
    """Quote a column name for ``F.col`` (dots, spaces, backticks)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def chunks(items: list, size: int = AGG_CHUNK):
    for i in range(0, len(items), size):
        yield items[i:i + size]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """SE1: concatenate results (per feature, train and test) by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stacked_agg(df: DataFrame, columns: list[str], per_column, extra=None, size: int = AGG_CHUNK) -> DataFrame:
    """One aggregation job per chunk of columns, returned in long form.

    ``per_column(name) -> list[Column]`` gives named aggregate expressions for
    one column; the result has one row per column with ``position`` (original
    order), ``column`` and those fields.  ``extra`` adds table-level
    aggregates (e.g. ``count(1)``) repeated on every row.
    """
    position = {c: i for i, c in enumerate(df.columns)}
    frames = []
    for part in chunks(columns, size):
        aggs = []
        for i, c in enumerate(part):
            aggs.append(F.struct(*per_column(c)).alias(f"_s{i}"))
        extras = extra() if extra else []
        row = df.agg(*aggs, *extras)
        items = [F.struct(F.lit(position.get(c, i)).cast("int").alias("position"),
                          F.lit(c).alias("column"),
                          F.col(f"_s{i}").alias("s"))
                 for i, c in enumerate(part)]
        keep = [c for c in row.columns if not c.startswith("_s")]
        exploded = row.select(F.explode(F.array(*items)).alias("_r"), *keep)
        frames.append(exploded.select("_r.position", "_r.column", "_r.s.*", *keep))
    return union_all(frames)


def unpivot(df: DataFrame, ids, values, variable: str, value: str) -> DataFrame:
    """``DataFrame.unpivot`` with quoted column references, so names holding
    dots or spaces stay whole (the variable column gets the plain name)."""
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], variable, value)
