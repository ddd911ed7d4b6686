"""Header rows and column names (IO2, PR1-PR7, AGG14).

A table whose first rows are header rows is split into a *header table*
``(col_idx, row_idx, cell)`` - #columns x #header-rows cells, a few hundred
values, so resolving names on it is metadata work - and the body.  Names are
chosen per column from the header rows, duplicates are disambiguated, the
target column is found by a normalised prefix, identifier columns dropped.
Operators that run on data-sized name columns (``dedupe_names``) use the
skew-safe running count of ``ordered.running_total``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideprep.functions.text import (match_key, normalize_text, py_id_match_key, py_match_key)
from wideprep.operators._util import col
from wideprep.operators.ordered import running_total
from wideprep.session import checkpoint_dir

log = logging.getLogger(__name__)

# Header cells that count as empty besides '' (option of PR2/PR3): pandas'
# placeholder for unnamed levels and textual missing markers.
PLACEHOLDER_PATTERN = r"^(Unnamed: ?\d+.*|nan|none)$"


def header_table(df: DataFrame, order_by: str, n_header: int = 3, typography: bool = True):
    """IO2: first ``n_header`` rows by ``order_by`` become header cells.

    Returns ``(header, body)``: ``header`` has ``col_idx, row_idx, cell``
    (normalised text) for every column except ``order_by``; ``body`` is the
    rest of the rows.  Fewer than ``n_header + 1`` rows is an error."""
    cols = [c for c in df.columns if c != order_by]
    head = df.orderBy(col(order_by)).limit(n_header + 1)  # top-k, never a full sort
    rows = head.collect()  # n_header + 1 rows: bounded
    if len(rows) < n_header + 1:
        raise ValueError(f"need at least {n_header + 1} rows (header rows plus one data row), got {len(rows)}")
    cutoff = rows[n_header - 1][order_by]
    spark = df.sparkSession
    cells = [(i, r, rows[r][c] if rows[r][c] is None else str(rows[r][c]))
             for i, c in enumerate(cols) for r in range(n_header)]
    header = spark.createDataFrame(cells, "col_idx int, row_idx int, cell string") \
        .withColumn("cell", normalize_text("cell", typography))
    body = df.where(col(order_by) > F.lit(cutoff))
    return header, body


def header_from_rows(df: DataFrame, order_by: str, n_header: int = 3) -> DataFrame:
    """Header table as a lazy DataFrame (no collect): ``col_idx, row_idx, cell``."""
    cols = [c for c in df.columns if c != order_by]
    head = df.orderBy(col(order_by)).limit(n_header)
    # a window over the n_header rows left by the top-k
    w = F.row_number().over(Window.orderBy(col(order_by))) - 1
    ranked = head.withColumn("row_idx", w.cast("int"))
    long = ranked.select("row_idx", *[col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cols)]) \
        .unpivot(["row_idx"], [f"_c{i}" for i in range(len(cols))], "_name", "cell")
    return long.select(F.substring("_name", 3, 10).cast("int").alias("col_idx"), "row_idx",
                       normalize_text("cell").alias("cell"))


def pick_names(header: DataFrame, priority=(2, 1, 0), placeholder_regex: str | None = None,
               default: str | None = None) -> DataFrame:
    """PR1-PR3: ``col_idx, name, used_row``: first non-empty cell in ``priority``
    order.  ``placeholder_regex`` makes placeholder cells count as empty;
    ``default`` names a column whose cells are all empty (``{idx}`` is
    replaced by the index), else its name is '' and ``used_row`` the first
    priority row."""
    cell = F.col("cell")
    empty = (cell.isNull()) | (cell == "")
    if placeholder_regex:
        empty = empty | cell.rlike("(?i)" + placeholder_regex)
    wide = header.groupBy("col_idx").agg(*[
        F.max(F.when((F.col("row_idx") == r) & ~empty, cell)).alias(f"h{r}") for r in priority])
    name = F.coalesce(*[F.col(f"h{r}") for r in priority])
    used = F.coalesce(*[F.when(F.col(f"h{r}").isNotNull(), F.lit(r)) for r in priority])
    if default is not None:
        dflt = F.replace(F.lit(default), F.lit("{idx}"), F.col("col_idx").cast("string"))
        name = F.coalesce(name, dflt)
    else:
        name = F.coalesce(name, F.lit(""))
    return wide.select("col_idx", name.alias("name"), F.coalesce(used, F.lit(priority[0])).alias("used_row"))


def flatten_levels(header: DataFrame, sep: str = "_", skip: str = "nan") -> DataFrame:
    """PR5: ``col_idx, name``: header levels joined by ``sep``, skipping ``skip`` cells."""
    levels = header.groupBy("col_idx").agg(F.sort_array(F.collect_list(F.struct("row_idx", "cell"))).alias("l"))
    kept = F.filter(F.transform("l", lambda x: x["cell"]), lambda c: c.isNotNull() & (c != skip))
    return levels.select("col_idx", F.array_join(kept, sep).alias("name"))


def dedupe_names(df: DataFrame, name_col: str, order_col: str, style: str = "_n",
                 n_buckets=None) -> DataFrame:
    """PR4: the first occurrence of a name (in ``order_col`` order) keeps it,
    later ones become ``name_2, name_3`` (``style='_n'``) or ``name_dup1, ...``
    (``'_dup'``).  A made name may equal a real one; rounds repeat until all
    names are unique (every made name is longer than the one it replaces, so real names
    that it can meet run out).  Output: input columns with ``name_col`` replaced."""
    cur = df
    while True:
        counted = running_total(cur.withColumn("_one", F.lit(1)), [name_col], order_col, "_one", "_earlier",
                                n_buckets).drop("_one")
        rank = F.col("_earlier") + 1
        suffix = F.concat(F.lit("_"), rank.cast("string")) if style == "_n" else \
            F.concat(F.lit("_dup"), (rank - 1).cast("string"))
        new = F.when(rank > 1, F.concat(col(name_col), suffix)).otherwise(col(name_col))
        cur = counted.withColumn(name_col, new).drop("_earlier")
        dup = cur.groupBy(name_col).count().where(F.col("count") > 1).limit(1).count()
        if dup == 0:
            return cur
        # another round is needed: cut the lineage (reliable checkpoint) first
        checkpoint_dir(df.sparkSession)
        cur = cur.checkpoint()


def duplicate_report(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Names occurring more than once: ``name, n``."""
    return names.groupBy(name_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def find_target(names: DataFrame, header: DataFrame, prefix: str, tie: str = "sorted") -> DataFrame:
    """PR6: one row ``col_idx, name, mode, matched`` for the column whose
    normalised name starts with ``prefix``; several matches -> first by sorted
    key (``tie='sorted'``) or by position (``'first'``), with a warning and all
    matches in ``matched``; none -> scan header rows 0, 1, 2 in order; none at
    all -> ``ValueError`` listing the names.  Names and header cells are
    metadata (#columns rows)."""
    key = py_match_key(prefix)
    spark = names.sparkSession
    order = [match_key("name"), F.col("col_idx")] if tie == "sorted" else [F.col("col_idx")]

    def answer(hits, mode):
        rows = hits.orderBy(*order).select("col_idx", "name").collect()
        if not rows:
            return None
        if len(rows) > 1:
            log.warning("%d columns start with %r; using %r", len(rows), prefix, rows[0]["name"])
        return spark.createDataFrame([(rows[0]["col_idx"], rows[0]["name"], mode, [r["col_idx"] for r in rows])],
                                     "col_idx int, name string, mode string, matched array<int>")

    found = answer(names.where(match_key("name").startswith(F.lit(key))), "derived")
    if found is not None:
        return found
    rows = sorted({r["row_idx"] for r in header.select("row_idx").distinct().collect()})
    for r in rows:
        cells = header.where((F.col("row_idx") == r) & match_key("cell").startswith(F.lit(key))).select("col_idx")
        found = answer(names.join(cells, "col_idx"), f"scanned_row_{r}")
        if found is not None:
            return found
    sample = [r["name"] for r in names.orderBy("col_idx").limit(50).collect()]
    raise ValueError(f"no column starts with {prefix!r}; names: {sample}")


def drop_identifier(df: DataFrame, ids, strict: bool = False) -> DataFrame:
    """PR7: drop the first column equal to each id by ``id_match_key`` (spaces
    ignored); ``strict=True`` compares ``match_key`` instead.  Ids not found
    are ignored."""
    keyf = py_match_key if strict else py_id_match_key
    drop = []
    for i in ids:
        k = keyf(i)
        for c in df.columns:
            if c not in drop and keyf(c) == k:
                drop.append(c)
                break
        else:
            log.info("identifier column %r not found", i)
    return df.drop(*drop)
