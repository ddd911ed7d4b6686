"""Sources and sinks (IO1, IO3-IO10).

All reads and writes go through Spark's data sources, so paths may be any
file system the cluster mounts (HDFS, object stores).  Small metadata (name
lists, bundle descriptions) is written as one-line JSON text through Spark as
well, never with a driver-local ``open``.
"""

from __future__ import annotations

import csv
import io
import json
import logging

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wideprep.functions.text import normalize_text
from wideprep.operators._util import col

log = logging.getLogger(__name__)


# --------------------------------------------------------------------------- IO1 / IO3

def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files under ``path`` (a file, a directory or a glob), sorted by name;
    hidden and marker files (``_*``, ``.*``) are skipped.  Metadata only."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    for st in fs.globStatus(p) or []:
        items = fs.listStatus(st.getPath()) if st.isDirectory() else [st]
        for it in items:
            name = it.getPath().getName()
            if it.isFile() and not name.startswith(("_", ".")):
                out.append(it.getPath().toString())
    return sorted(out)


def _scan_lines(spark: SparkSession, paths) -> DataFrame:
    """Physical lines with the place of their split: ``_path``, ``_block`` (where it starts) and ``_id``, which rises line by line."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_id"), "value")


def _quotes(text="value") -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _placed(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``splits`` (a row per split, with its first id) and ``_offset``: the split's start plus the line's
    index in it.  A line holds a byte at least, so offsets grow with the place in the file and are unique in it.  The table of splits
    (400,000 rows for 100 TB in splits of 256 MB, some 60 MB) is broadcast, so no line is shuffled."""
    return lines.join(F.broadcast(splits), ["_path", "_block"]).withColumn("_offset", F.col("_block") + F.col("_id") - F.col("_first")) \
        .drop("_id", "_first")


def _single_lines(lines: DataFrame) -> DataFrame:
    """Records of one line each: ``_path``, ``_offset``, ``value``.  An unpaired quote raises."""
    line = F.when(_quotes() % 2 == 1, F.raise_error(F.lit("unpaired quote: read with multi_line=True"))).otherwise(F.col("value"))
    return _placed(lines, lines.groupBy("_path", "_block").agg(F.min("_id").alias("_first"))).select("_path", "_offset", line.alias("value"))


def _quote_splits(lines: DataFrame) -> DataFrame:
    """For each split its first id and whether it starts (``_inside``) and ends (``_open``) inside quotes: the parity of the quotes
    before it and with it, a running sum over a row per split.  A file with an odd number of quotes raises."""
    counts = lines.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.sum(_quotes()).alias("_n"))
    file = Window.partitionBy("_path")
    upto = F.sum("_n").over(file.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    paired = F.when(F.sum("_n").over(file) % 2 == 1, F.raise_error(F.concat(F.lit("unpaired quote in "), F.col("_path")))).otherwise(upto)
    return counts.withColumn("_upto", paired).select("_path", "_block", "_first", ((F.col("_upto") - F.col("_n")) % 2 == 1).alias("_inside"),
                                                     (F.col("_upto") % 2 == 1).alias("_open"))


def _joined(whole: bool):
    """Joins the lines of a scan, in file order, into records.  ``whole``: the records that lie inside one split.  Else the pieces of the
    others: lines that go on with a record of an earlier split (``_begins`` is false), and what a split leaves open."""
    names = ["_path", "_offset", "_begins", "value"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
        split, odd, held, at, begins = None, 0, [], 0, True

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            blocks, offsets = batch.column("_block").to_numpy(), batch.column("_offset").to_numpy()
            paths = batch.column("_path").dictionary_encode()
            counts = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
            file = paths.indices.to_numpy()
            edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (file[1:] != file[:-1])]).tolist()
            for lo, hi in zip(edges, [*edges[1:], len(blocks)]):
                here = (paths.dictionary[int(file[lo])].as_py(), int(blocks[lo]))
                if here != split:
                    if held and not whole:
                        rows.append((split[0], at, begins, "\n".join(held)))
                    split, odd, held, at = here, int(batch.column("_inside")[lo].as_py()), [], int(offsets[lo])
                    begins = not odd
                after = (odd + np.cumsum(counts[lo:hi])) % 2
                odd, first = int(after[-1]), 0
                lines = batch.column("value").slice(lo, hi - lo).to_pylist()
                for end in np.flatnonzero(after == 0).tolist():              # a record ends with each line that closes all quotes
                    record = lines[first] if not held and end == first else "\n".join([*held, *lines[first:end + 1]])
                    if begins == whole:
                        rows.append((here[0], at if held else int(offsets[lo + first]), begins, record))
                    held, begins, first = [], True, end + 1
                if first < len(lines):
                    at = at if held else int(offsets[lo + first])
                    held += lines[first:]
            yield made(rows)
        if held and not whole:
            yield made([(split[0], at, begins, "\n".join(held))])

    return run


def _quoted_lines(lines: DataFrame) -> DataFrame:
    """Records whose quoted cells may hold newlines: ``_path``, ``_offset``, ``value``.  Every split is parsed by itself once the parity of the
    quotes before it is known; only the pieces of records that cross the edge of a split, two a split at most, are shuffled."""
    placed = _placed(lines, _quote_splits(lines))
    schema = "_path string, _offset long, _begins boolean, value string"
    inner = placed.mapInArrow(_joined(True), schema)
    pieces = placed.where("_inside OR _open").mapInArrow(_joined(False), schema)
    record = F.last(F.when(F.col("_begins"), F.col("_offset")), ignorenulls=True) \
        .over(Window.partitionBy("_path").orderBy("_offset").rowsBetween(Window.unboundedPreceding, 0))
    crossing = pieces.withColumn("_record", record).groupBy("_path", "_record").agg(F.sort_array(F.collect_list(F.struct("_offset", "value"))).alias("p"))
    return inner.select("_path", "_offset", "value").unionByName(
        crossing.select("_path", F.col("_record").alias("_offset"), F.array_join("p.value", "\n").alias("value")))


def _n_cells(record: Column, sep: str) -> Column:
    """Cells of a record: separators outside quotes, and one."""
    plain = F.regexp_replace(record, '"[^"]*"', "")
    return ((F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit("")))) / len(sep)).cast("int") + 1


def read_multi_header(spark: SparkSession, path: str, n_header: int = 3, sep: str = ",",
                      typography: bool = True, header_in_every_file: bool = False, multi_line: bool = False, width: int | None = None):
    """IO1: delimited text whose first ``n_header`` records are header rows.

    ``path`` may be one file or several (a directory or glob, e.g. an export in
    parts): the header comes from the first file by path; the other files are
    all body unless ``header_in_every_file``.  Returns ``(header, body)``:
    ``header`` = ``col_idx, row_idx, cell`` (normalised), ``body`` = string
    columns ``_c0.._cN`` plus ``_file`` (the path) and ``_offset``, together the
    order key.  Fewer than ``n_header + 1`` records in the first file is an error.

    There are as many columns as the widest record has cells, which one pass over
    the text finds; columns beyond the header's have empty header cells.  With
    ``width`` given that pass is left out, and a record with more cells raises.

    Lines are read split by split and parsed on the JVM.  A line with an unpaired quote is
    an error; ``multi_line`` reads quoted newlines, also split by split: quotes in a file pair up, and a quote
    inside an unquoted cell is not supported."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"{path}: no files")
    records_of = lambda paths: (_quoted_lines if multi_line else _single_lines)(_scan_lines(spark, paths))
    head = records_of(files[0]).orderBy("_offset").limit(n_header + 1).collect()  # top-k of n_header + 1 rows
    if len(head) < n_header + 1:
        raise ValueError(f"{path}: need at least {n_header + 1} lines, found {len(head)}")
    records = records_of(files)
    rows = [next(csv.reader(io.StringIO(r["value"], newline=""), delimiter=sep), []) for r in head[:n_header]]
    wide = max([len(r) for r in rows] + [width or records.agg(F.max(_n_cells(F.col("value"), sep))).first()[0]])
    cells = [(i, r, (rows[r][i] if i < len(rows[r]) else "") or "") for r in range(n_header) for i in range(wide)]
    header = spark.createDataFrame(cells, "col_idx int, row_idx int, cell string") \
        .withColumn("cell", normalize_text("cell", typography))
    value = F.col("value")
    if width:
        said = F.concat(F.lit("a record has more cells than "), F.lit(str(wide)), F.lit(": "), F.substring(value, 1, 200))
        value = F.when(_n_cells(value, sep) > wide, F.raise_error(said)).otherwise(value)
    schema = ", ".join(f"_c{i} string" for i in range(wide))
    options = {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, wide + 1))}
    body = records.select("_path", "_offset", F.from_csv(value, schema, options).alias("r")).select("_path", "_offset", "r.*")
    if header_in_every_file:
        # the n-th offset of each file, one row per file (row_number() <= n is a partial per-task limit)
        w = Window.partitionBy("_path").orderBy("_offset")
        heads = body.select("_path", "_offset").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_header)
        cut = heads.groupBy("_path").agg(F.max("_offset").alias("_cut"))
        body = body.join(cut, "_path").where(F.col("_offset") > F.col("_cut")).drop("_cut")
    else:
        first = head[0]["_path"]
        body = body.where((F.col("_path") != first) | (F.col("_offset") > F.lit(head[n_header - 1]["_offset"])))
    return header, body.withColumnRenamed("_path", "_file")


def read_parquet_multi_header(spark: SparkSession, path: str, n_header: int = 3, header_in_every_file: bool = False):
    """IO1 for Parquet whose first rows are header rows: the hidden ``_metadata.row_index`` is the order key (per file).
    The header is read from the first file by path alone; other files are all body unless ``header_in_every_file``."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"{path}: empty")
    df = spark.read.parquet(path)
    data_cols = df.columns

    def placed(frame):
        return frame.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
                            *[col(c).cast("string").alias(c) for c in data_cols])

    head = placed(spark.read.parquet(files[0])).where(F.col("_row") < n_header).orderBy("_row").collect()
    if len(head) < n_header:
        raise ValueError(f"{path}: need at least {n_header} header rows")
    cells = [(i, r, head[r][c]) for r in range(n_header) for i, c in enumerate(data_cols)]
    header = spark.createDataFrame(cells, "col_idx int, row_idx int, cell string") \
        .withColumn("cell", normalize_text("cell"))
    late = F.col("_row") >= n_header
    body = placed(df).where(late if header_in_every_file else late | (F.col("_file") != head[0]["_file"]))
    return header, body


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """IO3: a plain table (one header row for CSV)."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", True))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def apply_names(body: DataFrame, names: list[str], keep=("_file", "_offset")) -> DataFrame:
    """Give body columns ``_c0.._cN`` their resolved names."""
    return body.select(*[col(k) for k in keep if k in body.columns],
                       *[col(f"_c{i}").alias(n) for i, n in enumerate(names)])


# --------------------------------------------------------------------------- IO4-IO6, IO10

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO4: CSV with a header line, UTF-8."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> bool:
    """IO5: Parquet; a failure is logged as a warning and returns False."""
    try:
        w = df.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return True
    except Exception as e:  # noqa: BLE001 - the reference treats this as a warning
        log.warning("parquet write to %s failed: %s", path, e)
        return False


def write_json_value(spark: SparkSession, value, path: str) -> None:
    """One JSON document as a single text file (small metadata only)."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_json_value(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def write_metadata(spark: SparkSession, names: list[str], header: DataFrame, path: str) -> None:
    """IO6: the final names (JSON list) and the normalised header rows (CSV)."""
    write_json_value(spark, names, f"{path}/columns_normalized")
    wide = header.groupBy("row_idx").pivot("col_idx").agg(F.first("cell")).orderBy("row_idx")
    write_csv(wide, f"{path}/header_rows")


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO10: a result table."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


# --------------------------------------------------------------------------- IO7-IO9

def save_bundle(spark: SparkSession, path: str, data: DataFrame, meta: dict, partition_by=None) -> None:
    """IO7/IO8: a data set plus a JSON description (target, feature lists,
    feature names); ``partition_by=['split']`` keeps train/test apart."""
    data.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{path}/data")
    write_json_value(spark, meta, f"{path}/meta")


def load_bundle(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/data"), read_json_value(spark, f"{path}/meta")


def save_model(model: PipelineModel, path: str) -> None:
    """IO9."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_with_header_rows(spark: SparkSession, header: DataFrame, data: DataFrame, path: str) -> None:
    """IM12: filled data written next to its untouched header rows (the header
    table as CSV of rows, the data as Parquet), so the original multi-row
    header can be restored by readers."""
    wide = header.groupBy("row_idx").pivot("col_idx").agg(F.first("cell")).orderBy("row_idx")
    write_csv(wide, f"{path}/header_rows")
    data.write.mode("overwrite").parquet(f"{path}/data")
