"""Line reports (IO11): format per-column figures as text lines and parse them back.

Formats (fixed, as the reference writes them):
``Column {i}: Filled={filled}, Total={total}, Percentage={pct:.2f}%`` and
``Column {i}: Name='{name}', Type='{type}', Samples={samples}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILL_LINE = "Column %d: Filled=%d, Total=%d, Percentage=%.2f%%"
FILL_PATTERN = r"^Column (\d+): Filled=(\d+), Total=(\d+), Percentage=([0-9.]+)%$"
TYPE_PATTERN = r"^Column (\d+): Name='(.*)', Type='(.*)', Samples=(.*)$"


def format_fill_lines(rate: DataFrame) -> DataFrame:
    """``position, filled, total, percentage`` -> ``line`` (1-based column number)."""
    return rate.select((F.col("position") + 1).alias("column_no"),
                       F.format_string(FILL_LINE, F.col("position") + 1, F.col("filled"), F.col("total"),
                                       F.col("percentage")).alias("line"))


def parse_fill_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Parse fill lines; lines that do not match are dropped."""
    m = F.col(line_col).rlike(FILL_PATTERN)
    g = lambda i: F.regexp_extract(F.col(line_col), FILL_PATTERN, i)
    return lines.where(m).select(g(1).cast("int").alias("column_no"), g(2).cast("long").alias("filled"),
                                 g(3).cast("long").alias("total"), g(4).cast("double").alias("percentage"))


def format_type_lines(info: DataFrame) -> DataFrame:
    """``position, column, kind, samples`` -> type report ``line``."""
    return info.select(F.format_string("Column %d: Name='%s', Type='%s', Samples=%s", F.col("position") + 1,
                                       F.col("column"), F.col("kind"), F.col("samples")).alias("line"))


def parse_type_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    g = lambda i: F.regexp_extract(F.col(line_col), TYPE_PATTERN, i)
    return lines.where(F.col(line_col).rlike(TYPE_PATTERN)).select(
        g(1).cast("int").alias("column_no"), g(2).alias("name"), g(3).alias("type"), g(4).alias("samples"))


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
