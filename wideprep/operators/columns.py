"""Column selection (PR8-PR12, PR14).

Decisions are made from one profiling job and applied as a ``select``; the
original column order is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wideprep.functions.numeric import NUMERIC_TYPES
from wideprep.operators import profile as P
from wideprep.operators._util import col


def split_xy(df: DataFrame, target: str, keep=()):
    """PR8: ``(X, y)``; ``keep`` columns (e.g. a row key) stay on both sides."""
    x = df.drop(target)
    y = df.select(*[col(k) for k in keep], col(target))
    return x, y


def keep_filled(df: DataFrame, threshold: float, columns=None) -> DataFrame:
    """PR10: keep columns whose fill percentage is strictly above ``threshold``."""
    rate = {r["column"]: r["percentage"] for r in P.fill_rate(df, columns, decimals=12).collect()}
    return df.select(*[col(c) for c in df.columns if c not in rate or rate[c] > threshold])


def drop_text_columns(df: DataFrame, columns=None) -> DataFrame:
    """PR9: drop columns where some non-missing cell is not a number."""
    kinds = {r["column"]: r["kind"] for r in P.numeric_ratio(df, columns).collect()}
    return df.select(*[col(c) for c in df.columns if kinds.get(c) != "text"])


def select_numeric(df: DataFrame, exclude=()) -> DataFrame:
    """PR11: numeric columns by type, minus ``exclude``."""
    ex = set(exclude)
    return df.select(*[col(f.name) for f in df.schema.fields
                       if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex])


def existing(df: DataFrame, names) -> list[str]:
    """PR12: the requested names which exist, in request order."""
    have = set(df.columns)
    return [n for n in names if n in have]
