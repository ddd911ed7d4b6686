"""Numeric scalar expressions (NUM1-NUM3) and type categories (PR14).

Spark keeps NULL and NaN apart while pandas unifies them; every numeric entry
point therefore maps NaN to NULL first (``nan_to_null``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number by ``to_number`` (the formats pandas' coercing
# parser accepts): optional surrounding blanks, sign, digits with an optional
# fraction or a bare fraction, optional exponent.  Spark's own cast would
# also accept '1.0d' / '2f', DuckDB's '1_0'; the guard rejects them.
NUMBER_PATTERN = r"^[ \t\n\r\f\x0B]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\x0B]*$"
INFINITY_PATTERN = r"^[ \t\n\r\f\x0B]*[+-]?(?i:inf|infinity)[ \t\n\r\f\x0B]*$"
_BLANKS = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"
INT_TOLERANCE = 1e-9

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c, dtype: T.DataType | None = None) -> Column:
    """NUM1: coerce to double, unparseable -> NULL (``to_numeric(errors='coerce')``).

    For columns already numeric pass ``dtype`` so no string round trip happens.
    """
    c = _col(c)
    if dtype is not None and isinstance(dtype, NUMERIC_TYPES):
        return nan_to_null(c.cast("double"))
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = c.cast("string")
    trimmed = F.regexp_replace(s, _BLANKS, "")
    return (F.when(s.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
            .when(s.rlike(INFINITY_PATTERN),
                  F.when(trimmed.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))


def is_integer_like(v) -> Column:
    """NUM2: finite and within 1e-9 of the nearest integer (``rint`` is half-even)."""
    v = _col(v)
    return (~F.isnan(v)) & (F.abs(v) != F.lit(float("inf"))) & (F.abs(v - F.rint(v)) <= F.lit(INT_TOLERANCE))


def decimal_places(v, dtype: T.DataType) -> Column:
    """NUM3: decimal places of a value as written in shortest plain notation.

    Integral types give 0.  For float/double it is the fraction length of the
    shortest round-trip text, read off Spark's own text (mantissa and exponent)
    without any limit; an integer-valued double is written ``3.0`` and counts 1.
    Non-numeric types give NULL.
    """
    v = _col(v)
    if isinstance(dtype, INTEGRAL_TYPES):
        return F.when(v.isNotNull(), F.lit(0))
    if isinstance(dtype, T.DecimalType):
        return F.when(v.isNotNull(), F.lit(max(dtype.scale, 0)))
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.lit(None).cast("int")
    d = v.cast("double")
    mantissa, exponent = _parts(d.cast("string"))
    fraction = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    return F.when(F.abs(d) < F.lit(float("inf")), F.greatest(F.lit(1), F.length(fraction) - exponent))


def _parts(text: Column) -> tuple[Column, Column]:
    """Mantissa and exponent of a double's text (``1.2E7`` or ``0.25``)."""
    return F.substring_index(text, "E", 1), F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).cast("int")).otherwise(0)


def float_text(v: Column) -> Column:
    """The shortest text of a double as Python and most databases write it: plain from 1e-4 to below 1e16
    (``12000000.0``, ``0.0001``), else with a two-digit exponent (``1.2e+16``, ``1e-05``)."""
    text, size = v.cast("string"), F.abs(v)
    mantissa, exponent = _parts(text)
    # 17 digits before and 21 after the point hold every double of the plain range exactly as its text says
    plain = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    sign = F.when(exponent < 0, "-").otherwise("+")
    digits = F.abs(exponent).cast("string")
    science = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    return F.when((size == 0) | ~(size < F.lit(float("inf"))), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(science)


def dtype_category(dtype: T.DataType) -> str:
    """PR14: ``numeric`` / ``boolean`` / ``datetime`` / ``string`` from the schema."""
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    return "string"


def dtype_categories(df) -> dict[str, str]:
    return {f.name: dtype_category(f.dataType) for f in df.schema.fields}
