"""Scalar coercion functions.

All are plain Column expressions: they stay inside whole-stage codegen.
Spark 4 runs with ANSI on, so every parse goes through ``try_*`` forms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp text formats accepted by C3, tried in this order.
# ISO forms first, then the export format of the booking files (month/day/year
# with 24-hour clock, padded or not).
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
]

BOOKING_EXPORT_FORMAT = "M/d/yyyy H:mm"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text (or any type) to double; unparsable -> null."""
    return _try_cast(_c(c), "double")


def _try_cast(c: Column, type_name: str) -> Column:
    return c.try_cast(type_name)


def to_int_default(c, default: int = 0) -> Column:
    """To int, truncating toward zero; bad or null -> default.

    Goes through double first so that '9.5' becomes 9 (a direct string->int
    try_cast would give null).
    """
    return F.coalesce(_try_cast(_try_cast(_c(c), "double"), "int"), F.lit(default))


def to_timestamp_any(c, formats: list[str] | None = None) -> Column:
    """Text to timestamp over an explicit format list; bad -> null."""
    col = _c(c).cast("string")
    formats = formats or TIMESTAMP_FORMATS
    parse = lambda fmt: F.try_to_timestamp(col, F.lit(fmt))
    # A failed parse costs far more than one that works. What is left of a text
    # without its digits fits one format at most, so only that one is tried;
    # texts of another shape (signed or odd years, say) are tried with all.
    marks = F.translate(col, "0123456789", "")
    shapes: dict[str, list[str]] = {}
    for fmt in formats:
        shapes.setdefault(re.sub("[A-Za-z]", "", fmt.replace("'T'", "\0")).replace("\0", "T"), []).append(fmt)
    of_shape = F.when(col.isNull(), F.lit(None).cast("timestamp"))
    for shape, fmts in shapes.items():
        of_shape = of_shape.when(marks == shape, F.coalesce(*map(parse, fmts)))
    return of_shape.otherwise(F.coalesce(*map(parse, formats)))


def to_timestamp_export(c) -> Column:
    """C4: fixed-format parse of the booking export format."""
    return F.try_to_timestamp(_c(c).cast("string"), F.lit(BOOKING_EXPORT_FORMAT))


def to_day(c) -> Column:
    """Truncate a timestamp (or timestamp text) to its date."""
    return F.to_date(_c(c))


def finite_or_null(c) -> Column:
    """+-inf and NaN become null (NaN is not null in Spark)."""
    col = _c(c)
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def iso_date(c) -> Column:
    """Date as ISO text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def falsy_default(c, default) -> Column:
    """Python ``x or default`` for text (null and '' are falsy)."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default) if not isinstance(default, Column) else default)


def falsy_default_num(c, default) -> Column:
    """C23 for numbers: null and 0 are falsy."""
    col = _c(c)
    dflt = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col, F.lit(0)), dflt)


def to_bool(c) -> Column:
    """text/number truthiness as a proper boolean ('false' -> false)."""
    return _try_cast(_c(c).cast("string"), "boolean")


def pick(payload_map: Column, *keys: str, default=None) -> Column:
    """First non-null of several aliased keys of a map<string,string>,
    then a default."""
    values = [payload_map.getItem(k) for k in keys]
    if default is not None:
        values.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*values) if len(values) > 1 else values[0]
