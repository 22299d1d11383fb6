"""Output shaping shared by the driver queries.

Dates leave as ISO text (the reference's own answer format, C19) and doubles
are rounded to a fixed number of decimals, so that results compare equal
across engines whose summation order differs in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMALS = 4


def presentable(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), decimals)
        cols.append(c.alias(f.name))
    return df.select(*cols)
