"""Plain result columns, so that two engines' answers compare by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Means of values with two decimals often end in a bare 5 at the seventh place,
# where the engines round to different sides.
TIE_NUDGE = 1e-9


def _plain(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        # The nudge decides exact ties; adding zero turns -0.0 into 0.0.
        col = F.round(col.cast("double") + F.lit(TIE_NUDGE), 6) + F.lit(0.0)
    elif isinstance(field.dataType, T.IntegralType):
        col = col.cast("long")
    elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        col = col.cast("string")
    return col.alias(field.name)


def present(df: DataFrame) -> DataFrame:
    return df.select(*[_plain(f) for f in df.schema.fields])


_SQL_PLAIN = {
    "f": f"ROUND(CAST({{c}} AS DOUBLE) + {TIE_NUDGE!r}, 6) + 0.0",
    "i": "CAST({c} AS BIGINT)",
    "t": "CAST({c} AS VARCHAR)",
    "s": "{c}",
}


def present_sql(ctes: str, body: str, columns: str) -> str:
    """The same shaping in SQL; ``columns`` reads ``name:kind|name:kind``."""
    shaped = []
    for part in columns.split("|"):
        name, kind = part.rsplit(":", 1)
        quoted = '"' + name + '"'
        shaped.append(f"{_SQL_PLAIN[kind].format(c=quoted)} AS {quoted}")
    prefix = f"WITH {ctes},\n" if ctes else "WITH "
    return f"{prefix}answer AS (\n{body}\n)\nSELECT {', '.join(shaped)} FROM answer"
