"""Cell values as text, the way a data frame prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "nan"


def number_text(x: Column) -> Column:
    """Shortest decimal form: plain from 1e-4 up to below 1e16, else with an exponent of two digits or more."""
    short = x.cast("double").cast("string")
    size = F.abs(x.cast("double"))
    digits = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), "\\.0$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    exponent = F.concat(mantissa, F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (
        F.when(F.isnan(x.cast("double")), MISSING)
        .when(short.contains("Infinity"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(size == 0, short)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def cell_text(c: str, kind: T.DataType) -> Column:
    value = F.col(c)
    if isinstance(kind, T.FractionalType):
        text = number_text(value)
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(MISSING))
