"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator, denominator) -> Column:
    """Division that gives NULL, never an error or NaN, when undefined."""
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def r6(column) -> Column:
    """Round to six places; the addition turns -0.0 into 0.0."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def valid_number(column: str) -> Column:
    value = F.col(column)
    return value.isNotNull() & ~F.isnan(value)


def half_even(column: Column, places: int) -> Column:
    """Round half to even on the scaled double, as NumPy's `round` does."""
    scale = F.lit(float(10**places))
    return F.rint(column * scale) / scale


def hash_unit(*parts) -> Column:
    """Deterministic uniform number in [0, 1) from 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def longer(wide: DataFrame, ids: list[str], name: str) -> DataFrame:
    """(ids, name, value) of a pivoted table, undefined cells left out."""
    rest = [F.col(f"`{c}`") for c in wide.columns if c not in ids]
    if not rest:
        return wide.select(*ids, F.lit("").alias(name), F.lit(0.0).alias("value")).limit(0)
    return wide.unpivot(ids, rest, name, "value").filter(F.col("value").isNotNull())
