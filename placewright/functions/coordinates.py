"""Latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stands for "no coordinate" in incoming places.
UNSET = 99.9


def known(lat: Column, lon: Column) -> Column:
    """True when both coordinates are real numbers."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def unset_to_null(value: Column) -> Column:
    return F.when((value != UNSET) & ~F.isnan(value), value)


def four_decimals(value: Column) -> Column:
    """Text with four decimals, null for null or NaN.

    The JVM formatter rounds the shortest decimal of a double half up; the files call for rounding its exact binary
    value, which differs in the last digit. Hence one Arrow-batched function, used only where rows leave for a file.
    """

    def render(batch):
        return batch.map(lambda v: None if v is None or v != v else "%.4f" % v).astype(object)

    import pandas as pd

    render.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(render, "string")(value)


def plain(value: Column) -> Column:
    """Shortest decimal text without an exponent."""
    short = value.cast("string")
    spelled_out = F.regexp_replace(value.cast("decimal(25,20)").cast("string"), r"0+$", "")
    return F.when(F.contains(short, F.lit("E")) & (F.abs(value) < 1), spelled_out).otherwise(short)
