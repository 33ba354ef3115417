"""Event dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the simple and ABT date forms that are understood; anything else has no year.
DATE_FORM = r"^\s*(ABT\s+)?([1-3]?[0-9]{1}\s+)?((JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+)?(\d{3,4})"


def event_year(date: Column) -> Column:
    """Year of a date, 0 when it has none we understand."""
    return F.coalesce(F.regexp_extract(date, DATE_FORM, 5).try_cast("int"), F.lit(0))


def is_about(date: Column) -> Column:
    return F.coalesce(F.regexp_extract(date, DATE_FORM, 1) != "", F.lit(False))
