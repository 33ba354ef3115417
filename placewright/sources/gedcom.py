"""GEDCOM lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.sources.scan import scan

# Fixed value: the form of a line, matched against the line with its newline.
LINE_FORM = r"^(\d+)\s+(@\S+@)?\s*(\S+)\s+(.*)"
# Unicode classes, and a dot that stops at LF only.
JAVA_FLAGS = "(?Ud)"
# Whatever follows the part of a line that the form covers.
REST = r"[\s\S]*"
UNPARSED_LEVEL = 99


def parse(lines: DataFrame) -> DataFrame:
    """Add level, label, tag and value to lines with a ``raw`` column.

    The label is null when the line has none; a line of no known form gets level 99 and empty parts.
    """
    # One pass of the pattern: its parts, which cannot hold a newline, are set apart by newlines.
    text = F.concat(F.rtrim("raw", F.lit("\r")), F.lit("\n"))
    parts = F.split(F.regexp_replace(text, JAVA_FLAGS + LINE_FORM + REST, "$1\n$2\n$3\n$4"), "\n")
    part = lambda n: F.get("_parts", F.lit(n))
    matched = F.size("_parts") == 4
    return lines.withColumn("_parts", parts).select(
        *lines.columns,
        F.coalesce(F.when(matched, part(0).try_cast("int")), F.lit(UNPARSED_LEVEL)).alias("level"),
        F.when(matched, F.when(part(1) != "", part(1))).otherwise("").alias("label"),
        F.when(matched, part(2)).otherwise("").alias("tag"),
        F.when(matched, F.rtrim(part(3), F.lit("\\"))).otherwise("").alias("value"),
    )


def read_gedcom(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec, pos, raw, level, label, tag, value), parsed while the lines are staged."""
    return scan(spark, paths, derive=parse)
