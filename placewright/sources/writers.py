"""Files that leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.functions.coordinates import four_decimals, known
from placewright.functions.text import capwords
from placewright.sources.gramps import corrected_fragment

HIERARCHY_COLUMNS = ("Place", "Title", "Name", "Type", "latitude", "longitude", "enclosed_by")


def write_lines(lines: DataFrame, path: str) -> None:
    """Corrected lines: a folder per input file, holding parts that follow each other by name. Lines end in LF.

    Range partitioning makes each part a run of lines. The folder columns lead the sort, so the writer, which wants rows
    by folder, has no reason to sort again.
    """
    order = ["name", "source", "rec", "pos", "sub"]
    named = lines.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("name"), F.md5("file").alias("source"), "rec", "pos", "sub", "text")
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("name", "source", "text").write.partitionBy("name", "source").text(path)


def hierarchy_csv_rows(hierarchy: DataFrame) -> DataFrame:
    """The seven output columns, with tier and key to order by."""
    bracketed = lambda c: F.when(F.length(c) > 0, F.concat(F.lit("["), c, F.lit("]"))).otherwise("")
    placed = known(F.col("lat"), F.col("lon"))
    coordinate = lambda c: F.coalesce(four_decimals(F.when(placed, F.col(c))), F.lit(" "))
    return hierarchy.select(
        "tier", "key", F.concat(F.lit("["), "place_id", F.lit("]")).alias("Place"), capwords(F.col("title")).alias("Title"),
        capwords(F.col("name")).alias("Name"), F.col("type").alias("Type"), coordinate("lat").alias("latitude"),
        coordinate("lon").alias("longitude"), bracketed(F.coalesce("enclosed_by", F.lit(""))).alias("enclosed_by"),
    )


def write_hierarchy_csv(hierarchy: DataFrame, path: str) -> None:
    """Widest tier first, keys in order; a header line in each part."""
    rows = hierarchy_csv_rows(hierarchy).repartitionByRange("tier", "key").sortWithinPartitions("tier", "key")
    rows.select(*HIERARCHY_COLUMNS).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def gramps_rows(places: DataFrame) -> DataFrame:
    """(file, pos, text): place objects with ``new_text`` as title and first name; those where it is null are as they were."""
    return places.select("file", "pos", corrected_fragment(F.col("fragment"), F.col("new_text"), F.col("lat"), F.col("lon")).alias("text"))


def write_gramps(places: DataFrame, path: str) -> None:
    """Place objects in document order: a folder per input file, whose parts hold one object after the other."""
    order = ["name", "source", "pos"]
    rows = gramps_rows(places).select(F.regexp_extract("file", r"([^/]*)$", 1).alias("name"), F.md5("file").alias("source"), "pos", "text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("name", "source", "text").write.partitionBy("name", "source").text(path)


def write_documents(document: DataFrame, path: str) -> None:
    """Whole XML documents: a folder per input file, in which ``at=0`` holds all up to the last tag and ``at=1`` what follows it.

    The parts, ordered by their paths, are the document. What follows the last tag ends in LF, so a document that ends in a tag or in LF comes
    back byte for byte but for what was corrected.
    """
    order = ["name", "source", "pos"]
    named = document.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("name"), F.md5("file").alias("source"), "pos", "text", "is_tail")
    for at, rows, separator in ((0, named.where(~F.col("is_tail")), ">"), (1, named.where("is_tail").withColumn("text", F.regexp_replace("text", r"\n\z", "")), "\n")):
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.select("name", "source", F.lit(at).alias("at"), "text").write.mode("append").partitionBy("name", "source", "at").option("lineSep", separator).text(path)
