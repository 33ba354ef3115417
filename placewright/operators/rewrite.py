"""Corrected lines: unchanged ones pass through, places are rewritten, old coordinate blocks make way for new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.coordinates import known, plain
from placewright.functions.text import strip_ends
from placewright.operators.running import number_rows

COORDINATE_TAGS = ("LATI", "LONG")
BLOCK_TAGS = ("MAP", *COORDINATE_TAGS)


def line_text(level: Column, label: Column, tag: Column, value: Column) -> Column:
    """A line from its parts; a missing label leaves no gap."""
    return F.concat_ws(" ", level.cast("string"), label, tag, value)


def updated_line(level: Column, label: Column, tag: Column, value: Column) -> Column:
    return line_text(level, label, tag, strip_ends(value))


def coordinate_block(level: Column, lat: Column, lon: Column) -> Column:
    """Array of the three lines that follow an updated place, empty without coordinates."""
    block = F.array(
        F.concat_ws(" ", level + 1, F.lit("MAP")), F.concat_ws(" ", level + 2, F.lit("LATI"), plain(lat)),
        F.concat_ws(" ", level + 2, F.lit("LONG"), plain(lon)),
    )
    return F.when(known(lat, lon), block).otherwise(F.array().cast("array<string>"))


def old_block_sizes(lines: DataFrame, at: str = "line_no") -> DataFrame:
    """(file, rec, owner, size): how many coordinate lines directly follow the place at line ``owner``.

    A block is MAP right after the place, then at most two LATI or LONG lines without a gap. Each line names the line
    that would own it, so the run is found by grouping on line numbers, with no ordering and no large group.
    """
    tag = F.col("tag")
    claims = (
        F.when(tag == "PLAC", F.array(F.struct(F.lit(0).alias("back"), F.lit(0).alias("role"))))
        .when(tag == "MAP", F.array(F.struct(F.lit(1).alias("back"), F.lit(1).alias("role"))))
        .otherwise(F.array(F.struct(F.lit(2).alias("back"), F.lit(2).alias("role")),
                           F.struct(F.lit(3).alias("back"), F.lit(3).alias("role"))))
    )
    roles = lines.where(tag.isin("PLAC", *BLOCK_TAGS)).select("file", "rec", at, F.explode(claims).alias("claim")).select(
        "file", "rec", (F.col(at) - F.col("claim.back")).alias("owner"), F.col("claim.role").alias("role")
    )
    has = lambda role: F.max(F.col("role") == role)
    return (
        roles.groupBy("file", "rec", "owner").agg(*[has(r).alias(f"r{r}") for r in range(4)])
        .where("r0 and r1")
        .select("file", "rec", "owner", F.expr("1 + if(r2, 1 + if(r3, 1, 0), 0)").alias("size"))
    )


def old_block_lines(lines: DataFrame, touched: DataFrame, at: str = "line_no") -> DataFrame:
    """(file, rec, line number) of the coordinate lines to drop below ``touched`` places (file, rec, line number)."""
    return (
        old_block_sizes(lines, at).join(touched.select("file", "rec", F.col(at).alias("owner")), ["file", "rec", "owner"])
        .select("file", "rec", F.explode(F.expr("sequence(owner + 1, owner + size)")).alias(at))
    )


def rewrite(lines: DataFrame, edits: DataFrame, numbered: bool = False) -> DataFrame:
    """(file, rec, pos, sub, text): every line of the output.

    ``edits`` has one row per place line to change: (file, rec, pos, action, text, lat, lon) with action UPDATE or
    DELETE; places without an edit are rebuilt from their parts. Lines that are neither places nor coordinates are
    never joined or grouped: they only meet the rest again in the final sort. ``numbered`` says that ``pos`` has no
    gaps inside (file, rec).
    """
    at = "pos" if numbered else "line_no"
    if not numbered:
        lines = number_rows(lines, at)
    tag = F.col("tag")
    order = ["file", "rec", "pos"]

    untouched = lines.where(~tag.isin("PLAC", *BLOCK_TAGS)).select(*order, F.lit(0).alias("sub"), F.col("raw").alias("text"))

    place_lines = lines.where(tag == "PLAC").join(
        edits.select(*order, "action", F.col("text").alias("new_text"), "lat", "lon"), order, "left"
    )
    written = place_lines.where(F.coalesce("action", F.lit("")) != "DELETE")
    level, label, value = F.col("level"), F.col("label"), F.col("value")
    update = F.coalesce(F.col("action") == "UPDATE", F.lit(False))
    new_lines = written.select(*order, F.posexplode(F.when(
        update, F.concat(F.array(updated_line(level, label, tag, F.col("new_text"))),
                         coordinate_block(level, F.col("lat"), F.col("lon")))
    ).otherwise(F.array(line_text(level, label, tag, value)))).alias("sub", "text"))

    changed = place_lines.where((F.col("action") == "DELETE") | (update & known(F.col("lat"), F.col("lon"))))
    dropped = old_block_lines(lines, changed, at)
    kept_blocks = lines.where(tag.isin(*BLOCK_TAGS)).join(dropped, ["file", "rec", at], "left_anti").select(
        *order, F.lit(0).alias("sub"), F.col("raw").alias("text")
    )
    return untouched.unionByName(new_lines).unionByName(kept_blocks)
