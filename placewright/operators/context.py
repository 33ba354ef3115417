"""Which person, event and date a line belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.dates import event_year, is_about
from placewright.operators.running import carry_last
from placewright.schemas import EVENT_NAMES


def event_name_of_tag(tag: Column) -> Column:
    """Readable name of a place-bearing event tag, null for other tags."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    return F.try_element_at(names, tag)


def _set_by_line() -> dict[str, Column]:
    """What each line sets for itself and the lines below it; null where it leaves a value alone."""
    level, tag, label, value = (F.col(c) for c in ("level", "tag", "label", "value"))
    owner = tag.isin("INDI", "FAM") & label.isNotNull()
    return {
        "record_id": F.when(level == 0, F.when(owner, label).otherwise(" ")),
        "person": F.when(level == 0, F.when(owner, label).otherwise("")).when(
            (level == 1) & tag.isin("NAME", "HUSB"), value
        ),
        "event_name": F.when(level == 0, F.when(owner, tag).otherwise(""))
        .when((level == 1) & event_name_of_tag(tag).isNotNull(), event_name_of_tag(tag))
        .when(level.isin(1, 2) & (tag == "TYPE"), value)
        .when((level == 1) & ~tag.isin("DATE", "PLAC"), tag),
        "date": F.when(level.isin(0, 1), "").when((level == 2) & (tag == "DATE"), value),
    }


def with_context(lines: DataFrame, **running) -> DataFrame:
    """Add record_id, person, event_name, date, event_year and about to every line.

    A date counts only from its own line downwards and ends at the next level-1 line.
    """
    carried = carry_last(lines, _set_by_line(), **running)
    filled = {c: F.coalesce(c, F.lit("")) for c in ("record_id", "person", "event_name", "date")}
    return carried.withColumns(filled).withColumns({"event_year": event_year(F.col("date")), "about": is_about(F.col("date"))})


def places(lines: DataFrame, **running) -> DataFrame:
    """Place lines with their context.

    Only lines that can set context, and the places themselves, are shuffled.
    """
    level, tag = F.col("level"), F.col("tag")
    needed = lines.where(level.isin(0, 1) | (tag == "PLAC") | ((level == 2) & tag.isin("DATE", "TYPE"))).select(
        "file", "rec", "pos", "level", "label", "tag", "value"
    )
    return with_context(needed, **running).where(tag == "PLAC").select(
        "file", "rec", "pos", "level", "label", "record_id", "person", "event_name", "date", "event_year", "about",
        F.col("value").alias("place_text"),
    )


def place_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count_if(F.col("tag") == "PLAC").alias("places"))
