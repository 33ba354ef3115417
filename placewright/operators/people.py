"""Names of the people behind record ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators.context import _set_by_line
from placewright.operators.running import carry_last
from placewright.operators.skew import salted_join
from placewright.workspace import stage

# Fixed value: pointers are followed this many steps beyond the first lookup.
POINTER_STEPS = 4


def person_names(lines: DataFrame, **running) -> DataFrame:
    """(file, id, name): the last NAME or HUSB value of each labelled record; a value equal to the id is no name."""
    tag = F.col("tag")
    needed = lines.where((F.col("level") == 0) | tag.isin("NAME", "HUSB"))
    named = carry_last(needed, {"id": _set_by_line()["record_id"]}, **running).where(tag.isin("NAME", "HUSB"))
    return (
        named.where((F.trim("id") != "") & (F.col("id") != F.col("value")))
        .groupBy("file", "id").agg(F.max_by("value", F.struct("rec", "pos")).alias("name"))
    )


def resolve_pointers(names: DataFrame, **salting) -> DataFrame:
    """Replace names that are pointers to other ids; null where a pointer leads to no entry.

    The steps run over the distinct pointers. After the first step many of them may have reached one id, and in the last join, back to
    the records, one pointer may be that of many; both are salted.
    """
    points = F.startswith("name", F.lit("@"))
    direct = names.where(~points)
    pending = names.where(points)
    entries = names.select("file", F.col("id").alias("_at"), F.col("name").alias("_next"))
    # A settled chain gets a key that is no id, so that settled rows do not pile up on a null key.
    settled = F.concat(F.lit("="), F.col("target"))
    chain = pending.select("file", F.col("name").alias("target")).distinct().withColumn("reached", F.col("target"))
    for _ in range(POINTER_STEPS):
        open_ = F.startswith("reached", F.lit("@"))
        placed = chain.withColumn("_at", F.when(open_, F.col("reached")).otherwise(settled))
        chain = stage(salted_join(placed, entries, ["file", "_at"], spread=["target"], **salting).select(
            "file", "target", F.when(open_, F.col("_next")).otherwise(F.col("reached")).alias("reached")), "pointers")
    followed = salted_join(
        pending.withColumnRenamed("name", "target"), chain, ["file", "target"], spread=["id"], **salting
    ).select("file", "id", F.col("reached").alias("name"))
    return direct.select("file", "id", "name").unionByName(followed)


def display_name(resolved, current):
    """Resolved name, else the name the line itself is under; slashes around surnames go."""
    return F.replace(F.coalesce(resolved, current), F.lit("/"), F.lit(""))


def with_person(places: DataFrame, names: DataFrame, spread: tuple[str, ...] = ("rec", "pos"), **salting) -> DataFrame:
    """Replace ``person`` of each place (file, record_id, person) by the name its record id leads to.

    Places are staged: the join counts them before it reads them, and working out their context is most of the work.
    """
    places = stage(places, "placed")
    table = resolve_pointers(names).select("file", F.col("id").alias("record_id"), F.col("name").alias("_name"))
    return salted_join(places, table, ["file", "record_id"], spread=list(spread), **salting).withColumn(
        "person", display_name(F.col("_name"), F.col("person"))
    ).drop("_name").select(*places.columns)
