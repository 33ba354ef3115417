"""Entries of the replacement table: ``@geoid@prefix``, empty geoid meaning delete."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_entry(geoid: Column, prefix: Column) -> Column:
    return F.concat(F.lit("@"), geoid, F.lit("@"), prefix)


def entry_geoid(entry: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(entry, "@"), F.lit(2)), F.lit(""))


def entry_prefix(entry: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(entry, "@"), F.lit(3)), F.lit(""))
