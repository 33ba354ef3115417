"""Keys, tiers and names in the place hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.text import blank_to_null
from placewright.schemas import ADMIN1, ADMIN2, CITY, COUNTRY, PREFIX


def tier(prefix: Column, city: Column, admin2: Column, admin1: Column) -> Column:
    """Narrowest part present; a non-empty prefix always wins."""
    filled = lambda part: F.coalesce(F.trim(part) != "", F.lit(False))
    return (
        F.when(filled(prefix), PREFIX).when(filled(city), CITY).when(filled(admin2), ADMIN2)
        .when(filled(admin1), ADMIN1).otherwise(COUNTRY).cast("int")
    )


def key_at(at: Column, prefix: Column, city: Column, admin2: Column, admin1: Column, iso: Column) -> Column:
    """``PREFIX_CITY_ADMIN2_ADMIN1_ISO`` from tier ``at`` upwards, upper case, missing parts left out."""
    parts = [
        F.when(at >= PREFIX, F.trim(prefix)), F.when(at >= CITY, F.trim(city)), F.when(at >= ADMIN2, F.trim(admin2)),
        F.when(at >= ADMIN1, F.trim(admin1)), F.trim(iso),
    ]
    return F.upper(F.concat_ws("_", *[blank_to_null(p) for p in parts]))


def level(key: Column) -> Column:
    return F.regexp_count(key, F.lit("_"))


def name_at(at: Column, prefix: Column, city: Column, admin2: Column, admin1: Column, country: Column) -> Column:
    return (
        F.when(at == COUNTRY, country).when(at == ADMIN1, admin1).when(at == ADMIN2, admin2)
        .when(at == CITY, city).otherwise(prefix)
    )


def feature_when_moving_up(from_tier: Column, feature: Column) -> Column:
    """Feature code an enclosing place starts with, before a gazetteer match replaces it."""
    return (
        F.when(from_tier == COUNTRY, "ADM0").when(from_tier == ADMIN1, "ADM1").when(from_tier == ADMIN2, "ADM2")
        .otherwise(feature)
    )


def is_synthetic(place_id: Column) -> Column:
    """An id we made ourselves, as against one that came with the file."""
    return F.contains(place_id, F.lit("_")) | (F.length(place_id) < 4)


def place_id_or_key(place_id: Column, key: Column) -> Column:
    return F.coalesce(blank_to_null(place_id), key)
