"""Replacement, skip and other lookup tables: applying and maintaining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.replacement import build_entry, entry_geoid, entry_prefix
from placewright.functions.text import apply_rules, long_name, normalize
from placewright.operators.skew import salted_join
from placewright.schemas import CANDIDATE_FIELDS

SKIP_VALUE = " "
_PLACE_FIELDS = [f for f in CANDIDATE_FIELDS if f not in ("geoid", "first_year")]


def rekey(table: DataFrame, seq: str = "key") -> DataFrame:
    """(key, val) under normalised keys; of keys that become equal the last in ``seq`` order wins.

    A table without an order of its own goes by its old keys, so that the outcome never depends on how it was read.
    """
    return table.groupBy(normalize(F.col("key")).alias("key")).agg(F.max_by("val", seq).alias("val"))


def one_per_geoid(gazetteer: DataFrame) -> DataFrame:
    """The place behind each geoid, alternate names folded away."""
    return gazetteer.select("geoid", *_PLACE_FIELDS).dropDuplicates(["geoid"])


def resolve_replacements(table: DataFrame, gazetteer: DataFrame, **salting) -> DataFrame:
    """(key, prefix, geoid, found, place fields): each usable entry with the place it names.

    An empty value is no entry at all. Entries without a geoid mean delete; they get keys of their own in the join, so
    that a long delete list does not meet in one task.
    """
    entry = F.col("val")
    entries = table.where(entry != "").select(
        "key", entry_prefix(entry).alias("prefix"), entry_geoid(entry).alias("target")
    ).withColumn("geoid", F.when(F.col("target") == "", F.concat(F.lit("="), "key")).otherwise(F.col("target")))
    places = one_per_geoid(gazetteer).withColumn("_found", F.lit(True))
    return (
        salted_join(entries, places, ["geoid"], spread=["key"], **salting)
        .select("key", "prefix", F.col("target").alias("geoid"), F.coalesce("_found", F.lit(False)).alias("found"), *_PLACE_FIELDS)
    )


def replacement_result(geoid: Column, found: Column) -> Column:
    """Null without an entry, DELETE for an empty geoid, ERROR for one the gazetteer lost."""
    return (
        F.when(geoid.isNull(), None).when(geoid == "", "DELETE").when(found, "STRONG_MATCH").otherwise("ERROR")
    )


def apply_tables(keys: DataFrame, replacements: DataFrame, skips: DataFrame) -> DataFrame:
    """Add replacement columns (``repl_*``) and ``skipped`` to distinct keys.

    ``replacements`` comes from :func:`resolve_replacements`. Keys are unique on all sides, so no key can be hot.
    """
    named = replacements.select("key", *[F.col(c).alias(f"repl_{c}") for c in replacements.columns if c != "key"])
    marks = skips.select("key").distinct().withColumn("_skip", F.lit(True))
    return (
        keys.join(named, "key", "left").join(marks, "key", "left")
        .withColumn("repl_result", replacement_result(F.col("repl_geoid"), F.col("repl_found")))
        .withColumn("skipped", F.coalesce("_skip", F.lit(False)) & F.col("repl_result").isNull()).drop("_skip")
    )


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, val): ``table`` with ``changes`` (seq, key, val) folded in, the last one per key winning."""
    base = table.select(F.lit(None).cast("long").alias("seq"), "key", "val")
    both = base.unionByName(changes.select("seq", "key", "val"))
    return both.groupBy("key").agg(F.max_by("val", F.coalesce("seq", F.lit(-1))).alias("val"))


def upsert_replacements(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fold save, delete and prefix decisions (seq, key, op, geoid, prefix) into the replacement table.

    A save sets geoid and prefix, a delete empties both, a prefix edit keeps the geoid in force and counts only where
    the key has an entry. Aggregated per key with a map-side combine; decisions on one key never gather anywhere.
    """
    base = table.select(
        F.lit(-1).cast("long").alias("seq"), "key", F.lit("save").alias("op"), entry_geoid(F.col("val")).alias("geoid"),
        entry_prefix(F.col("val")).alias("prefix"),
    )
    edits = decisions.where(F.col("op").isin("save", "delete", "prefix")).select(
        "seq", normalize(F.col("key")).alias("key"), "op",
        F.when(F.col("op") == "delete", "").otherwise(F.col("geoid")).alias("geoid"),
        F.when(F.col("op") == "delete", "").otherwise(F.col("prefix")).alias("prefix"),
    )
    sets_geoid = F.col("op") != "prefix"
    folded = base.unionByName(edits).groupBy("key").agg(
        F.max_by("geoid", F.when(sets_geoid, F.col("seq"))).alias("geoid"), F.max_by("prefix", "seq").alias("prefix"),
        F.bool_or(sets_geoid).alias("exists"),
    )
    return folded.where("exists").select("key", build_entry(F.col("geoid"), F.col("prefix")).alias("val"))


def upsert_skips(table: DataFrame, decisions: DataFrame) -> DataFrame:
    added = decisions.where("op = 'skip'").select("seq", normalize(F.col("key")).alias("key"), F.lit(SKIP_VALUE).alias("val"))
    return upsert(table, added)


#: The lookup tables and how an added key is written: replacements, skips, feature codes, languages, output rules, countries by code.
KEY_FORMS = {
    "replacements": normalize, "skips": normalize, "features": lambda key: F.upper(F.trim(key)), "languages": F.lower, "rules": lambda key: key,
    "countries": lambda key: F.lower(F.trim(key)),
}


def added(table: str, additions: DataFrame) -> DataFrame:
    """(seq, key, val): what a person adds (seq, key, val) to a lookup table, in the form the table has; a null ``val`` takes the key away.

    Features and languages have no value. Blank keys are ignored, and so are language codes that aren't two letters. A country without a
    code is kept under its name with a blank value.
    """
    key, val = F.col("key"), F.col("val")
    if table == "countries":
        key, val = F.when(F.trim(key) == "", val).otherwise(key), F.when(F.trim(key) == "", F.lit(" ")).otherwise(F.lower(F.trim(val)))
    elif table in ("features", "languages"):
        val = F.when(val.isNotNull(), F.lit(""))
    out = additions.select(F.col("seq").cast("long").alias("seq"), KEY_FORMS[table](key).alias("key"), val.alias("val")).where("trim(key) != ''")
    return out.where(F.length("key") == 2) if table == "languages" else out


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key").distinct(), "key", "left_anti")


def replacement_listing(replacements: DataFrame, rules: Column | None = None) -> DataFrame:
    """(key, line): what each entry replaces its key with; deletes are left out. Order by key to show it."""
    city = F.when(F.col("tier") >= 3, F.col("name"))
    found = long_name(city, F.col("admin2_name"), F.col("admin1_name"), F.col("country_name"))
    name = F.when(F.col("found"), found).otherwise(F.concat(F.lit("Database error for GeoID "), "geoid"))
    if rules is not None:
        name = apply_rules(name, rules)
    lead = F.when(F.length("prefix") > 0, F.concat(F.lit("["), "prefix", F.lit("],"))).otherwise("")
    return replacements.where("geoid != ''").select("key", F.concat(lead, name).alias("line"))
