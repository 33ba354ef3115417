"""Gazetteers: delimited dumps in, one filtered Parquet table out."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.text import normalize
from placewright.operators.skew import salted_join
from placewright.schemas import ADMIN1, ADMIN2, CITY, COUNTRY, DEFAULT_FEATURES, DEFAULT_LANGUAGES, MIN_FEATURES


def read_delimited(spark: SparkSession, paths: str | list[str], columns: dict[str, int], sep: str = "\t") -> DataFrame:
    """Named string columns out of delimited files; ``columns`` maps a name to its position, from 0."""
    width = max(columns.values()) + 1
    schema = ", ".join(f"_c{i} STRING" for i in range(width))
    rows = spark.read.schema(schema).option("sep", sep).option("quote", "").option("encoding", "UTF-8").csv(paths)
    return rows.select(*[F.col(f"_c{i}").alias(name) for name, i in columns.items()])


def features_or_default(features: DataFrame) -> DataFrame:
    """The caller's feature codes, trimmed and upper case; the default list when there are fewer than three."""
    given = features.select(F.upper(F.trim("key")).alias("feature")).where("feature != ''").distinct()
    defaults = features.sparkSession.createDataFrame([(f,) for f in DEFAULT_FEATURES], "feature STRING")
    enough = given.agg(F.count("*")).scalar() >= MIN_FEATURES
    return given.where(enough).unionByName(defaults.where(~enough))


def languages_or_default(languages: DataFrame) -> DataFrame:
    """Two-letter language codes in lower case; the default when there are none."""
    given = languages.select(F.lower("key").alias("lang")).where(F.length("lang") == 2).distinct()
    defaults = languages.sparkSession.createDataFrame([(x,) for x in DEFAULT_LANGUAGES], "lang STRING")
    any_given = given.agg(F.count("*")).scalar() > 0
    return given.where(any_given).unionByName(defaults.where(~any_given))


def tier_of_feature(feature):
    return (
        F.when(feature == "ADM0", COUNTRY).when(feature == "ADM1", ADMIN1).when(feature == "ADM2", ADMIN2)
        .otherwise(CITY).cast("int")
    )


def allowed(gazetteer: DataFrame, countries: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of the listed countries and features; country rows stay, as the hierarchy needs them.

    Semi joins: the lists are short, so the adaptive planner broadcasts them once it has measured them.
    """
    wanted = countries.select(F.lower(F.trim("key")).alias("country_iso")).distinct()
    codes = features_or_default(features).unionByName(
        features.sparkSession.createDataFrame([("ADM0",)], "feature STRING")
    ).distinct()
    return gazetteer.join(wanted, "country_iso", "left_semi").join(codes, "feature", "left_semi").select(*gazetteer.columns)


def allowed_alternates(alternates: DataFrame, languages: DataFrame) -> DataFrame:
    """(geoid, alt_norm) of the listed languages."""
    return (
        alternates.join(languages_or_default(languages), "lang", "left_semi")
        .select("geoid", normalize(F.col("alt_name")).alias("alt_norm")).where("alt_norm != ''").distinct()
    )


def with_names(rows: DataFrame, countries: DataFrame, admin1: DataFrame, admin2: DataFrame, **salting) -> DataFrame:
    """Add country, admin1 and admin2 names by id: (country_iso, country_name), (country_iso, admin1_id, admin1_name),
    (country_iso, admin1_id, admin2_id, admin2_name). One area may hold much of the gazetteer, so the joins are salted."""
    ids = ["country_iso", "admin1_id", "admin2_id"]
    named = rows
    for depth, (table, name) in enumerate(((countries, "country_name"), (admin1, "admin1_name"), (admin2, "admin2_name")), 1):
        named = salted_join(named, table.select(*ids[:depth], name), ids[:depth], spread=["geoid"], **salting)
    return named


def with_alternates(gazetteer: DataFrame, alternates: DataFrame) -> DataFrame:
    """One row per (geoid, norm): the main names and the alternate ones."""
    extra = gazetteer.drop("norm").join(alternates.withColumnRenamed("alt_norm", "norm"), "geoid")
    return gazetteer.unionByName(extra).dropDuplicates(["geoid", "norm"])


def build_gazetteer(
    raw: DataFrame, countries: DataFrame, features: DataFrame, path: str, names: dict[str, DataFrame],
    alternates: DataFrame | None = None, languages: DataFrame | None = None,
) -> str:
    """Filter, name and write a gazetteer; returns its folder, which is named after the allow-lists.

    A change of a list gives another folder, so a stale table is never read. Files are laid out by country, which later
    reads prune on.
    """
    rows = raw.select(
        "geoid", "name", normalize(F.col("name")).alias("norm"), F.col("lat").try_cast("double").alias("lat"),
        F.col("lon").try_cast("double").alias("lon"), F.upper(F.trim("feature")).alias("feature"),
        F.lower(F.trim("country_iso")).alias("country_iso"), F.coalesce("admin1_id", F.lit("")).alias("admin1_id"),
        F.coalesce("admin2_id", F.lit("")).alias("admin2_id"),
    ).withColumn("tier", tier_of_feature(F.col("feature")))
    kept = with_names(allowed(rows, countries, features), names["country"], names["admin1"], names["admin2"])
    if alternates is not None:
        lists = languages if languages is not None else countries.where("false")
        kept = with_alternates(kept, allowed_alternates(alternates, lists))
    folder = f"{path}/gazetteer-{_fingerprint(countries, features, languages)}"
    kept.repartition("country_iso", F.pmod(F.xxhash64("geoid"), F.lit(64))).write.mode("overwrite").partitionBy("country_iso").parquet(folder)
    return folder


def _fingerprint(*lists: DataFrame | None) -> str:
    """Hash over the keys of the allow-lists: one number per list comes to the driver, not the list."""
    sums = [
        None if t is None else t.agg(F.count("*"), F.sum(F.xxhash64(F.upper(F.trim("key"))).cast("decimal(38,0)"))).first()
        for t in lists
    ]
    return hashlib.sha256(repr([tuple(s) if s else None for s in sums]).encode()).hexdigest()[:16]


def open_gazetteer(spark: SparkSession, folder: str, country: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if country is None else rows.where(F.col("country_iso") == country)
