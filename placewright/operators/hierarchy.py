"""Places and the places that enclose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import hierarchy_key as hk
from placewright.functions.coordinates import unset_to_null
from placewright.functions.text import long_name, normalize
from placewright.operators.skew import salted_join
from placewright.workspace import stage

PARTS = ["prefix", "city", "admin2_id", "admin1_id", "country_iso"]

# What a tier is called in the output.
TIER_NAMES = ("Country", "State", "County", "City", "Place")

NODE_COLUMNS = [
    "tier", "key", "place_id", "title", "name", "lat", "lon", "feature", "admin1_id", "admin2_id", "iso", "enclosed_by",
    "type", "seq", "parent_tier", "parent_key", "above",
]
HIERARCHY_COLUMNS = NODE_COLUMNS[:14]


def _tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TIER_NAMES]), tier + 1)


def _has(part: str) -> Column:
    return F.coalesce(F.trim(part) != "", F.lit(False))


def _tiers_above(tier: Column) -> list[Column]:
    """For each tier, nearest first, its number where it lies above ``tier`` and the place has a part for it, else null.
    The country always counts."""
    return [F.when((tier > 3) & _has("city"), 3), F.when((tier > 2) & _has("admin2_id"), 2),
            F.when((tier > 1) & _has("admin1_id"), 1), F.when(tier > 0, 0)]


def nearest_above(tier: Column) -> Column:
    return F.coalesce(*_tiers_above(tier))


def _key_at(tier: Column) -> Column:
    return hk.key_at(tier, *[F.col(p) for p in PARTS])


def nodes(places: DataFrame) -> DataFrame:
    """One node per place with its key, id and the key of the nearest place above it.

    ``places``: seq, id, title, prefix, city, admin2_id, admin2_name, admin1_id, admin1_name, country_iso,
    country_name, feature, lat, lon, enclosed_by.
    """
    tier = F.col("tier")
    return (
        places.withColumn("tier", hk.tier(*[F.col(p) for p in PARTS[:4]]))
        .withColumn("key", _key_at(tier)).withColumn("parent_tier", nearest_above(tier))
        .select(
            "tier", "key", hk.place_id_or_key(F.col("id"), F.col("key")).alias("place_id"), "title",
            hk.name_at(tier, F.col("prefix"), F.col("city"), F.col("admin2_name"), F.col("admin1_name"), F.col("country_name")).alias("name"),
            unset_to_null(F.col("lat")).alias("lat"), unset_to_null(F.col("lon")).alias("lon"), "feature", "admin1_id", "admin2_id",
            F.col("country_iso").alias("iso"), F.when(tier > 0, F.col("enclosed_by")).otherwise("").alias("enclosed_by"),
            _tier_name(tier).alias("type"), "seq", "parent_tier", _key_at(F.col("parent_tier")).alias("parent_key"),
            F.lit(False).alias("above"),
        )
    )


def dedupe(nodes: DataFrame) -> DataFrame:
    """One node per (tier, key): the last that came with a file's own id, else the first made up.

    ``seq`` may be of any type that can be ordered; nodes ``above`` the places come after all places.

    A rank filter, which is applied within each task before the shuffle as well, so a key that most places share costs
    one row per task.
    """
    made_up, order = hk.is_synthetic(F.col("place_id")), F.struct("above", "seq")
    ranked = Window.partitionBy("tier", "key").orderBy(made_up, F.when(made_up, order).asc(), F.when(~made_up, order).desc())
    return nodes.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def ancestors(places: DataFrame) -> DataFrame:
    """Every place above any place, once: (tier, key, seq, feature, id parts, names, parent), first in ``seq`` order.

    All tiers above come from the place itself, so there is one pass and no iteration. Equal ancestors are folded by
    hashing on the map side before the first of each key is picked.
    """
    tier = hk.tier(*[F.col(p) for p in PARTS[:4]])
    carried = ["country_iso", "country_name", "admin1_id", "admin1_name", "admin2_id", "admin2_name", "city"]
    used_from = {"admin1_id": 1, "admin1_name": 1, "admin2_id": 2, "admin2_name": 2, "city": 3}
    lifted = (
        places.withColumn("from_tier", tier)
        .select("seq", "feature", *PARTS, "country_name", "admin1_name", "admin2_name", F.explode(F.array(*_tiers_above(F.col("from_tier")))).alias("tier"))
        .where("tier IS NOT NULL")
        .withColumn("key", _key_at(F.col("tier"))).withColumn("feature", hk.feature_when_moving_up(F.col("tier") + 1, F.col("feature")))
        .withColumn("parent_tier", nearest_above(F.col("tier"))).withColumn("parent_key", _key_at(F.col("parent_tier")))
        .withColumns({c: F.when(F.col("tier") >= k, F.col(c)).otherwise("") for c, k in used_from.items()})
    )
    told = ["feature", *carried, "parent_tier", "parent_key"]
    folded = lifted.groupBy("tier", "key", *told).agg(F.min("seq").alias("seq"))
    return folded.groupBy("tier", "key").agg(F.min(F.struct("seq", *told)).alias("first")).select("tier", "key", "first.*")


def ancestor_nodes(ancestors: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Nodes for ancestors, with name, feature and coordinates from the gazetteer where it has the key."""
    tier = F.col("tier")
    known = gazetteer.select(
        "tier", hk.key_at(tier, F.lit(""), F.col("norm"), F.col("admin2_id"), F.col("admin1_id"), F.col("country_iso")).alias("key"),
        F.struct("geoid", "lat", "lon", "feature", "name").alias("place"),
    ).groupBy("tier", "key").agg(F.min("place").alias("place"))
    name = hk.name_at(tier, F.lit(""), F.col("city"), F.col("admin2_name"), F.col("admin1_name"), F.col("country_name"))
    at = lambda least, part: F.when(tier >= least, F.col(part))
    title = long_name(*[F.coalesce(at(k, c), F.lit("")) for k, c in ((3, "city"), (2, "admin2_name"), (1, "admin1_name"), (0, "country_name"))])
    return ancestors.join(known, ["tier", "key"], "left").select(
        "tier", "key", F.col("key").alias("place_id"), title.alias("title"), name.alias("name"), "place.lat", "place.lon",
        F.coalesce("place.feature", "feature").alias("feature"),
        F.when(tier >= 1, F.col("admin1_id")).otherwise("").alias("admin1_id"), F.when(tier >= 2, F.col("admin2_id")).otherwise("").alias("admin2_id"),
        F.col("country_iso").alias("iso"), F.lit("").alias("enclosed_by"), _tier_name(tier).alias("type"),
        "seq", "parent_tier", "parent_key", F.lit(True).alias("above"),
    )


def enclose(nodes: DataFrame, **salting) -> DataFrame:
    """Set ``enclosed_by`` to the id of the node above; an id like P0001 that came with the file is kept.

    Most nodes share few parents, so the join is salted.
    """
    parents = nodes.select(F.col("tier").alias("parent_tier"), F.col("key").alias("parent_key"), F.col("place_id").alias("_parent"))
    kept = (F.col("tier") == 0) | F.rlike("enclosed_by", F.lit(r"^P\d\d\d\d"))
    return salted_join(nodes, parents, ["parent_tier", "parent_key"], spread=["key"], **salting).withColumn(
        "enclosed_by", F.when(kept, F.col("enclosed_by")).otherwise(F.coalesce("_parent", F.lit("")))
    ).select(*NODE_COLUMNS)


def build_hierarchy(places: DataFrame, gazetteer: DataFrame, **salting) -> DataFrame:
    """All places and everything above them, one row per (tier, key), each with the id of the place around it."""
    all_nodes = nodes(places).unionByName(ancestor_nodes(ancestors(places), gazetteer))
    return enclose(stage(dedupe(all_nodes), "nodes"), **salting).select(*HIERARCHY_COLUMNS)


def enclosure_violations(hierarchy: DataFrame) -> DataFrame:
    """Nodes whose key is not deeper than what encloses them; at level 0, nodes less deep than what encloses them."""
    own, around = hk.level(F.col("key")), hk.level(F.col("enclosed_by"))
    wrong = ((own <= around) & (own > 0)) | ((own < around) & (own == 0))
    return hierarchy.where((F.col("enclosed_by") != "") & wrong)
