"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import checked_broadcast, stage

#: Neighbours of a vertex, about, that one task's part takes.
PART = 4096


def with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): ``m`` is the smallest of u's neighbours v. A vertex of very many neighbours is cut into parts by its count."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    least = stage(least, "least-neighbours")
    hot = least.where(F.col("parts") > 1).select("u", "parts")
    dealt = edges.join(checked_broadcast(hot, hot.count()), "u", "left").select(
        "u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["u", "part"]).select("u", "v", "m")


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    mixed = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return mixed.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id in the links (a, b) that is not its component's smallest, which is ``root``.

    Every id hands its larger neighbours its smallest one, then its smaller neighbours; the links become stars in about as many
    rounds as the logarithm of a component's size. Each round is a written table. The end is reached when the links are stars
    and nothing else, which is looked at itself.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if are_stars(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        met = with_least(stage(large.where("u != v").distinct(), "large-star"))
        small = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), "small-star")
    raise RuntimeError("the components did not settle")
