"""What happens to each place, and the counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import capwords

MATCHED = ("REPLACE", "DELETE", "UPDATE")
REVIEW = ("ERROR", "ASIS_REVIEW")


def disposition(repl_result: Column, skipped: Column, result: Column) -> Column:
    """Outcome of a place when nobody is asked: replacements first, then skips, then strong matches."""
    return (
        F.when(repl_result == "STRONG_MATCH", "REPLACE").when(repl_result == "DELETE", "DELETE")
        .when(repl_result == "ERROR", "ERROR").when(skipped, "ASIS_SKIP").when(result == "STRONG_MATCH", "UPDATE")
        .otherwise("ASIS_REVIEW")
    )


def review_action(result: Column, candidates: Column) -> Column:
    """Preferred next step of a reviewer: with several candidates, or none usable, verify."""
    return (
        F.when(candidates > 1, "verify").when(result.isin("MULTIPLE_MATCHES", "NO_MATCH", "NO_COUNTRY"), "verify")
        .when(result == "NOT_SUPPORTED", "skip").otherwise("save")
    )


def save_allowed(result: Column, candidates: Column) -> Column:
    """Null where the rules leave the switch as it was (unsupported country)."""
    return (
        F.when(candidates > 1, False).when(result.isin("MULTIPLE_MATCHES", "NO_MATCH", "NO_COUNTRY"), False)
        .when(result == "NOT_SUPPORTED", F.lit(None).cast("boolean")).otherwise(True)
    )


def run_stats(places: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, matched, skipped, review, remaining, total, percent_done) from dispositions and place counts per file."""
    d = F.col("disposition")
    done = places.groupBy("file").agg(
        F.count_if(d.isin(*MATCHED)).alias("matched"), F.count_if(d == "ASIS_SKIP").alias("skipped"),
        F.count_if(d.isin(*REVIEW)).alias("review"),
    )
    count = lambda c: F.coalesce(c, F.lit(0))
    finished = count("matched") + count("skipped") + count("review")
    return totals.select("file", F.col("places").alias("total")).join(done, "file", "left").select(
        "file", count("matched").alias("matched"), count("skipped").alias("skipped"), count("review").alias("review"),
        (F.col("total") - finished).alias("remaining"), "total",
        F.when(F.col("total") > 0, F.lit(100.0) * finished / F.col("total")).otherwise(0.0).alias("percent_done"),
    )


def diagnostics(places: DataFrame) -> DataFrame:
    """(input_text, output_text) of the places settled: title-cased key in, corrected text or DELETE out."""
    deleted = F.col("disposition") == "DELETE"
    return places.where(F.col("disposition").isin(*MATCHED)).select(
        capwords(F.col("key")).alias("input_text"), F.when(deleted, "DELETE").otherwise(F.col("text")).alias("output_text")
    )


def misses(places: DataFrame) -> DataFrame:
    """Places left for review, by key with how often each occurs."""
    return places.where(F.col("disposition").isin(*REVIEW)).groupBy("key").agg(F.count("*").alias("occurrences"))
