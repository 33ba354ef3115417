"""Joins whose row side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.workspace import stage

HOT_ROWS = 200_000
SHARE = 4


def hot_keys(counts: DataFrame, on: list[str], count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(on, salts): the keys that hold too many rows for one task, and into how many parts each is cut; None without such keys.

    Too many are more than ``hot_rows`` and more than a quarter of an even partition's share of all rows. So there are at
    most four such keys for each shuffle partition, whatever the data, and no part is larger than that share. What comes to the driver is two
    numbers: the rows there are, and those of the most frequent key.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, top = counts.agg(F.sum(count), F.max(count)).first()
    most = max(hot_rows, -(-int(total or 0) // (SHARE * partitions)))
    if (top or 0) <= most:
        return None
    return stage(counts.where(F.col(count) > most).select(*on, F.ceil(F.col(count) / most).cast("int").alias("salts")), "hot-keys")


def salted_join(
    rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "left",
    counts: DataFrame | None = None, count: str = "n", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``table``, cutting each hot key of ``rows`` into as many parts as its rows need.

    ``spread`` names columns of ``rows`` that tell its rows apart. Only the table rows of hot keys are copied. ``counts``
    can hand in row counts per key that are known already; else they are counted with a map-side combine. The list of
    hot keys is broadcast: its size is bounded by the number of partitions. Without one this is a plain join.
    """
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias(count))
    found = hot_keys(counts, on, count, hot_rows)
    if found is None:
        return rows.join(table, on, how)
    hot = F.broadcast(found.withColumnRenamed("salts", "_salts"))
    left = rows.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    ).drop("_salts")
    right = table.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_salts") > 1, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0))))
    ).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


#: Pairs that one task of a join makes, or rows it reads, where a few rows of either side may make very many.
TASK_PAIRS = 100_000
MOST_TASKS = 20_000


def dealt_out(staged: DataFrame, on: list[str], task_rows: int = TASK_PAIRS // 5) -> DataFrame:
    """A staged table of small rows in as many tasks as its rows need, for work that makes many rows of each."""
    return staged.repartition(max(1, -(-staged.count() // task_rows)), *on)


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], table_spread: list[str], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Inner join that is dealt out by the pairs it makes, not by the bytes it reads, which tell nothing of them.

    ``spread`` and ``table_spread`` name columns that tell rows of either side apart. The key counts of both sides give the pairs of each
    key: their sum is the number of tasks, and a key of more than one task's pairs is cut, its larger side into parts, its smaller side
    copied to each. Both sides are read twice, so they should be staged. What comes to the driver is two numbers.
    """
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_rows")).join(table.groupBy(*on).agg(F.count("*").alias("_others")), on, "full")
    sizes = sizes.select(*on, F.coalesce("_rows", F.lit(0)).alias("_rows"), F.coalesce("_others", F.lit(0)).alias("_others"))
    pairs = F.col("_rows") * F.col("_others")
    work, top = sizes.agg(F.sum(F.greatest(pairs, F.col("_rows") + F.col("_others"))), F.max(pairs)).first()
    most = max(task_pairs, -(-int(work or 0) // MOST_TASKS))
    tasks = max(1, -(-int(work or 0) // most))
    if (top or 0) <= most:
        return rows.repartition(tasks, *on).join(table.repartition(tasks, *on), on)
    salts = F.ceil(pairs / most).cast("int")
    hot = stage(sizes.where(pairs > most).select(*on, salts.alias("_salts"), (F.col("_rows") >= F.col("_others")).alias("_cut_rows")), "hot-pairs")
    part = lambda columns: F.array(F.pmod(F.xxhash64(*columns), F.col("_salts")).cast("int"))
    every, only = F.sequence(F.lit(0), F.col("_salts") - 1), F.array(F.lit(0))

    def dealt(side: DataFrame, columns: list[str], cut: Column) -> DataFrame:
        salt = F.when(F.col("_salts").isNull(), only).when(cut, part(columns)).otherwise(every)
        return side.join(hot, on, "left").withColumn("_salt", F.explode(salt)).drop("_salts", "_cut_rows").repartition(tasks, *on, "_salt")

    return dealt(rows, spread, F.col("_cut_rows")).join(dealt(table, table_spread, ~F.col("_cut_rows")), [*on, "_salt"]).drop("_salt")
