"""Values carried down an ordered group of any size.

A plain window puts a whole group into one task. Here a group is cut by position into chunks of bounded size: windows
run inside the chunks, one small row per chunk says what it hands on, and a second window runs over those rows only.
The chunk is a function of the row's own position, so it comes out the same if a task is run again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_GROUP = ("file", "rec")
CHUNK = 1 << 17


def _chunk(order: str, size: int) -> Column:
    return F.expr(f"`{order}` div {size}L")


def carry_last(
    df: DataFrame, values: dict[str, Column], group=LINE_GROUP, order: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Add, per name, the last non-null value at or before each row of its group."""
    group = list(group)
    names = list(values)
    keyed = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()], _chunk(order, chunk).alias("_chunk"))

    so_far = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.select(
        *df.columns, "_chunk", *[F.last(f"_v_{n}", ignorenulls=True).over(so_far).alias(f"_l_{n}") for n in names]
    )

    handed_on = keyed.groupBy(*group, "_chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_h_{n}") for n in names]
    )
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed_on.select(
        *group, "_chunk", *[F.last(f"_h_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names]
    ).where(reduce(or_, [F.col(f"_c_{n}").isNotNull() for n in names]))

    return inside.join(carried, [*group, "_chunk"], "left").select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in names]
    )


def number_rows(
    df: DataFrame, name: str, group=LINE_GROUP, order: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Add a gap-free number, from 1, in the order of each group."""
    group = list(group)
    keyed = df.withColumn("_chunk", _chunk(order, chunk))
    inside = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(order)))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "_chunk").agg(F.count("*").alias("_rows"))
        .select(*group, "_chunk", F.sum("_rows").over(earlier).alias("_before")).where(F.col("_before") > 0)
    )
    return inside.join(offsets, [*group, "_chunk"], "left").select(
        *df.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)
    )
