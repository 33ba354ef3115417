"""Chunked windows and salted joins give what plain ones give, however a group is cut or spread."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.operators.running import carry_last, number_rows
from placewright.operators.skew import SHARE, hot_keys, salted_join, sized_join


def ordered(df):
    return sorted(tuple(r) for r in df.collect())


def lines(spark):
    pick = random.Random(3)
    rows = [("hot", 0, p, pick.choice([None, None, "x", "y"]), pick.choice([None, 1, 2])) for p in pick.sample(range(4000), 1500)]
    rows += [(f"f{i}", i % 3, p, pick.choice([None, "z"]), None) for i in range(40) for p in pick.sample(range(100), 9)]
    return spark.createDataFrame(rows, "file STRING, rec LONG, pos LONG, a STRING, b INT")


def test_carry_last_over_chunks(spark):
    df = lines(spark)
    w = Window.partitionBy("file", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.last("a", True).over(w).alias("x"), F.last("b", True).over(w).alias("y"))
    for chunk in (7, 64, 1 << 20):
        got = carry_last(df, {"x": F.col("a"), "y": F.col("b")}, chunk=chunk)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_number_rows_over_chunks(spark):
    df = lines(spark)
    w = Window.partitionBy("file", "rec").orderBy("pos")
    want = df.select("file", "rec", "pos", F.row_number().over(w).cast("long").alias("n"))
    for chunk in (5, 1 << 20):
        assert ordered(number_rows(df.select("file", "rec", "pos"), "n", chunk=chunk)) == ordered(want)


def test_salted_join_equals_join(spark):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    table = spark.range(45).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        got = salted_join(rows, table, ["k"], spread=["id"], how=how, hot_rows=100)
        assert ordered(got.select("k", "id", F.coalesce("v", F.lit(-1)))) == ordered(rows.join(table, "k", how).select("k", "id", F.coalesce("v", F.lit(-1))))


def test_hot_key_is_spread(spark):
    rows = spark.range(2000).select(F.lit(1).alias("k"), "id")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], hot_rows=100)
    assert [tuple(r) for r in hot.collect()] == [(1, 16)]  # four parts for each of four partitions
    assert hot_keys(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("n")), ["k"], hot_rows=100) is None
    joined = salted_join(rows, spark.createDataFrame([(1, "v")], "k INT, v STRING"), ["k"], spread=["id"], hot_rows=100)
    assert joined.where("v = 'v'").count() == 2000


def test_hot_list_is_bounded_by_partitions_and_leaves_none_out(spark):
    most = SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 9, 10_000 + F.col("id")).otherwise(10).alias("n"))
    hot = {r.k: r.salts for r in hot_keys(counts, ["k"], hot_rows=0).collect()}
    assert set(hot) == set(range(9)) and len(hot) <= most
    total = sum(10_000 + k for k in range(9)) + 991 * 10
    assert all((10_000 + k) / salts <= total / most + 1 for k, salts in hot.items())


def test_joins_that_make_many_pairs_of_few_rows_are_dealt_out(spark):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [("b", i) for i in range(5)] + [("c", 0), (None, 1)], "k STRING, i INT")
    table = spark.createDataFrame([("a", j) for j in range(40)] + [("b", j) for j in range(900)] + [("d", 0), (None, 2)], "k STRING, j INT")
    for limit in (500, 1 << 20):
        joined = sized_join(rows, table, ["k"], ["i"], ["j"], limit)
        assert ordered(joined.select("k", "i", "j")) == ordered(rows.join(table, "k").select("k", "i", "j"))
    tasks = sized_join(rows, table, ["k"], ["i"], ["j"], 500).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 12 and max(r.n for r in tasks) < 5 * 500
