import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def gazetteer(spark):
    """The hand gazetteer: ids follow from the expected keys, coordinates are invented."""
    from pyspark.sql import functions as F

    from placewright.functions.text import normalize
    from placewright.sources.gazetteer import tier_of_feature

    rows = [
        ("g1", "United Kingdom", "ADM0", "gb", "United Kingdom", "", "", "", "", 54.0, -2.0),
        ("g2", "England", "ADM1", "gb", "United Kingdom", "ENG", "England", "", "", 52.0, -1.0),
        ("g3", "Scotland", "ADM1", "gb", "United Kingdom", "SCT", "Scotland", "", "", 56.0, -4.0),
        ("g4", "Kent", "ADM2", "gb", "United Kingdom", "ENG", "England", "G5", "Kent", 51.2, 0.7),
        ("g5", "Dover", "PPL", "gb", "United Kingdom", "ENG", "England", "G5", "Kent", 51.13, 1.31),
        ("g6", "St. Andrews", "PPL", "ca", "Canada", "04", "New Brunswick", "1302", "Charlotte County", 45.07, -67.05),
        ("g7", "Canada", "ADM0", "ca", "Canada", "", "", "", "", 60.0, -95.0),
        ("g8", "New Brunswick", "ADM1", "ca", "Canada", "04", "New Brunswick", "", "", 46.5, -66.0),
        ("g9", "Charlotte County", "ADM2", "ca", "Canada", "04", "New Brunswick", "1302", "Charlotte County", 45.3, -67.0),
    ]
    names = ("geoid name feature country_iso country_name admin1_id admin1_name admin2_id admin2_name lat lon").split()
    frame = spark.createDataFrame(rows, " STRING, ".join(names[:9]) + " STRING, lat DOUBLE, lon DOUBLE")
    return frame.withColumn("norm", normalize(F.col("name"))).withColumn("tier", tier_of_feature(F.col("feature")))


@pytest.fixture(scope="session")
def countries(spark):
    return spark.createDataFrame([("united kingdom", True), ("canada", True), ("france", False)], "n_country STRING, supported BOOLEAN")
