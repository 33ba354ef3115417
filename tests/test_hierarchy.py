from pyspark.sql import functions as F

from placewright.operators import hierarchy
from placewright.sources.writers import HIERARCHY_COLUMNS, hierarchy_csv_rows, write_hierarchy_csv

SCHEMA = ("seq LONG, id STRING, title STRING, prefix STRING, city STRING, admin2_id STRING, admin2_name STRING, admin1_id STRING, "
          "admin1_name STRING, country_iso STRING, country_name STRING, feature STRING, lat DOUBLE, lon DOUBLE, enclosed_by STRING")


def place(seq, id_, prefix="", city="dover", a2="G5", lat=51.13, enclosed_by=""):
    return (seq, id_, f"{prefix}{city}, England", prefix, city, a2, "Kent" if a2 else "", "ENG", "England", "gb", "United Kingdom", "PPL", lat, 1.31, enclosed_by)


def build(spark, gazetteer, rows, **kw):
    return hierarchy.build_hierarchy(spark.createDataFrame(rows, SCHEMA), gazetteer, **kw)


def test_dedupe_precedence(spark):
    def kept(*ids):
        rows = [place(i, x) for i, x in enumerate(ids)]
        return hierarchy.dedupe(hierarchy.nodes(spark.createDataFrame(rows, SCHEMA))).first()

    assert kept("", "P0001").place_id == "P0001"
    assert kept("P0001", "").place_id == "P0001"
    assert kept("P0001", "P0002").place_id == "P0002"
    assert kept("", "").seq == 0


def test_every_place_is_enclosed(spark, gazetteer):
    rows = [place(0, "P0009", prefix="12 Privet Drive"), place(1, "", city="deal"), place(2, "P0011", city="hythe", a2=""), place(3, "", city="", a2="")]
    tree = {r.key: r for r in build(spark, gazetteer, rows, hot_rows=1).collect()}
    parent = {k: r.enclosed_by for k, r in tree.items()}
    assert parent == {
        "12 PRIVET DRIVE_DOVER_G5_ENG_GB": "DOVER_G5_ENG_GB", "DOVER_G5_ENG_GB": "G5_ENG_GB", "DEAL_G5_ENG_GB": "G5_ENG_GB",
        "HYTHE_ENG_GB": "ENG_GB", "G5_ENG_GB": "ENG_GB", "ENG_GB": "GB", "GB": "",
    }
    ids = {r.place_id for r in tree.values()}
    assert all(p in ids for p in parent.values() if p)
    made = tree["G5_ENG_GB"]
    assert (made.name, made.feature, made.lat, made.tier) == ("Kent", "ADM2", 51.2, 2)
    assert tree["DOVER_G5_ENG_GB"].lat == 51.13


def test_closure_is_idempotent(spark, gazetteer):
    rows = [place(0, "P0009", prefix="12 Privet Drive"), place(1, "", city="deal")]
    first = {r.key for r in build(spark, gazetteer, rows).collect()}
    more = rows + [place(9, "", city="dover"), place(10, "", city="")]
    assert {r.key for r in build(spark, gazetteer, more).collect()} == first


def test_own_enclosure_kept_and_checked(spark, gazetteer):
    rows = [place(0, "P0009", enclosed_by="P0001"), place(1, "P0010", city="deal", enclosed_by="P0001_A_B_C_D"), place(2, "P0012", city="hythe", enclosed_by="X_Y")]
    tree = build(spark, gazetteer, rows)
    got = {r.place_id: r.enclosed_by for r in tree.where("tier = 3").collect()}
    assert got == {"P0009": "P0001", "P0010": "P0001_A_B_C_D", "P0012": "G5_ENG_GB"}
    assert [r.place_id for r in hierarchy.enclosure_violations(tree).collect()] == ["P0010"]


def test_csv(spark, gazetteer, tmp_path):
    rows = [place(0, "P0009", prefix='the "old" mill'), place(1, "P0010", city="deal", lat=99.9), place(2, "P0013", city="hythe", lat=float("nan"))]
    tree = build(spark, gazetteer, rows)
    got = {r.Place: r for r in hierarchy_csv_rows(tree).collect()}
    assert (got["[P0009]"].Title, got["[P0009]"].latitude, got["[P0009]"].enclosed_by) == ('The "Old" Milldover, England', "51.1300", "[DOVER_G5_ENG_GB]")
    assert (got["[P0010]"].latitude, got["[P0010]"].longitude) == (" ", " ")
    assert (got["[P0013]"].latitude, got["[GB]"].enclosed_by) == (" ", "")
    write_hierarchy_csv(tree, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "csv"))
    assert back.columns == list(HIERARCHY_COLUMNS)
    assert sorted(r.Title for r in back.collect()) == sorted(r.Title for r in got.values())
