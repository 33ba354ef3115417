"""The jobs end to end."""

import pytest
from pyspark.sql import functions as F

from placewright.operators import rewrite
from placewright.plans import jobs
from placewright.sources import gazetteer as gaz_source
from placewright.sources.gedcom import parse

GED = """0 HEAD
0 @I1@ INDI
1 NAME John /Smith/
1 BIRT
2 DATE 3 JAN 1850
2 PLAC Dover, , England, United Kingdom
3 MAP
4 LATI 1
4 LONG 2
2 SOUR x
1 DEAT
2 PLAC old church text
3 MAP
4 LATI 1
1 BURI
2 PLAC to be deleted
3 MAP
4 LONG 9
1 CENS
2 PLAC Mars\\
0 @F1@ FAM
1 HUSB @I1@
1 MARR
2 PLAC skip me please
1 RESI
2 PLAC lost place
1 EVEN
2 PLAC
0 TRLR
"""


@pytest.fixture(scope="module")
def run(spark, gazetteer, countries, tmp_path_factory):
    path = tmp_path_factory.mktemp("ged") / "a.ged"
    path.write_text(GED)
    repl = spark.createDataFrame([("OLD church, text".replace(",", ""), "@g5@st mary"), ("to be deleted", "@@"), ("lost place", "@zz@")], "key STRING, val STRING")
    skips = spark.createDataFrame([("Skip me please", " ")], "key STRING, val STRING")
    rules = spark.createDataFrame([(0, "United Kingdom", "UK")], "seq INT, orig STRING, repl STRING")
    tables = jobs.Tables(repl, skips, countries, rules=rules)
    return jobs.resolve_gedcom(spark, str(path), gazetteer, tables)


def test_corrected_lines(run):
    got = [r.text for r in run["lines"].orderBy("rec", "pos", "sub").collect()]
    want = GED.splitlines()
    want[5:9] = ["2 PLAC Dover, Kent, England, UK", "3 MAP", "4 LATI 51.13", "4 LONG 1.31"]
    i = want.index("2 PLAC old church text")
    want[i:i + 3] = ["2 PLAC St Mary,Dover, Kent, England, UK", "3 MAP", "4 LATI 51.13", "4 LONG 1.31"]
    i = want.index("2 PLAC to be deleted")
    del want[i:i + 3]
    want[want.index("2 PLAC Mars\\")] = "2 PLAC Mars"
    want[want.index("2 PLAC")] = "2 PLAC "
    assert got == want


def test_statistics_add_up(run):
    s = run["stats"].first()
    assert (s.matched, s.skipped, s.review, s.remaining, s.total, s.percent_done) == (3, 1, 3, 0, 7, 100.0)


def test_review_and_diagnostics(run):
    queue = {r.key: r for r in run["review"].collect()}
    assert set(queue) == {"mars", "lost place", ""}
    assert (queue["mars"].person, queue["mars"].event_name, queue["mars"].result) == ("John Smith", "Census", "NO_COUNTRY")
    assert queue["lost place"].person == "John Smith"
    assert {(r.input_text, r.output_text) for r in run["diagnostics"].collect()} == {
        ("Dover,,England,United Kingdom", "Dover, Kent, England, UK"), ("Old Church Text", "St Mary,Dover, Kent, England, UK"), ("To Be Deleted", "DELETE")
    }
    assert {r.key for r in run["misses"].collect()} == set(queue)


def test_decisions_empty_the_queue(spark, gazetteer, countries, run, tmp_path):
    (tmp_path / "a.ged").write_text(GED)
    ops = [(i, r.key, ("save", "skip", "delete")[i % 3], "g5", "") for i, r in enumerate(run["review"].where("key != ''").orderBy("key").collect())]
    decisions = spark.createDataFrame(ops, "seq LONG, key STRING, op STRING, geoid STRING, prefix STRING")
    empty = spark.createDataFrame([], "key STRING, val STRING")
    repl, skips = jobs.apply_decisions(empty, empty, decisions)
    again = jobs.resolve_gedcom(spark, str(tmp_path / "a.ged"), gazetteer, jobs.Tables(repl, skips, countries))
    decided = {r.key for r in decisions.collect()}
    assert not decided & {r.key for r in again["review"].collect()}


def test_no_block_without_coordinates(spark):
    raws = ["2 PLAC x", "3 MAP", "4 LATI 1", "4 LONG 2", "2 PLAC y", "3 MAP", "3 FOO", "4 LATI 1", "4 LATI 3", "2 PLAC z", "3 MAP", "4 LATI 1", "4 LONG 2", "4 LATI 9"]
    lines = parse(spark.createDataFrame([("f", 0, i, r) for i, r in enumerate(raws)], "file STRING, rec LONG, pos LONG, raw STRING"))
    nan = float("nan")
    edits = spark.createDataFrame([("f", 0, 0, "UPDATE", "X", nan, 1.0), ("f", 0, 4, "UPDATE", ", Y, ", 1.0, 2.0), ("f", 0, 9, "DELETE", None, None, None)],
                                  "file STRING, rec LONG, pos LONG, action STRING, text STRING, lat DOUBLE, lon DOUBLE")
    for numbered in (True, False):
        got = [r.text for r in rewrite.rewrite(lines, edits, numbered).orderBy("pos", "sub").collect()]
        assert got == ["2 PLAC X", "3 MAP", "4 LATI 1", "4 LONG 2", "2 PLAC Y", "3 MAP", "4 LATI 1.0", "4 LONG 2.0", "3 FOO", "4 LATI 1", "4 LATI 3", "4 LATI 9"]


XML = """<database><places>
<placeobj handle="_a" change="1" id="P0001" type="City"><ptitle>Dover, , England, United Kingdom</ptitle><pname value="Dover, , England, United Kingdom"/></placeobj>
<placeobj handle="_b" change="1" id="P0002" type="Unknown"><ptitle>Atlantis</ptitle><coord long="5.5" lat="4.5"/></placeobj>
<placeobj handle="_c" change="1" id="P0003" type="County"><ptitle>Marks Square,Dover,,England,United Kingdom</ptitle></placeobj>
</places></database>
"""


def test_gramps_job(spark, gazetteer, countries, tmp_path):
    (tmp_path / "a.gramps").write_text(XML)
    empty = spark.createDataFrame([], "key STRING, val STRING")
    out = jobs.resolve_gramps(spark, str(tmp_path / "a.gramps"), gazetteer, jobs.Tables(empty, empty, countries))
    places = {r.id: r for r in out["places"].collect()}
    # coordinates belong to their own place; a place that is not matched keeps its own
    assert (places["P0001"].new_text, places["P0001"].lat, places["P0001"].lon) == ("Dover, Kent, England, United Kingdom", 51.13, 1.31)
    assert (places["P0002"].new_text, places["P0002"].place_text, places["P0002"].lat, places["P0002"].lon) == (None, "Atlantis", 4.5, 5.5)
    tree = {r.key: (r.place_id, r.enclosed_by) for r in out["hierarchy"].collect()}
    assert tree == {
        "DOVER_G5_ENG_GB": ("P0001", "G5_ENG_GB"), "MARKS SQUARE_DOVER_G5_ENG_GB": ("P0003", "P0001"), "G5_ENG_GB": ("G5_ENG_GB", "ENG_GB"),
        "ENG_GB": ("ENG_GB", "GB"), "GB": ("GB", ""),
    }
    assert out["violations"].count() == 0
    assert out["stats"].first().total == 3


def test_gazetteer_build(spark, tmp_path):
    (tmp_path / "gb.txt").write_text('1\tDover "port"\t51.1\t1.3\tPPL\tGB\tENG\tG5\n2\tOld Hill\tx\t1.3\tHLL\tGB\tENG\tG5\n3\tParis\t48\t2\tPPL\tFR\t\t\n4\tUnited Kingdom\t54\t-2\tADM0\tGB\t\t\n')
    columns = {n: i for i, n in enumerate(("geoid", "name", "lat", "lon", "feature", "country_iso", "admin1_id", "admin2_id"))}
    raw = gaz_source.read_delimited(spark, str(tmp_path / "gb.txt"), columns)
    lists = lambda *k: spark.createDataFrame([(x,) for x in k], "key STRING")
    names = {
        "country": spark.createDataFrame([("gb", "United Kingdom")], "country_iso STRING, country_name STRING"),
        "admin1": spark.createDataFrame([("gb", "ENG", "England")], "country_iso STRING, admin1_id STRING, admin1_name STRING"),
        "admin2": spark.createDataFrame([("gb", "ENG", "G5", "Kent")], "country_iso STRING, admin1_id STRING, admin2_id STRING, admin2_name STRING"),
    }
    alternates = spark.createDataFrame([("1", "en", "Dubris"), ("1", "fr", "Douvres")], "geoid STRING, lang STRING, alt_name STRING")
    folder = jobs.build_gazetteer(raw, lists("GB "), lists("PPL"), str(tmp_path), names, alternates, lists())
    got = {(r.geoid, r.norm) for r in gaz_source.open_gazetteer(spark, folder, "gb").collect()}
    assert got == {("1", "dover port"), ("1", "dubris"), ("4", "united kingdom")}
    assert jobs.build_gazetteer(raw, lists("GB", "FR"), lists("PPL"), str(tmp_path), names) != folder
    row = gaz_source.open_gazetteer(spark, folder).where("norm = 'dubris'").first()
    assert (row.name, row.admin2_name, row.country_name, row.tier) == ('Dover "port"', "Kent", "United Kingdom", 3)
    jobs.build_spelling(gaz_source.open_gazetteer(spark, folder), str(tmp_path / "words"))
    assert {r.word: r.freq for r in spark.read.parquet(str(tmp_path / "words")).collect()}["dover"] == 1
