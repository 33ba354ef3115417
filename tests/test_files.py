"""Readers and writers on real files."""

import gzip
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from placewright.operators import context, rewrite
from placewright.sources import gedcom, gramps, tables, writers
from placewright.sources import scan as scanning
from placewright.sources.scan import scan

RECORDS = "0 HEAD\n1 CHAR UTF-8\n" + "".join(
    f"0 @I{i}@ INDI\n1 NAME Person{i} /Smith/\n1 BIRT\n2 DATE {1 + i % 28} JAN {1800 + i % 100}\n2 PLAC Dover{i}, Kent\n3 MAP\n4 LATI 1.5\n1 NOTE café {i}\n"
    for i in range(300)
) + "0 TRLR\n"


def text_of(lines):
    return [r.raw for r in lines.orderBy("file", "rec", "pos").collect()]


@pytest.fixture
def small_splits(spark):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "900")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def test_scan_numbers_rows_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.ged").write_text(RECORDS)
    (tmp_path / "b.ged").write_text("0 HEAD\n0 TRLR\n")
    lines = scan(spark, str(tmp_path))
    a = lines.where(F.endswith("file", F.lit("a.ged")))
    assert text_of(a) == RECORDS.splitlines()
    assert sorted(r.pos for r in a.collect()) == list(range(len(RECORDS.splitlines())))
    assert lines.where(F.endswith("file", F.lit("b.ged"))).count() == 2


@pytest.mark.parametrize("newline", ["\r\n", "\r"])
def test_line_ends(spark, tmp_path, newline, small_splits):
    (tmp_path / "a.ged").write_bytes(RECORDS.replace("\n", newline).encode())
    assert text_of(scan(spark, str(tmp_path / "a.ged"))) == RECORDS.splitlines()


def test_many_misnamed_gzip_files_beside_plain_ones(spark, tmp_path):
    """Paths with spaces and accents, files of several members, an empty one; plain files stay as they are."""
    for i in range(500):
        (tmp_path / f"né {i}%.ged").write_bytes(gzip.compress(f"0 HEAD\r\n1 NOTE {i}\r".encode()) + gzip.compress(b"0 TRLR"))
    (tmp_path / "none.ged").write_bytes(gzip.compress(b""))
    (tmp_path / "plain.ged").write_text("0 HEAD\n1 NOTE plain\n0 TRLR\n")
    lines = scan(spark, str(tmp_path)).select("file", "pos", "raw").collect()
    found = {}
    for r in sorted(lines, key=lambda r: (r.file, r.pos)):
        found.setdefault(r.file, []).append((r.pos, r.raw))
    assert len(found) == 501
    assert sorted(tuple(raw for _, raw in v) for v in found.values()) == sorted(("0 HEAD", f"1 NOTE {i}", "0 TRLR") for i in [*range(500), "plain"])
    assert all([at for at, _ in v] == [0, 1, 2] for v in found.values())


def test_gzip_is_read_in_batches_of_bounded_size(tmp_path):
    (tmp_path / "a.ged").write_bytes(gzip.compress(b"\n".join(b"x" * 1000 for _ in range(30_000)) + b"\n" + b"y" * 9_000_000))
    sizes = [(len(held), sum(map(len, held))) for held in scanning._batches(scanning._lines(f"file://{tmp_path}/a.ged", None))]
    assert sum(n for n, _ in sizes) == 30_001 and sum(size for _, size in sizes) == 39_000_000
    assert max(size for _, size in sizes) < (1 << 23) + 9_000_000 and len(sizes) == 4
    assert [len(held) for held in scanning._batches(iter("abcdefg"), rows=3)] == [3, 3, 1] and list(scanning._batches(iter([]))) == []


def test_scan_brings_no_rows_to_the_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ged").write_bytes(gzip.compress(RECORDS.encode()))
    for name in ("collect", "toPandas", "first", "count", "isEmpty", "toLocalIterator"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda *_: pytest.fail("an action"))
    lines = scan(spark, str(tmp_path))
    monkeypatch.undo()
    assert text_of(lines) == RECORDS.splitlines()


def test_gzip_with_and_without_suffix(spark, tmp_path):
    for name in ("a.ged.gz", "b.ged"):
        (tmp_path / name).write_bytes(gzip.compress(RECORDS.encode()))
    (tmp_path / "c.ged").write_text(RECORDS)
    lines = scan(spark, str(tmp_path))
    for name in ("a.ged.gz", "b.ged", "c.ged"):
        assert text_of(lines.where(F.endswith("file", F.lit(name)))) == RECORDS.splitlines(), name


def test_bad_bytes_and_missing_file(spark, tmp_path):
    (tmp_path / "a.ged").write_bytes(b"1 NAME Jos\xe9 X\n1 NOTE \xff\n")
    assert text_of(scan(spark, str(tmp_path / "a.ged"))) == ["1 NAME Jos� X", "1 NOTE �"]
    with pytest.raises(AnalysisException):
        scan(spark, str(tmp_path / "none.ged"))


def test_round_trip_byte_for_byte(spark, tmp_path, small_splits):
    source = RECORDS.replace("1 CHAR UTF-8\n", "1 CHAR UTF-8\n\n   odd line\n1\tTABBED x\n")
    (tmp_path / "a.ged").write_text(source)
    lines = gedcom.read_gedcom(spark, str(tmp_path / "a.ged"))
    edits = spark.createDataFrame([], "file STRING, rec LONG, pos LONG, action STRING, text STRING, lat DOUBLE, lon DOUBLE")
    writers.write_lines(rewrite.rewrite(lines, edits, numbered=True), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("name=a.ged/source=*/part-*"))
    assert "".join(p.read_text() for p in parts) == source


def test_context_of_places(spark, tmp_path, small_splits):
    (tmp_path / "a.ged").write_text(RECORDS)
    got = context.places(gedcom.read_gedcom(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.record_id, r.person, r.event_name, r.event_year, r.place_text) for r in got] == [
        (f"@I{i}@", f"Person{i} /Smith/", "Birth", 1800 + i % 100, f"Dover{i}, Kent") for i in range(300)
    ]


XML = """<?xml version="1.0" encoding="UTF-8"?>
<database xmlns="http://gramps-project.org/xml/1.7.1/">
  <people><person id="I1"><name>a &gt; b</name></person></people>
  <places>
    <placeobj handle="_a" change="1" id="P0001" type="City">
      <ptitle>Dover, Kent, England, United Kingdom</ptitle>
      <pname value="Dover"/>
      <coord long="1.5" lat="2"/>
      <placeref hlink="_b"/><placeref hlink="_c"/>
    </placeobj><placeobj handle="_b" change="2" id="P0002" type="County"><ptitle>Kent &amp; more, England</ptitle></placeobj>
    <placeobj handle="_c" change="3" id="P0003" type="Unknown"><pname value="St. A > b"/><pname value="second"/></placeobj>
    <placeobj handle="_d" change="3" id="P0004"/>
    <placeobj
       handle="_e" change="4" id="P0005" type="City"><pname value="x"/><ptitle>Title last</ptitle></placeobj>
  </places>
  <objects/>
</database>
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_gramps_places(spark, tmp_path, zipped, small_splits):
    (tmp_path / "a.gramps").write_bytes(gzip.compress(XML.encode()) if zipped else XML.encode())
    got = {r.id: r for r in gramps.read_gramps(spark, str(tmp_path / "a.gramps")).collect()}
    assert {k: r.place_text for k, r in got.items()} == {
        "P0001": "Dover", "P0002": "Kent & more, England", "P0003": "St. A > b", "P0004": None, "P0005": "Title last"
    }
    first = got["P0001"]
    assert (first.lat, first.lon, first.had_coord, first.placerefs, first.handle) == (2.0, 1.5, True, ["_b", "_c"], "_a")
    assert got["P0002"].had_coord is False


def test_gramps_written_and_read_back(spark, tmp_path):
    (tmp_path / "a.gramps").write_text(XML)
    places = gramps.read_gramps(spark, str(tmp_path / "a.gramps")).withColumn("new_text", F.concat(F.lit("New "), "place_text"))
    writers.write_gramps(places, str(tmp_path / "out"))
    back = {r.id: r for r in gramps.read_gramps(spark, str(tmp_path / "out" / "*" / "*" / "part-*")).collect()}
    assert back["P0001"].place_text == "New Dover" and back["P0001"].ptitle == "New Dover"
    assert (back["P0001"].lat, back["P0001"].lon, back["P0001"].placerefs) == (2.0, 1.5, ["_b", "_c"])
    assert back["P0002"].had_coord is False


RICH = """<placeobj handle='_r' change="1" id="P9" type="City" priv="1">
  <ptitle lang="en">Old &amp; title</ptitle><code>C1</code>
  <pname lang='de' value='Alt'><dateval val="1800"/></pname><pname value="second" lang="fr"/>
  <placeref hlink="_b"><daterange start="1" stop="2"/></placeref><url href="http://x/?a=1&amp;b=2"/><noteref hlink="_n"/><citationref hlink="_c"/>
</placeobj>"""


def test_gramps_objects_lose_nothing(spark, tmp_path):
    (tmp_path / "a.gramps").write_text(f"<database><places>{RICH}{RICH.replace('_r', '_s')}</places></database>")
    read = gramps.read_gramps(spark, str(tmp_path / "a.gramps"))
    text = 'New $1 \\ "x" & <y>'
    places = read.select("file", "pos", "handle", "fragment", F.when(F.col("handle") == "_s", F.lit(text)).alias("new_text"), F.lit(1.5).alias("lat"), F.lit(-2.0).alias("lon"))
    same, changed = [r.text for r in writers.gramps_rows(places).orderBy("pos").collect()]
    rich = RICH.replace("\n</placeobj>", "</placeobj>")  # but for blanks before the end
    assert same == rich
    new = "New $1 \\ &quot;x&quot; &amp; &lt;y&gt;"
    want = rich.replace("_r", "_s").replace("Old &amp; title", new).replace("'Alt'", f'"{new}"')
    assert changed == want.replace('<pname value="second" lang="fr"/>', '<pname value="second" lang="fr"/><coord long="-2.0" lat="1.5"/>')


DOCUMENT = XML.replace("<people>", "<tags/><events><event id='E1'><description>Dover, Kent &gt; \n x</description></event></events>\n <people>").replace(
    "<objects/>", "<objects/>\n <notes><note id='N1'><text>a > b <![CDATA[ x > y ]]></text></note></notes>")


def rebuilt(folder) -> str:
    return "".join(p.read_bytes().decode() for p in sorted(folder.glob("name=*/source=*/at=*/part-*")))


def spans_of(rows, new_text):
    places = gramps.parse_placeobj(gramps.placeobj_fragments(rows)).withColumn("new_text", new_text)
    return gramps.corrections(places.withColumns({"lat": F.coalesce("lat", F.lit(7.5)), "lon": F.coalesce("lon", F.lit(-8.5))}))


@pytest.mark.parametrize("layout, end", [("as is", ""), ("as is", "\n\n"), ("one line", ""), ("no places", "\n"), ("empty places", "\n")])
def test_an_unedited_document_comes_back_byte_for_byte(spark, tmp_path, small_splits, layout, end):
    text = DOCUMENT.rstrip("\n") + end
    if layout == "one line":
        text = " ".join(line.strip() for line in text.splitlines()) + end
    if layout in ("no places", "empty places"):
        text = text[:text.index("<places>")] + ("<places/>" if layout == "empty places" else "") + text[text.index("</places>") + 9:]
    (tmp_path / "a.gramps").write_text(text)
    rows = gramps.read_rows(spark, str(tmp_path / "a.gramps"))
    writers.write_documents(gramps.document(rows, spans_of(rows, F.lit(None).cast("string"))), str(tmp_path / "out"))
    assert rebuilt(tmp_path / "out") == text


@pytest.mark.parametrize("zipped", [False, True])
def test_an_edited_document_changes_in_its_places_only(spark, tmp_path, small_splits, zipped):
    from xml.etree import ElementTree

    for name in ("a.gramps", "b.gramps"):
        (tmp_path / name).write_bytes(gzip.compress(DOCUMENT.encode()) if zipped else DOCUMENT.encode())
    rows = gramps.read_rows(spark, str(tmp_path / "*.gramps"))
    new = F.when(F.col("id") != "P0002", F.concat(F.lit("New & <"), "id"))
    writers.write_documents(gramps.document(rows, spans_of(rows, new)), str(tmp_path / "out"))
    parts = lambda text: ElementTree.fromstring(text.encode())
    for name in ("a.gramps", "b.gramps"):
        text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob(f"name={name}/source=*/at=*/part-*")))
        before, after = parts(DOCUMENT), parts(text)
        assert [e.tag for e in before] == [e.tag for e in after]
        space = before.tag[:before.tag.index("}") + 1]
        for was, now in zip(before, after):
            if not was.tag.endswith("places"):
                assert ElementTree.tostring(was) == ElementTree.tostring(now)
        objects = {o.get("id"): o for o in after.find(f"{space}places")}
        assert list(objects) == ["P0001", "P0002", "P0003", "P0004", "P0005"]
        assert objects["P0001"].find(f"{space}ptitle").text == "New & <P0001" == objects["P0001"].find(f"{space}pname").get("value")
        assert objects["P0001"].find(f"{space}coord").attrib == {"long": "1.5", "lat": "2.0"}
        assert objects["P0002"].find(f"{space}ptitle").text == "Kent & more, England" and objects["P0002"].find(f"{space}coord") is None
        assert objects["P0005"].find(f"{space}coord").attrib == {"long": "-8.5", "lat": "7.5"}
        cut = lambda t: (t[:t.index("<placeobj")], t[t.index("</places>"):])
        assert cut(text) == cut(DOCUMENT)
        assert '      <ptitle>New &amp; &lt;P0001</ptitle>\n      <pname value="New &amp; &lt;P0001"/>' in text and "\n    </placeobj><placeobj handle=" in text


def test_rows_outside_the_places_meet_no_exchange(spark, tmp_path):
    (tmp_path / "a.gramps").write_text(DOCUMENT)
    rows = gramps.read_rows(spark, str(tmp_path / "a.gramps"))
    inside, outside = gramps.in_places(rows, gramps.sections(rows))
    plan = outside._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert all("raw" not in line and "file" in line for line in moved) and "SortMergeJoin" not in plan
    assert {r.raw.strip() for r in inside.collect()} >= {"<places", "</places"}
    assert not any("placeobj" in r.raw for r in outside.collect())
    assert inside.count() + outside.count() == rows.count()


@pytest.mark.parametrize("where", ["between", "last", "last of a document without an end"])
def test_an_object_that_is_not_closed_ends_at_the_next_tag(spark, tmp_path, where):
    good = '<placeobj id="G"><pname value="good"/></placeobj>'
    bad = '<placeobj id="B"><pname value="bad"/>'
    inner = bad + good if where == "between" else good + bad
    notes = "<notes>" + "<note/>" * 50 + "</notes>"
    text = f"<database><places>{inner}" + ("" if "without" in where else "</places>") + notes + "</database>"
    (tmp_path / "a.gramps").write_text(text)
    rows = gramps.read_rows(spark, str(tmp_path / "a.gramps"))
    read = {r.id: r for r in gramps.parse_placeobj(gramps.placeobj_fragments(rows)).collect()}
    assert {k: (r.place_text, r.closed) for k, r in read.items()} == {"G": ("good", True), "B": ("bad", False)}
    assert "note" not in read["B"].fragment
    writers.write_documents(gramps.document(rows, spans_of(rows, F.lit("new"))), str(tmp_path / "out"))
    assert rebuilt(tmp_path / "out") == text.replace('<pname value="good"/>', '<pname value="new"/><coord long="-8.5" lat="7.5"/>')


def test_lookup_tables_keep_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    empty, missing = tables.read_table(spark, path)
    assert missing and empty.count() == 0 and empty.columns == ["key", "val"]
    for version in (1, 2):
        table, _ = tables.read_table(spark, path)
        more = table.unionByName(spark.createDataFrame([(f"k{version}", "v")], "key STRING, val STRING"))
        assert tables.write_table(more, path) == version
    table, missing = tables.read_table(spark, path)
    assert not missing and sorted(r.key for r in table.collect()) == ["k1", "k2"]


def changes(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq LONG, key STRING, val STRING")


def test_a_merge_replaces_only_the_buckets_it_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    empty, none = tables.read_merged(spark, path)
    assert none == 0 and empty.count() == 0 and empty.columns == ["key", "val"]
    assert tables.merge(changes(spark, *[(f"k{i}", "old") for i in range(300)]), path) == 1
    before = tables.layout(spark, path, 1)
    assert len(before) == tables.BUCKETS
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("part-*.parquet")}
    assert tables.merge(changes(spark, ("k7", "first"), ("k7", "new"), ("k8", None), ("more", "x"), ("gone", None)), path, 1) == 2
    rows = {r.key: r.val for r in tables.read_merged(spark, path)[0].collect()}
    assert rows == {f"k{i}": "old" for i in range(300) if i != 8} | {"k7": "new", "more": "x"}
    after = tables.layout(spark, path, 2)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 4
    assert {p: p.stat().st_mtime_ns for p in stamps} == stamps
    assert tables.read_merged(spark, path, 1)[0].where("key = 'k8'").count() == 1  # the old version can still be read


def test_a_bucket_may_lose_all_its_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.merge(changes(spark, ("a", "1")), path)
    tables.merge(changes(spark, ("a", None)), path)
    assert tables.read_merged(spark, path)[0].count() == 0
    assert tables.merge(changes(spark, ("a", "2")), path) == 3 and tables.read_merged(spark, path)[0].first().val == "2"


def test_of_two_writers_on_one_version_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    tables.merge(changes(spark, ("a", "1")), path)
    plain = tables.versions
    monkeypatch.setattr(tables, "versions", lambda *a: [1])  # what both saw before either wrote
    assert tables.merge(changes(spark, ("a", "mine")), path, 1) == 2
    with pytest.raises(tables.VersionConflict):
        tables.merge(changes(spark, ("a", "theirs")), path, 1)
    monkeypatch.setattr(tables, "versions", plain)
    with pytest.raises(tables.VersionConflict):
        tables.merge(changes(spark, ("a", "late")), path, 1)
    assert [tuple(r) for r in tables.read_merged(spark, path)[0].collect()] == [("a", "mine")]
