"""Places of Gramps XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.coordinates import known
from placewright.operators.running import carry_last
from placewright.sources.scan import scan
from placewright.workspace import small, stage

PLACEOBJ = (
    "_handle STRING, _change STRING, _id STRING, _type STRING, ptitle STRING, "
    "pname ARRAY<STRUCT<_value: STRING>>, coord ARRAY<STRUCT<_long: DOUBLE, _lat: DOUBLE>>, "
    "placeref ARRAY<STRUCT<_hlink: STRING>>"
)


# The parts of a Gramps document beside its places, in their usual order.
OTHER_PARTS = (
    "header", "name-formats", "tags", "events", "people", "families", "citations", "sources", "objects", "repositories", "notes",
    "bookmarks", "namemaps",
)
TAG = r"<(/?(?:placeobj|places|database|" + "|".join(OTHER_PARTS) + r"))(?:\s[^<]*|/)?$"
CLOSING = "</placeobj>"


def with_kind(rows: DataFrame) -> DataFrame:
    """Add ``kind``: what the tag at the end of a row means for the search for place objects, null for most rows."""
    tag, whole = F.regexp_extract("raw", TAG, 1), F.endswith("raw", F.lit("/"))
    return rows.withColumn("kind", F.when(tag == "placeobj", F.when(whole, "whole").otherwise("open")).when(tag == "/placeobj", "end")
                           .when((tag == "places") & ~whole, "section").when(tag.isin("/places", "/database", *OTHER_PARTS), "over"))


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, raw, kind): documents as rows that end before a ``>``, so that they split anywhere, however they are laid out."""
    return scan(spark, paths, line_sep=">", derive=with_kind).drop("rec")


def sections(rows: DataFrame) -> DataFrame:
    """(file, first, last, final): where the places of each document begin and end, and its last row.

    A row for each file, found by two aggregates that read positions and kinds only. The places begin at ``<places``, in a
    document without it at its first place object, and end with ``</places`` or whatever part of the document comes next. Without places,
    ``first`` is null.
    """
    at = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("pos")))
    begun = stage(rows.groupBy("file").agg(F.coalesce(at("section"), at("open", "whole")).alias("first"), F.max("pos").alias("final")), "sections")
    over = rows.where("kind = 'over'").select("file", "pos").join(small(begun), "file").where("pos > first").groupBy("file").agg(F.min("pos").alias("over"))
    return stage(begun.join(over, "file", "left").select("file", "first", F.coalesce("over", "final").alias("last"), "final"), "sections")


def in_places(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the places, and all others; both with ``final``. Telling them apart moves no row: there is one row of ``found`` for each file."""
    placed = rows.join(small(found), "file")
    inside = F.coalesce(F.col("pos").between(F.col("first"), F.col("last")), F.lit(False))
    return placed.where(inside).drop("first", "last"), placed.where(~inside).drop("first", "last")


def by_object(inside: DataFrame) -> DataFrame:
    """Add ``start``, the row at which the last place object at or before a row begins."""
    return carry_last(inside, {"start": F.when(F.col("kind").isin("open", "whole"), F.col("pos"))}, group=("file",))


def gathered(started: DataFrame) -> DataFrame:
    """(file, pos, end, closed, lead, tail, fragment): one row per place object.

    ``lead`` is the text of the first row before the object, ``tail`` the blanks before its closing tag, which ``fragment`` leaves out. An
    object that isn't closed ends before the next one, or where the places end.
    """
    rows = started.where("start IS NOT NULL").groupBy("file", F.col("start").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "raw"))).alias("rows"))
    end = F.array_min(F.transform(F.filter("rows", lambda r: r["kind"] == "end"), lambda r: r["pos"]))
    whole = F.col("rows")[0]["kind"] == "whole"
    known_end = rows.withColumn("end", F.when(whole, F.col("pos")).otherwise(end))
    own = F.filter("rows", lambda r: F.coalesce(r["pos"] <= F.col("end"), F.coalesce(r["kind"] != "over", F.lit(True))))
    text = F.array_join(F.transform(own, lambda r: r["raw"]), ">")
    lead = F.regexp_extract(F.col("rows")[0]["raw"], r"(?s)^(.*?)<placeobj(?:[\s/]|$)", 1)
    cut = known_end.select("file", "pos", "end", whole.alias("whole"), lead.alias("lead"), F.expr("end IS NOT NULL").alias("closed"), text.alias("text"))
    inner = F.substring(F.col("text"), F.length("lead") + 1, F.length("text"))
    body = F.when(F.col("whole"), F.concat(inner, F.lit(">"))).when(F.col("closed"), F.concat(F.regexp_replace(inner, r"\s*</placeobj\s*$", ""), F.lit(CLOSING))).otherwise(
        F.concat(inner, F.lit(">"), F.lit(CLOSING)))
    tail = F.when(F.col("closed") & ~F.col("whole"), F.regexp_extract(inner, r"(\s*)</placeobj\s*$", 1)).otherwise("")
    return cut.select("file", "pos", "end", "closed", "lead", tail.alias("tail"), body.alias("fragment"))


def placeobj_fragments(rows: DataFrame) -> DataFrame:
    """The place objects of documents, read as rows. Only rows of the places are moved."""
    return gathered(by_object(in_places(rows, sections(rows))[0]))


def parse_placeobj(fragments: DataFrame) -> DataFrame:
    """Place rows from XML text: the place's name is its title or its first name, whichever comes later.

    Every place is kept; ``had_coord`` tells which had coordinates already.
    """
    parsed = fragments.withColumn("p", F.from_xml("fragment", PLACEOBJ, {"valueTag": "_text"}))
    title, name = F.col("p.ptitle"), F.get("p.pname", F.lit(0))["_value"]
    coord = F.get("p.coord", F.size("p.coord") - 1)
    return parsed.select(
        "file", "pos", F.col("p._handle").alias("handle"), F.col("p._change").alias("change"), F.col("p._id").alias("id"),
        F.col("p._type").alias("type"), title.alias("ptitle"), name.alias("pname"),
        _later(F.col("fragment"), title, name).alias("place_text"),
        coord["_lat"].alias("lat"), coord["_long"].alias("lon"), coord.isNotNull().alias("had_coord"),
        F.transform("p.placeref", lambda r: r["_hlink"]).alias("placerefs"), "fragment",
        *[c for c in ("end", "closed", "lead", "tail") if c in fragments.columns],
    )


def _later(fragment: Column, title: Column, name: Column) -> Column:
    title_last = F.locate("<ptitle", fragment) > F.locate("<pname", fragment)
    return F.when(title_last, F.coalesce(title, name)).otherwise(F.coalesce(name, title))


def escaped(text: Column) -> Column:
    """Text as it stands in XML, in an element or in a double-quoted attribute."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _put(fragment: Column, pattern: str, new: Column) -> Column:
    """Replace what follows group 1 of ``pattern`` by ``new``, once; ``new`` is plain text."""
    plain = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(fragment, F.lit(pattern), F.concat(F.lit("$1"), plain))


def corrected_fragment(fragment: Column, new_text: Column, lat: Column, lon: Column) -> Column:
    """A place object with another title, first name and coordinates; everything else in it stays as it was.

    A null ``new_text`` leaves the object as it is. Title and name are set where the object has them. Coordinates take the
    place of the first ones, or come after the last name or else the title; without both, those that are there stay.
    """
    value = escaped(new_text)
    titled = _put(fragment, r"(?s)^(.*?<ptitle(?:\s[^>]*)?>)[^<]*", value)
    named = _put(titled, r"""(?s)^(.*?<pname\s(?:[^>]*?\s)?value=)(?:"[^"]*"|'[^']*')""", F.concat(F.lit('"'), value, F.lit('"')))
    coord = F.concat(F.lit('<coord long="'), lon.cast("string"), F.lit('" lat="'), lat.cast("string"), F.lit('"/>'))
    has_coord = F.rlike(fragment, F.lit(r"<coord\s"))
    placed = F.when(has_coord, _put(named, r"(?s)^(.*?)<coord\s[^>]*?(?:/>|>\s*</coord>)", coord)).when(
        F.rlike(fragment, F.lit(r"<pname\s")), _put(named, r"(?s)^(.*<pname\s[^>]*?(?:/>|(?<!/)>.*?</pname>))", coord)
    ).otherwise(_put(named, r"(?s)^(.*?</ptitle>)", coord))
    return F.when(new_text.isNull(), fragment).when(known(lat, lon), placed).otherwise(named)


def read_gramps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_placeobj(placeobj_fragments(read_rows(spark, paths)))


def corrections(places: DataFrame) -> DataFrame:
    """(file, pos, end, text): the spans of rows that corrected place objects take, and their new text; ``places`` as in :func:`corrected_fragment`.

    An object that isn't closed stays as it is.
    """
    new = corrected_fragment(F.col("fragment"), F.col("new_text"), F.col("lat"), F.col("lon"))
    text = F.concat("lead", F.substring(new, F.lit(1), F.length(new) - len(CLOSING)), "tail", F.lit(CLOSING))
    return places.where(F.col("new_text").isNotNull() & F.col("closed") & F.endswith("fragment", F.lit(CLOSING))).select("file", "pos", "end", text.alias("text"))


def document(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, pos, text, is_tail): whole documents in which ``spans`` take the place of what was there.

    A text is followed by ``>``, but for that of ``is_tail``: what comes after a document's last tag. Rows outside the places are neither
    joined with a span nor grouped; inside, a row meets the span of its own object only.
    """
    inside, outside = in_places(rows, sections(rows))
    own = by_object(inside)
    gone = spans.select("file", F.col("pos").alias("start"), F.col("end").alias("_end"))
    kept = own.join(gone, ["file", "start"], "left").where("_end IS NULL OR pos > _end")
    is_tail = (F.col("pos") == F.col("final")) & ~F.contains("raw", F.lit("<"))
    as_read = [df.select("file", "pos", F.col("raw").alias("text"), is_tail.alias("is_tail")) for df in (outside, kept)]
    written = spans.select("file", "pos", F.substring(F.col("text"), F.lit(1), F.length("text") - 1).alias("text"), F.lit(False).alias("is_tail"))
    return as_read[0].unionByName(as_read[1]).unionByName(written)
