"""One query per operator, over the shared views."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.views import view
from placewright.functions import coordinates, hierarchy_key, replacement, text
from placewright.operators import context, disposition, hierarchy, lookup, match, people, rewrite, spelling
from placewright.operators.skew import salted_join
from placewright.plans import jobs
from placewright.sources import gazetteer as gaz_source
from placewright.sources import gedcom, gramps, tables, writers
from placewright import workspace
from placewright.workspace import stage

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs ----------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Parsed lines as a reader leaves them: staged."""
    return stage(gedcom.parse(view(spark, d, "gedcom_lines")), "lines")


def _gaz(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "gaz").select(
        "geoid", "name", text.normalize(F.col("name")).alias("norm"), "lat", "lon", "feature", "tier",
        F.lower("country").alias("country_iso"), F.col("country").alias("country_name"), F.col("admin1").alias("admin1_id"),
        F.col("admin1").alias("admin1_name"), F.col("admin2").alias("admin2_id"), F.col("admin2").alias("admin2_name"),
    )


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The gazetteer as lookups read it: a table that is built once."""
    return stage(match.searchable(_gaz(spark, d), view(spark, d, "validity")), "rows")


def _part_rows(spark: SparkSession, d: str, country: str = "country", name: str = "name") -> DataFrame:
    """Products as a gazetteer of cities."""
    blank = F.lit("")
    gaz = view(spark, d, "part_gaz").withColumn("c", F.expr(country)).withColumn("nm", F.expr(name)).select(
        "geoid", F.col("nm").alias("name"), text.normalize(F.col("nm")).alias("norm"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        F.lit("PPL").alias("feature"), F.lit(3).alias("tier"), F.lower("c").alias("country_iso"), F.col("c").alias("country_name"),
        blank.alias("admin1_id"), blank.alias("admin1_name"), blank.alias("admin2_id"), blank.alias("admin2_name"),
    )
    return stage(match.searchable(gaz), "rows")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Place lines with their normalised key."""
    return view(spark, d, "raw_places").select("*", F.lit(0).cast("long").alias("rec"), F.col("seq").alias("pos")).withColumn(
        "key", text.normalize(F.col("place_text"))
    )


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return match.distinct_keys(match.distinct_texts(view(spark, d, "raw_places")))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The distinct texts with their locations."""
    return match.with_location(match.distinct_texts(view(spark, d, "raw_places")))


def _locations(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return parsed.select("loc", *match.LOCATION).distinct()


def _part_locations(entries: DataFrame) -> DataFrame:
    """(country, name) as locations."""
    texts = entries.select(F.concat_ws(",", "name", F.lit(""), F.lit(""), "country").alias("place_text")).distinct()
    return match.with_location(texts.withColumn("key", text.normalize(F.col("place_text"))))


def _replacements(spark: SparkSession, d: str) -> DataFrame:
    table = lookup.rekey(view(spark, d, "repl"))
    return lookup.resolve_replacements(table, _gaz(spark, d))


def _skips(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "skips").select(text.normalize(F.col("key")).alias("key"), "val")


def _countries(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "countries").select(text.normalize(F.col("name")).alias("n_country"), "supported")


def _settled(spark: SparkSession, d: str) -> jobs.Settled:
    """Place lines with disposition and corrected text, through all stages of matching."""
    places = view(spark, d, "raw_places").select("*", F.lit(0).cast("long").alias("rec"), F.col("seq").alias("pos"))
    return jobs.settle(
        stage(places, "places"), _replacements(spark, d), _skips(spark, d), _rows(spark, d), _countries(spark, d)
    )


# --- reading and context ---------------------------------------------------------------------------------------------


@query
def gedcom_parse(spark, d):
    return gedcom.parse(view(spark, d, "rough_lines")).select("rec", "pos", "level", "label", "tag", "value")


@query
def gedcom_events(spark, d):
    return context.places(_lines(spark, d)).select(
        "rec", "pos", "record_id", "person", "event_name", "date", "event_year", "about", "place_text"
    )


@query
def place_count(spark, d):
    return context.place_count(gedcom.parse(view(spark, d, "gedcom_lines")))


@query
def events_by_century(spark, d):
    return jobs.events_by_century(context.places(_lines(spark, d)))


@query
def person_names(spark, d):
    return people.person_names(_lines(spark, d))


@query
def person_pointer_names(spark, d):
    names = people.resolve_pointers(stage(people.person_names(_lines(spark, d)), "names"))
    return names.select("file", "id", people.display_name(F.col("name"), F.lit("")).alias("person"))


@query
def place_people(spark, d):
    lines = _lines(spark, d)
    names = stage(people.person_names(lines), "names")
    placed = context.places(lines).select("file", "rec", "pos", "record_id", "person")  # with_person stages them
    return people.with_person(placed, names).select("rec", "pos", "person")


# --- writing ---------------------------------------------------------------------------------------------------------


def _edits(lines):
    order = F.expr("pos div 10")
    return lines.where("tag = 'PLAC'").select(
        "file", "rec", "pos", F.when(order % 4 == 0, "UPDATE").when(order % 4 == 1, "DELETE").alias("action"),
        F.concat(F.upper("value"), F.lit(", ")).alias("text"), F.when(F.col("rec") % 7 != 0, F.col("rec") % 90 + 0.25).cast("double").alias("lat"),
        (-(F.col("rec") % 180) - 0.5).cast("double").alias("lon"),
    ).where("action IS NOT NULL")


@query
def map_block_rewrite(spark, d):
    lines = rewrite.number_rows(_lines(spark, d), "line_no")
    touched = lines.where("tag = 'PLAC'")
    dropped = rewrite.old_block_lines(lines, touched)
    return lines.join(dropped, ["file", "rec", "line_no"], "left_semi").select("rec", "pos", "tag")


@query
def gedcom_rewrite(spark, d):
    lines = _lines(spark, d)
    return rewrite.rewrite(lines, _edits(lines)).select("rec", "pos", "sub", "text")


@query
def gedcom_roundtrip(spark, d):
    lines = _lines(spark, d)
    return rewrite.rewrite(lines, _edits(lines).where("false")).select("rec", "pos", "text")


# --- lookup tables ---------------------------------------------------------------------------------------------------


@query
def replacement_build(spark, d):
    return view(spark, d, "decisions").select("seq", replacement.build_entry(F.col("geoid"), F.col("prefix")).alias("val"))


@query
def replacement_parse(spark, d):
    return view(spark, d, "repl").select(
        "key", replacement.entry_prefix(F.col("val")).alias("prefix"), replacement.entry_geoid(F.col("val")).alias("geoid")
    )


@query
def replacement_apply(spark, d):
    applied = lookup.apply_tables(_keys(spark, d), _replacements(spark, d), _skips(spark, d))
    return applied.where("repl_result IS NOT NULL").select("key", "n", "repl_result", "repl_geoid", "repl_prefix", "repl_name")


@query
def skip_split(spark, d):
    return lookup.apply_tables(_keys(spark, d), _replacements(spark, d), _skips(spark, d)).select("key", "n", "skipped")


@query
def normalize_text(spark, d):
    """Whole texts; and a text of accented letters, Hangul, kana and Indic letters for each, as single characters and as letters and marks."""
    planted = "Constanța, Timişoara, Hà Nội, Ǻngström Άθήνα ё Й, 각 서울 が ড়"
    forms = {"composed": unicodedata.normalize("NFC", planted), "decomposed": unicodedata.normalize("NFD", planted)}
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.cleaned(F.col("text")).alias("clean")).select(
        "doc_id", text.key_of(F.col("clean")).alias("normalized"), text.key_of(F.col("clean"), remove_commas=True).alias("no_commas"),
        *[text.normalize(F.concat(F.lit(form + " "), "doc_id")).alias(name) for name, form in forms.items()]
    )


@query
def dict_rekey(spark, d):
    table = view(spark, d, "repl").select(F.expr("posexplode(array(upper(key), concat(' ', key, '. ')))"), "key", "val").select(
        F.col("pos").alias("seq"), F.col("col").alias("key"), F.concat("val", F.col("pos").cast("string")).alias("val")
    )
    return lookup.rekey(table, "seq")


@query
def dict_upsert(spark, d):
    base = view(spark, d, "decisions").select(F.lower("key").alias("key"), F.lit("@BASE@base").alias("val")).distinct()
    replaced = lookup.upsert_replacements(base, view(spark, d, "decisions"))
    skipped = lookup.upsert_skips(base.where("false"), view(spark, d, "decisions"))
    return replaced.select(F.lit("replace").alias("list"), "key", "val").unionByName(skipped.select(F.lit("skip").alias("list"), "key", "val"))


@query
def table_upsert(spark, d):
    """All six lookup tables, kept in buckets: a first version, then additions and removals, then read back."""
    nation, decisions = spark.read.parquet(f"{d}/nation.parquet"), view(spark, d, "decisions")
    key, none = F.lower("key"), F.lit(None).cast("string")
    rows = lambda df, seq, key, val: df.select(F.expr(seq).cast("long").alias("seq"), key.alias("key"), val.alias("val"))
    base = decisions.select(key.alias("key"), F.lit("@BASE@base").alias("val")).distinct()
    docs, code = spark.read.parquet(f"{d}/documents.parquet"), F.substring("n_name", 1, 2)
    parts = {
        "replacements": (rows(base, "0", F.col("key"), F.col("val")), rows(lookup.upsert_replacements(base, decisions), "1", F.col("key"), F.col("val"))),
        "skips": (rows(base.limit(0), "0", F.col("key"), F.col("val")), rows(lookup.upsert_skips(base.where("false"), decisions), "1", F.col("key"), F.col("val"))),
        "features": (rows(view(spark, d, "gaz"), "0", F.col("feature"), F.lit("")), rows(nation, "n_nationkey", F.concat(F.lit(" "), code), F.when(F.col("n_nationkey") % 3 > 0, "")).unionByName(
            rows(nation, "1", F.lit("adm2"), none)).unionByName(rows(nation, "1", F.lit(" "), F.lit("")))),
        "languages": (rows(docs, "0", F.upper("lang"), F.lit("")), rows(docs, "1", F.col("source"), F.lit("")).unionByName(rows(nation, "2", code, F.lit(""))).unionByName(rows(nation, "3", F.lit("EN"), none))),
        "rules": (rows(nation, "n_nationkey", F.col("n_name"), F.lit("x")), rows(nation, "n_nationkey", F.concat(F.lit("New "), code), F.concat(F.lit("N"), "n_nationkey"))),
        "countries": (rows(nation, "n_nationkey", F.lit(" "), F.col("n_name")), rows(nation, "n_nationkey", F.concat(code, F.lit(" ")), F.col("n_name"))),
    }
    out = None
    for name, (first, more) in parts.items():
        path = f"{workspace.folder(spark)}/table-{uuid.uuid4().hex}"
        version = tables.merge(lookup.added(name, first), path, 0)
        tables.merge(lookup.added(name, more), path, version)
        read = tables.read_merged(spark, path)[0].select(F.lit(name).alias("list"), "key", "val")
        out = read if out is None else out.unionByName(read)
    return out


@query
def dict_delete(spark, d):
    gone = view(spark, d, "repl").where("val = '@@'").select("key")
    return lookup.delete_keys(view(spark, d, "repl"), gone)


@query
def replacement_listing(spark, d):
    return lookup.replacement_listing(_replacements(spark, d))


# --- gazetteer -------------------------------------------------------------------------------------------------------


@query
def gaz_filter(spark, d):
    wanted = view(spark, d, "countries").where("supported").select(F.lower("name").alias("key"))
    features = spark.createDataFrame([("PPL ",), ("adm2",), ("ADM1",)], "key STRING")
    return gaz_source.allowed(_gaz(spark, d), wanted, features).select("geoid", "country_iso", "feature")


@query
def feature_defaults(spark, d):
    wanted = view(spark, d, "countries").select(F.lower("name").alias("key"))
    features = spark.createDataFrame([("XYZ",)], "key STRING")
    return gaz_source.allowed(_gaz(spark, d), wanted, features).groupBy("country_iso", "feature").agg(F.count("*").alias("places"))


@query
def language_filter(spark, d):
    alternates = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("geoid"), "lang", F.col("source").alias("alt_name")
    )
    languages = spark.createDataFrame([("FR",), ("de",), ("english",)], "key STRING")
    return gaz_source.allowed_alternates(alternates, languages)


@query
def admin_names(spark, d):
    gaz = _gaz(spark, d)
    bare = gaz.drop("country_name", "admin1_name", "admin2_name")
    names = {t: gaz.where(f"tier = {k}") for k, t in enumerate(("country", "admin1", "admin2"))}
    return gaz_source.with_names(bare, names["country"], names["admin1"], names["admin2"]).select(
        "geoid", "country_name", "admin1_name", "admin2_name"
    )


@query
def admin2_fill(spark, d):
    places = view(spark, d, "matched_places")
    blank = places.select("seq", "city", F.lit("").alias("admin2_id"), "admin2_name", "admin1_id", "country_iso")
    return match.fill_admin2(blank, _rows(spark, d)).select("seq", "admin2_id", "admin2_name")


# --- matching --------------------------------------------------------------------------------------------------------


@query
def first_resolution(spark, d):
    return match.first_occurrence(_keyed(spark, d), ["seq"], ["event_year"])


@query
def country_support(spark, d):
    return match.country_support(_locations(spark, d), _countries(spark, d)).select("loc", "support")


@query
def exact_match(spark, d):
    found = match.exact_match(_locations(spark, d), _rows(spark, d))
    return found.select("loc", match.exact_result(F.col("n")).alias("result"), F.col("n").alias("candidates"), "best.geoid", "best.score")


@query
def asof_match(spark, d):
    """Products of one name that came into use in different years, asked for in every year of an order."""
    rows = _part_rows(spark, d, country="'EVERYWHERE'").withColumn("first_year", F.expr("CASE WHEN substring(geoid, 2) % 11 = 0 THEN NULL ELSE CAST(1993 + substring(geoid, 2) * 7 % 9 AS INT) END"))
    years = view(spark, d, "raw_places").select(F.col("event_year").alias("year")).distinct().unionByName(spark.range(1).select(F.lit(0).alias("year")))
    names = match.distinct_locations(_part_locations(rows.select(F.lit("EVERYWHERE").alias("country"), "name")))
    asked = names.join(F.broadcast(years.agg(F.collect_set("year").alias("years")).withColumn("m_tier", F.lit(3))), "m_tier").withColumn("year", F.explode("years")).withColumn("loc", F.concat_ws("|", "m_name", "year"))
    return match.with_exact(asked.select("loc", *match.LOCATION, "year"), rows).select("loc", "n", "best.geoid", "best.first_year")


@query
def city_without_county(spark, d):
    """Cities asked for by three parts, which read as a county."""
    texts = view(spark, d, "gaz").where("tier = 3").select(F.concat_ws(",", "name", "admin1", "country").alias("place_text")).distinct()
    locations = match.with_location(texts.withColumn("key", text.normalize(F.col("place_text"))))
    return match.exact_match(locations.select("loc", *match.LOCATION).distinct(), _rows(spark, d)).select(
        "loc", F.col("n").alias("candidates"), "best.geoid", "best.score")


def _best(spark, d):
    """Place lines with the best candidate of their text."""
    parsed = stage(_parsed(spark, d), "texts")
    found = match.exact_match(parsed.select("loc", *match.LOCATION).distinct(), _rows(spark, d))
    best = found.select("loc", "best")
    by_text = salted_join(parsed.select("place_text", "loc"), best, ["loc"], spread=["place_text"], how="inner")
    return salted_join(view(spark, d, "raw_places"), by_text, ["place_text"], spread=["seq"], how="inner", counts=parsed)


@query
def best_match(spark, d):
    return _best(spark, d).select("seq", "best.geoid", "best.lat", "best.lon")


def _homonyms(spark, d):
    rows = _part_rows(spark, d, country="'EVERYWHERE'")
    return match.with_exact(_part_locations(rows.select(F.lit("EVERYWHERE").alias("country"), "name")).select("loc", *match.LOCATION), rows), rows


def _ranked(candidates):
    return match.ranked(candidates).select("loc", "rank", "geoid", "score")


@query
def candidate_rank(spark, d):
    return _ranked(match.exact_candidates(*_homonyms(spark, d)))


@query
def multiple_match(spark, d):
    return _homonyms(spark, d)[0].select("loc", match.exact_result(F.col("n")).alias("result"), F.col("n").alias("candidates"))


@query
def validity_flag(spark, d):
    valid = match.valid_year(F.col("event_year"), F.col("best.first_year"))
    return _best(spark, d).select("seq", "best.geoid", F.when(valid, "").otherwise("VERIFY DATE").alias("flag"))


@query
def wildcard_match(spark, d):
    return _ranked(match.wildcard_match(_locations(spark, d), _rows(spark, d)))


@query
def wildcard_parts(spark, d):
    """Patterns in the name, the admin1, the country, and in several of them."""
    texts = view(spark, d, "wild_texts")
    locations = match.with_location(texts.withColumn("key", text.normalize(F.col("place_text"))))
    return _ranked(match.wildcard_match(locations.select("loc", *match.LOCATION).distinct(), _rows(spark, d)))


@query
def word_match(spark, d):
    names = view(spark, d, "misspelt")
    entries = names.select("country", F.concat_ws(" ", "w2", "w1").alias("name")).unionByName(names.select("country", F.col("w1").alias("name")))
    return _ranked(match.word_match(_part_locations(entries), _part_rows(spark, d)))


@query
def partial_match(spark, d):
    entries = view(spark, d, "misspelt").select("country", F.concat_ws(" ", F.lit("old"), "w2", F.lit("near"), "w1").alias("name"))
    return _ranked(match.partial_match(_part_locations(entries), _part_rows(spark, d)))


@query
def soundex_match(spark, d):
    """Both misspelt words against both words of all names."""
    names = view(spark, d, "misspelt")
    entries = names.select("country", F.col("m1").alias("name")).unionByName(names.select("country", F.col("m2").alias("name")))
    rows = _part_rows(spark, d, name="split_part(name, ' ', 1)").unionByName(_part_rows(spark, d, name="split_part(name, ' ', 2)"))
    return _ranked(match.soundex_match(_part_locations(entries), rows))


# --- settling --------------------------------------------------------------------------------------------------------


@query
def place_disposition(spark, d):
    return _settled(spark, d).rows.select("seq", "disposition", "result", "text")


@query
def run_stats(spark, d):
    settled = _settled(spark, d).rows
    totals = view(spark, d, "raw_places").groupBy("file").agg(F.count("*").alias("places"))
    return disposition.run_stats(settled, totals)


@query
def diagnostics(spark, d):
    return disposition.diagnostics(_settled(spark, d).rows)


@query
def miss_log(spark, d):
    return disposition.misses(_settled(spark, d).rows)


@query
def review_queue(spark, d):
    return jobs.review_rows(_settled(spark, d)).select("key", "occurrences", "result", "action", "save_allowed", "candidates")


@query
def review_listing(spark, d):
    settled = _settled(spark, d)
    return jobs.review_listing(settled, jobs.review_rows(settled)).select("key", "rank", "geoid", "score")


@query
def resolve_stage(spark, d):
    """The stage that settled each key, its result and its number of candidates."""
    return _settled(spark, d).keys.select("key", "result", "stage", F.coalesce("n_candidates", F.lit(0)).alias("candidates"))


# --- spelling --------------------------------------------------------------------------------------------------------


@query
def spell_vocab(spark, d):
    return spelling.vocabulary(spark.read.parquet(f"{d}/documents.parquet").select(F.lower("text").alias("name")))


@query
def spell_eligible(spark, d):
    terms = spark.read.parquet(f"{d}/conversations.parquet").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return terms.select("term", spelling.lookup_allowed(F.col("term")).alias("looked_up"), spelling.correction_allowed(F.col("term")).alias("corrected"))


def _part_vocabulary(spark, d):
    return spelling.vocabulary(view(spark, d, "part_gaz"))


@query
def spell_suggest(spark, d):
    wrong = view(spark, d, "misspelt")
    terms = wrong.select(F.explode(F.array("m1", "m2", "w1", F.reverse("w2"))).alias("term"))
    return spelling.suggest(terms, _part_vocabulary(spark, d))


@query
def spell_phrase(spark, d):
    phrases = view(spark, d, "misspelt").select("id", F.concat_ws(" ", "m1", "w2", "m2").alias("phrase"))
    return spelling.correct_phrases(phrases, _part_vocabulary(spark, d))


@query
def spell_compound(spark, d):
    """Names glued into one word, torn apart, misspelt, and all of it."""
    wrong = view(spark, d, "misspelt")
    glued, torn = F.concat("w1", "w2"), F.concat_ws(" ", F.substring("w2", 1, 2), F.expr("substring(w2, 3)"))
    phrases = wrong.select(F.inline(F.array(*[F.struct((F.col("id") * 10 + k).alias("id"), phrase.alias("phrase")) for k, phrase in enumerate(
        [glued, torn, F.concat_ws(" ", "m1", "w2"), F.concat("m1", "w2"), F.concat_ws(" ", "w1", torn), F.concat_ws(" ", "w1", glued, "m2")])])))
    return spelling.correct_compound(phrases, _part_vocabulary(spark, d))


# --- hierarchy -------------------------------------------------------------------------------------------------------


@query
def hierarchy_keys(spark, d):
    return hierarchy.nodes(view(spark, d, "matched_places")).select(
        "seq", "tier", "key", hierarchy_key.level(F.col("key")).alias("level"), "parent_key", "place_id",
        hierarchy_key.is_synthetic(F.col("place_id")).alias("made_up"),
    )


@query
def hierarchy_names(spark, d):
    return hierarchy.nodes(view(spark, d, "matched_places")).select(
        "seq", "name", "type", text.city_part(F.col("title")).alias("city_part"), text.prefix_part(F.col("title")).alias("prefix_part"),
        hierarchy_key.feature_when_moving_up(F.col("tier"), F.col("feature")).alias("up_feature"),
    )


@query
def hierarchy_dedupe(spark, d):
    return hierarchy.dedupe(hierarchy.nodes(view(spark, d, "matched_places"))).select("tier", "key", "place_id", "seq")


@query
def ancestor_closure(spark, d):
    return hierarchy.ancestors(view(spark, d, "matched_places")).select("tier", "key", "seq", "feature")


def _hierarchy(spark, d):
    return hierarchy.build_hierarchy(view(spark, d, "matched_places"), _gaz(spark, d))


@query
def enclosed_by(spark, d):
    return _hierarchy(spark, d).select("tier", "key", "place_id", "name", "feature", "enclosed_by")


@query
def enclosure_check(spark, d):
    return hierarchy.enclosure_violations(_hierarchy(spark, d)).select("tier", "key", "enclosed_by")


@query
def hierarchy_csv(spark, d):
    return writers.hierarchy_csv_rows(_hierarchy(spark, d)).drop("tier", "key")


# --- text ------------------------------------------------------------------------------------------------------------


@query
def capwords(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", text.capwords(F.translate("text", "e", "'")).alias("titled")
    )


@query
def long_name(spark, d):
    return _gaz(spark, d).select("geoid", jobs.gazetteer_name().alias("long_name"))


@query
def output_text(spark, d):
    parsed = match.parse_place(view(spark, d, "raw_places"))
    name = text.long_name(*[F.col(c) for c in ("city", "admin2", "admin1", "country")])
    return parsed.select("seq", "tier", text.output_text(F.col("prefix"), name).alias("text"))


@query
def output_rules(spark, d):
    rules = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_nationkey").alias("seq"), F.col("n_name").alias("orig"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("repl")
    )
    named = _gaz(spark, d).select("geoid", jobs.gazetteer_name().alias("name"), jobs.rule_list(rules).alias("rules"))
    return named.select("geoid", text.apply_rules(F.col("name"), F.col("rules")).alias("name"))


@query
def coord_format(spark, d):
    return view(spark, d, "matched_places").select(
        "seq", coordinates.four_decimals(F.col("lat")).alias("lat"), coordinates.four_decimals(F.col("lon")).alias("lon")
    )


@query
def xml_places(spark, d):
    return gramps.parse_placeobj(view(spark, d, "placeobj")).select(
        "id", "handle", "type", "place_text", "lat", "lon", "had_coord", F.array_join("placerefs", ",").alias("placerefs")
    )


@query
def gramps_rewrite(spark, d):
    """Every second tier corrected, the others as they were, with whatever else the objects hold."""
    more = F.concat(F.lit('<url href="http://x/?a=1&amp;b='), "geoid", F.lit('"/><noteref hlink="_n"/></placeobj>'))
    objects = view(spark, d, "placeobj").withColumn("fragment", F.replace("fragment", F.lit("</placeobj>"), more))
    edited = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("New & "), "name"))
    return writers.gramps_rows(objects.select("file", "pos", "fragment", "geoid", edited.alias("new_text"), (F.col("lat") + 0.5).alias("lat"), "lon")).select("text")


@query
def gramps_document(spark, d):
    """Whole documents in which cities are renamed and moved; everything else is as it was."""
    rows = stage(gramps.with_kind(view(spark, d, "xml_rows")), "rows")
    objects = gramps.parse_placeobj(gramps.placeobj_fragments(rows))
    edited = F.when(F.col("pname").isNotNull(), F.concat(F.lit("New & "), "pname"))
    spans = stage(gramps.corrections(objects.withColumn("new_text", edited).withColumn("lat", F.col("lat") + 0.5)), "spans")
    return gramps.document(rows, spans)
