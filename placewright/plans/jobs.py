"""The jobs: correct GEDCOM files, correct Gramps files, queue places for review, fold decisions in, build a gazetteer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import text as tx
from placewright.operators import context, disposition, hierarchy, lookup, match, people, rewrite, spelling
from placewright.operators.skew import salted_join
from placewright.schemas import CANDIDATE_FIELDS, CITY, NO_MATCH_SCORE
from placewright.sources import gazetteer as gaz_source
from placewright.sources.gedcom import read_gedcom
from placewright.sources.gramps import corrections, document, parse_placeobj, placeobj_fragments, read_rows
from placewright.workspace import stage



@dataclass
class Tables:
    """Lookup tables of a run. ``replacements``, ``skips``: (key, val). ``countries``: (n_country, supported) over all
    countries; with a ``country_iso`` too, only the files of the countries that are asked for are read from a gazetteer laid out by country. ``validity``: (country_iso, admin1_id, first_year). ``rules``: (seq, orig, repl), few. A ``seq`` column in
    ``replacements`` is the order in which the last of equal keys wins. ``vocabulary`` and ``spelling_index``: what :func:`build_spelling` wrote.
    ``pad_years``: years by which an event may come before a name without being flagged."""

    replacements: DataFrame
    skips: DataFrame
    countries: DataFrame
    validity: DataFrame | None = None
    rules: DataFrame | None = None
    vocabulary: DataFrame | None = None
    spelling_index: DataFrame | None = None
    pad_years: int = 0


def rule_list(rules: DataFrame | None) -> Column | None:
    """Output rules as one array value, fetched by a scalar subquery: a list that a person keeps, applied in its order."""
    if rules is None:
        return None
    return rules.agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "orig", "repl"))).alias("rules")).scalar()


def gazetteer_name(row: str = "") -> Column:
    """Display name of a gazetteer row; ``row`` is the name of a struct column that holds it."""
    at = f"{row}." if row else ""
    city = F.when(F.col(f"{at}tier") >= CITY, F.col(f"{at}name")).otherwise("")
    rest = [F.coalesce(F.col(f"{at}{c}"), F.lit("")) for c in ("admin2_name", "admin1_name", "country_name")]
    return tx.long_name(city, *rest)


def events_by_century(places: DataFrame) -> DataFrame:
    """Places per file, event and century; century 0 where the year is unknown."""
    century = F.when(F.col("event_year") > 0, F.floor((F.col("event_year") + 99) / 100)).otherwise(0).cast("int")
    return places.groupBy("file", "event_name", century.alias("century")).agg(
        F.count("*").alias("places"), F.count_if("about").alias("about")
    )


# --- resolving -------------------------------------------------------------------------------------------------------


def resolve_locations(
    locations: DataFrame, rows: DataFrame, countries: DataFrame, fuzzy: bool = True, vocabulary: DataFrame | None = None, filed: DataFrame | None = None,
    pad_years: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(loc, result, stage, n, best) for distinct locations, and the candidate rows (loc, score, fields) behind them.

    Cheap equality lookups first; each later stage sees only what the earlier ones left open. What a stage leaves is
    staged, since the next stage and the result both read it; a stage that nothing is left for is passed over. Candidate rows are worked out for listings only. Where locations have a
    ``year``, names in use in it come first among equal candidates, in every stage.
    """
    locations = stage(locations, "locations")
    years = locations.select("loc", "year") if "year" in locations.columns else None
    supported = F.col("support").isNull()
    checked = match.country_support(locations, countries)
    tried = stage(match.with_exact(checked.where(supported).drop("support"), rows, pad_years), "exact")
    outcome = ("result", "stage", "n", "best")
    unsupported = checked.where(~supported).select(
        "loc", F.col("support").alias("result"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(tried.schema["best"].dataType).alias("best"))
    exact = tried.where("best IS NOT NULL")
    found = unsupported.unionByName(exact.select("loc", match.exact_result(F.col("n")).alias("result"), F.lit("EXACT").alias("stage"), "n", "best"))
    candidates = match.exact_candidates(exact, rows)
    left = tried.where("best IS NULL").select("loc", *match.LOCATION)
    stages = [
        ("WILDCARD", "WILDCARD_MATCH", match.wildcard_match), ("WORD", "WORD_MATCH", match.word_match), ("PARTIAL", "PARTIAL_MATCH", match.partial_match),
        ("SOUNDEX", "SOUNDEX_MATCH", match.soundex_match), ("SPELLING", "PARTIAL_MATCH", partial(spelling_match, vocabulary=vocabulary, filed=filed)),
    ]
    if fuzzy:
        patterns = match.is_pattern(*match.WILD_PARTS)
        wild, open_ = left.where(patterns), left.where(~patterns)
        for name, result, find in stages:
            asked = wild if name == "WILDCARD" else open_
            if asked.isEmpty():
                continue
            hits = stage(find(asked if name == "SPELLING" else match.also_as_cities(asked), rows), "candidates")
            looked = stage(asked.join(match.summary(hits, years, pad_years), "loc", "left"), "looked")
            found = found.unionByName(looked.where("best IS NOT NULL").select("loc", F.lit(result).alias("result"), F.lit(name).alias("stage"), "n", "best"))
            candidates = candidates.unionByName(hits)
            rest = looked.where("best IS NULL").select("loc", *match.LOCATION)
            if name == "WILDCARD":
                wild = rest
            else:
                open_ = rest
        left = wild.unionByName(open_)
    nothing = left.select("loc", F.lit("NO_MATCH").alias("result"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in outcome[1:]])
    return found.unionByName(nothing), candidates


def spelling_match(locations: DataFrame, rows: DataFrame, vocabulary: DataFrame | None = None, filed: DataFrame | None = None) -> DataFrame:
    """(loc, score, candidate fields) by equality after correcting the spelling of the name, words glued together or torn apart included.

    For a whole phrase the best suggestion is taken even if it begins with another letter. ``vocabulary`` and ``filed`` are the tables that
    :func:`build_spelling` wrote; without them the words are counted and filed anew.
    """
    asked = locations.where(spelling.correction_allowed(F.col("m_name")))
    known = vocabulary if vocabulary is not None else spelling.vocabulary(rows, "m_name")
    # No digits are asked for, so a word with more digits than edits cannot be near.
    words = known.where(F.regexp_count("word", F.lit(r"\d")) <= spelling.MAX_DISTANCE)
    index = filed if filed is None else filed.where(F.regexp_count("word", F.lit(r"\d")) <= spelling.MAX_DISTANCE)
    fixed = spelling.correct_compound(asked.select("loc", F.col("m_name").alias("phrase")), words, keep="loc", filed=index)
    again = asked.join(fixed, "loc").where("corrected != m_name").withColumn("m_name", F.col("corrected")).drop("corrected", "cost")
    hits = match.exact_candidates(match.with_exact(again, rows), rows)
    return hits.withColumn("score", F.col("score") + match.SPELLING)


@dataclass
class Settled:
    """``rows``: the place rows with key, disposition, result, corrected text and place. ``keys``: one row per key, with
    its location and number of candidates. ``candidates``: the candidate rows of each location, for listings."""

    rows: DataFrame
    keys: DataFrame
    candidates: DataFrame


def settle(
    places: DataFrame, replacements: DataFrame, skips: DataFrame, rows: DataFrame, countries: DataFrame,
    fuzzy: bool = True, rules: Column | None = None, vocabulary: DataFrame | None = None, filed: DataFrame | None = None, spread: tuple[str, ...] = ("file", "rec", "pos"),
    pad_years: int = 0, **salting,
) -> Settled:
    """Settle every place row of ``places`` (place_text and whatever else it has).

    Work narrows step by step: rows to distinct texts, texts to distinct keys, keys to distinct locations, each counted
    with a map-side combine. The ways back up meet popular texts, so they are salted by counts already taken. A location is looked up
    once, as of the event year of the first place, by ``spread``, that asks for it.
    """
    texts = stage(match.distinct_texts(places, order=spread if "event_year" in places.columns else ()), "texts")
    status = lookup.apply_tables(match.distinct_keys(texts), replacements, skips)
    looked_up = F.col("repl_result").isNull() & ~F.col("skipped") & (F.col("key") != "")
    # Texts that are not looked up get a location of their own, so that they do not all join on null.
    parsed = stage(
        match.with_location(status, sample="sample").withColumn("looked_up", looked_up)
        .withColumn("loc", F.when(F.col("looked_up"), F.col("loc")).otherwise(F.concat(F.lit("="), "key"))), "keys"
    )
    found, candidates = resolve_locations(match.distinct_locations(parsed.where("looked_up")), rows, countries, fuzzy, vocabulary, filed, pad_years)
    resolved = salted_join(parsed, found.withColumnRenamed("n", "n_candidates"), ["loc"], spread=["key"], **salting)

    result = F.when(F.col("repl_result").isNotNull(), F.col("repl_result")).when(F.col("key") == "", "DELETE").when(F.col("skipped"), None).otherwise(F.col("result"))
    best = F.col("best")
    replaced = F.col("repl_result") == "STRONG_MATCH"
    place = lambda c: F.when(replaced, F.col(f"repl_{c}")).otherwise(best[c])
    fields = [f for f in CANDIDATE_FIELDS if f not in ("geoid", "first_year")]
    decided = resolved.select(
        "key", "n", result.alias("result"), "loc", "stage", "n_candidates",
        F.when(F.col("repl_result").isNotNull(), F.col("repl_prefix")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(F.col("repl_result").isNotNull(), F.col("repl_geoid")).otherwise(best["geoid"]).alias("geoid"),
        disposition.disposition(F.col("repl_result"), F.col("skipped"), result).alias("disposition"),
        F.struct(*[place(c).alias(c) for c in fields]).alias("place"),
    )
    name = gazetteer_name("place")
    if rules is not None:
        decided = decided.withColumn("_rules", rules)
        name = tx.apply_rules(name, F.col("_rules"))
    written = F.col("disposition").isin("REPLACE", "UPDATE")
    keys = stage(
        decided.withColumn("long_name", F.when(written, name))
        .withColumn("text", F.when(written, tx.output_text(F.col("prefix"), F.col("long_name")))).drop("_rules"), "settled_keys"
    )
    by_text = salted_join(texts.drop("n", "first"), keys.drop("n", "n_candidates", "loc", "stage"), ["key"], spread=["place_text"], how="inner", **salting)
    return Settled(salted_join(places, by_text, ["place_text"], spread=list(spread), counts=texts, **salting), keys, candidates)


def review_rows(settled: Settled, names: DataFrame | None = None, order: tuple[str, ...] = ("file", "rec", "pos")) -> DataFrame:
    """(key, occurrences, place_text, first occurrence's details, result, stage, candidates, action, save_allowed): what a
    reviewer works on. People are looked up in ``names`` for the queue only, not for all places."""
    details = [c for c in ("event_year", "record_id", "person", "event_name", "date") if c in settled.rows.columns]
    open_ = F.col("disposition").isin(*disposition.REVIEW)
    first = settled.rows.where(open_).groupBy("key").agg(
        F.count("*").alias("occurrences"), F.min(F.struct(*order, "place_text", *details)).alias("f")
    ).select("key", "occurrences", "f.*")
    if names is not None:
        first = people.with_person(first, names, spread=("key",))
    queue = first.join(settled.keys.where(open_).select("key", "result", "stage", "n_candidates"), "key")
    count, result = F.coalesce("n_candidates", F.lit(0)), F.col("result")
    return queue.select(
        "key", "occurrences", "place_text", *details, "result", "stage", count.alias("candidates"),
        disposition.review_action(result, count).alias("action"), disposition.save_allowed(result, count).alias("save_allowed"),
    )


def review_listing(settled: Settled, queue: DataFrame, rules: Column | None = None, pad_years: int = 0) -> DataFrame:
    """(key, rank, geoid, name, flag, score, feature): the candidates of each queued key, a row for each, all of them.

    Names not yet in use in the year of the event are flagged; a key without a candidate has one row that says so.
    """
    asked = stage(queue.select("key", "place_text", "event_year", "candidates").join(settled.keys.select("key", "loc"), "key"), "queued")
    offered = salted_join(settled.candidates, asked, ["loc"], spread=["geoid"], how="inner")
    city = F.when(F.col("tier") >= CITY, F.col("name")).otherwise("")
    name = tx.long_name(city, *[F.coalesce(F.col(n), F.lit("")) for n in ("admin2_name", "admin1_name", "country_name")])
    if rules is not None:
        offered = offered.withColumn("_rules", rules)
        name = tx.apply_rules(name, F.col("_rules"))
    flag = F.when(match.valid_year(F.col("event_year"), F.col("first_year"), pad_years), "").otherwise("VERIFY DATE")
    listed = match.ranked(offered.select("key", "geoid", name.alias("name"), flag.alias("flag"), "score", "feature"), by="key")
    nothing = asked.where("candidates = 0").select(
        "key", F.lit("").alias("geoid"), F.col("place_text").alias("name"), F.lit("").alias("flag"), F.lit(NO_MATCH_SCORE).alias("score"),
        F.lit("").alias("feature"), F.lit(1).alias("rank"))
    return listed.unionByName(nothing)


def hierarchy_places(settled: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Settled places (with seq and id) in the form the hierarchy is built from: ids and names of the matched place, the
    prefix of the text, a missing county filled in where the gazetteer knows but one."""
    city = F.when(F.col("place.tier") >= CITY, tx.normalize(F.col("place.name"))).otherwise("")
    title = F.concat(F.when(F.length("prefix") > 0, F.concat("prefix", F.lit(","))).otherwise(""), F.col("long_name"))
    named = ["admin2_id", "admin2_name", "admin1_id", "admin1_name", "country_iso", "country_name", "feature"]
    places = settled.select(
        "seq", "id", "prefix", city.alias("city"), *[F.coalesce(f"place.{c}", F.lit("")).alias(c) for c in named],
        "place.lat", "place.lon", title.alias("title"), F.lit("").alias("enclosed_by"),
    )
    return match.fill_admin2(places, match.searchable(gazetteer))


# --- jobs ------------------------------------------------------------------------------------------------------------


#: Countries that a list of files is cut down to; of more, all are read.
MOST_COUNTRIES = 1000


def of_asked_countries(gazetteer: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """The rows of the countries that ``places`` name, as a filter on ``country_iso`` that the reader prunes folders with.

    Everything is looked up within its country, so the other rows can't be found. All rows stay where the countries come without codes, or a
    place has a pattern as its country.
    """
    if "country_iso" not in countries.columns:
        return gazetteer
    last = places.select(F.substring_index("place_text", ",", -1).alias("part")).distinct()
    asked = stage(last.select(tx.normalize(F.col("part")).alias("n_country")).distinct(), "asked-countries")
    if not asked.where(F.contains("n_country", F.lit("*"))).isEmpty():
        return gazetteer
    codes = [r[0] for r in countries.join(asked, "n_country", "left_semi").select(F.lower("country_iso")).distinct().limit(MOST_COUNTRIES + 1).collect()]
    return gazetteer if len(codes) > MOST_COUNTRIES else gazetteer.where(F.col("country_iso").isin(sorted(codes)))


def _settle_with(places: DataFrame, gazetteer: DataFrame, tables: Tables) -> Settled:
    skips = tables.skips.select(tx.normalize(F.col("key")).alias("key"), "val")
    order = "seq" if "seq" in tables.replacements.columns else "key"
    replacements = lookup.resolve_replacements(lookup.rekey(tables.replacements, order), gazetteer)
    rows = stage(match.searchable(of_asked_countries(gazetteer, places, tables.countries), tables.validity), "searchable")
    words = tables.vocabulary if tables.vocabulary is not None else spelling.vocabulary(gazetteer, "norm")
    settled = settle(places, replacements, skips, rows, tables.countries, rules=rule_list(tables.rules), vocabulary=words, filed=tables.spelling_index, pad_years=tables.pad_years)
    return Settled(stage(settled.rows, "settled"), settled.keys, settled.candidates)


def resolve_gedcom(spark: SparkSession, paths: str | list[str], gazetteer: DataFrame, tables: Tables) -> dict[str, DataFrame]:
    """Corrected lines, statistics, review queue, diagnostics and misses of GEDCOM files."""
    lines = read_gedcom(spark, paths)
    settled = _settle_with(stage(context.places(lines), "places"), gazetteer, tables)
    names = stage(people.person_names(lines), "names")
    d = F.col("disposition")
    edits = settled.rows.where(d.isin(*disposition.MATCHED)).select(
        "file", "rec", "pos", F.when(d == "DELETE", "DELETE").otherwise("UPDATE").alias("action"), "text",
        F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"),
    )
    queue = review_rows(settled, names)
    return {
        "lines": rewrite.rewrite(lines, edits, numbered=True), "places": settled.rows,
        "stats": disposition.run_stats(settled.rows, context.place_count(lines)),
        "review": queue, "listing": review_listing(settled, queue, rule_list(tables.rules), tables.pad_years), "diagnostics": disposition.diagnostics(settled.rows),
        "misses": disposition.misses(settled.rows),
    }


def resolve_gramps(spark: SparkSession, paths: str | list[str], gazetteer: DataFrame, tables: Tables) -> dict[str, DataFrame]:
    """Corrected documents and place objects, the hierarchy of matched places and what is wrong in it, for Gramps XML files."""
    rows = read_rows(spark, paths)
    objects = stage(parse_placeobj(placeobj_fragments(rows)), "placeobj")
    found = objects.where("place_text IS NOT NULL").select(
        "file", F.lit(0).cast("long").alias("rec"), "pos", "place_text", F.lit(0).alias("event_year")
    )
    settled = _settle_with(found, gazetteer, tables)
    written = settled.rows.where(F.col("disposition").isin("REPLACE", "UPDATE"))
    corrected = objects.join(written.select("file", "pos", "text", "place"), ["file", "pos"], "left").select(
        "file", "pos", "handle", "change", "id", "type", "ptitle", "pname", "placerefs", "had_coord", "place_text", "fragment",
        "end", "closed", "lead", "tail", F.col("text").alias("new_text"), F.coalesce("place.lat", "lat").alias("lat"), F.coalesce("place.lon", "lon").alias("lon"),
    )
    numbered = objects.select("file", "pos", "id").join(written, ["file", "pos"]).withColumn("seq", F.struct("file", "pos"))
    tree = hierarchy.build_hierarchy(stage(hierarchy_places(numbered, gazetteer), "matched"), gazetteer)
    queue = review_rows(settled)
    return {
        "document": document(rows, stage(corrections(corrected), "spans")), "places": corrected, "hierarchy": tree, "violations": hierarchy.enclosure_violations(tree),
        "stats": disposition.run_stats(settled.rows, objects.groupBy("file").agg(F.count_if(F.col("place_text").isNotNull()).alias("places"))),
        "review": queue, "listing": review_listing(settled, queue, rule_list(tables.rules), tables.pad_years),
    }


def apply_decisions(replacements: DataFrame, skips: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a reviewer's decisions (seq, key, op, geoid, prefix) folded in."""
    return lookup.upsert_replacements(replacements, decisions), lookup.upsert_skips(skips, decisions)


def build_spelling(gazetteer: DataFrame, path: str) -> None:
    """Write the vocabulary at ``path``, and its deletion index, laid out by key, at ``path`` + ``-index``."""
    words = stage(spelling.vocabulary(gazetteer, "norm"), "vocabulary")
    words.write.mode("overwrite").parquet(path)
    spelling.index(words).repartitionByRange("key", "word").sortWithinPartitions("key", "word").write.mode("overwrite").parquet(f"{path}-index")


build_gazetteer = gaz_source.build_gazetteer
