"""Finding places in the gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import hierarchy_key
from placewright.functions.text import normalize, words
from placewright.operators.skew import TASK_PAIRS, dealt_out, salted_join, sized_join
from placewright.schemas import CANDIDATE_FIELDS, CITY, PREFIX
from placewright.workspace import stage

# Scores: lower is better. A stage's base, plus 10 per letter of edit distance, plus 5 per part that differs.
EXACT, WILDCARD, WORD, PARTIAL, SOUNDEX, SPELLING = 0.0, 20.0, 30.0, 35.0, 40.0, 50.0
PER_EDIT, PER_PART = 10.0, 5.0

LOCATION = ["m_tier", "n_country", "n_admin1", "n_admin2", "m_name"]
LOOSE = ["m_tier", "n_country", "n_admin1", "m_name"]


# --- texts and gazetteer rows in comparable form -------------------------------------------------------------------


def first_occurrence(places: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """(key, n, first_*): one row per distinct key with its row count and what its first occurrence says.

    Combined on the map side, so a key that fills a third of the rows costs one row per task in the shuffle.
    """
    return places.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, *keep)).alias("first")
    ).select("key", "n", *[F.col(f"first.{c}").alias(f"first_{c}") for c in (*order, *keep)])


def distinct_texts(places: DataFrame, text: str = "place_text", order: tuple[str, ...] = ()) -> DataFrame:
    """(place_text, n, key): the distinct texts with their row counts; only these are normalised, not the rows.

    With ``order``, also ``first``: what comes first by it, with its event year.
    """
    first = [F.min(F.struct(*order, "event_year")).alias("first")] if order else []
    return places.groupBy(F.col(text).alias("place_text")).agg(F.count("*").alias("n"), *first).withColumn("key", normalize(F.col("place_text")))


def distinct_keys(texts: DataFrame) -> DataFrame:
    """(key, n, sample): the distinct keys, their row counts and one text each, the least, to read the parts from; and ``first``, if known."""
    first = [F.min("first").alias("first")] if "first" in texts.columns else []
    return texts.groupBy("key").agg(F.sum("n").alias("n"), F.min("place_text").alias("sample"), *first)


def distinct_locations(parsed: DataFrame) -> DataFrame:
    """The distinct locations; with ``year``, the event year of the first place that asks for each, if that is known."""
    if "first" not in parsed.columns:
        return parsed.select("loc", *LOCATION).distinct()
    return parsed.groupBy("loc", *LOCATION).agg(F.min("first").alias("first")).select("loc", *LOCATION, F.coalesce("first.event_year", F.lit(0)).alias("year"))


def parse_place(df: DataFrame, text: str = "place_text") -> DataFrame:
    """Add prefix, city, admin2, admin1, country (trimmed) and tier, read from the end of a comma-separated text."""
    nth = lambda k: F.trim(F.coalesce(F.try_element_at("_parts", F.lit(-k)), F.lit("")))
    rest = F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - 4), ",")
    return (
        df.withColumn("_parts", F.split(text, ","))
        .withColumns({
            "country": nth(1), "admin1": nth(2), "admin2": nth(3), "city": nth(4),
            "prefix": F.when(F.size("_parts") > 4, F.trim(F.regexp_replace(rest, " *, *", ","))).otherwise(""),
        })
        .withColumn("tier", hierarchy_key.tier(*[F.col(c) for c in ("prefix", "city", "admin2", "admin1")]))
        .drop("_parts")
    )


def with_location(df: DataFrame, key: str = "key", sample: str = "place_text") -> DataFrame:
    """Add the parts that a lookup compares, ``loc`` (the same as one text), ``tier`` and ``prefix``.

    The parts of a normalised key are the normalised parts of its text, so nothing is normalised again. The prefix takes
    no part in a lookup, since a place inside a city is looked up as its city; it is read from ``sample``, a text with
    that key, for the sake of its spelling.
    """
    nth = lambda k: F.coalesce(F.try_element_at("_parts", F.lit(-k)), F.lit(""))
    inner = F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - 4), "")
    raw = F.split(sample, ",")
    spelt = F.array_join(F.slice(raw, F.lit(1), F.size(raw) - 4), ",")
    has_prefix = (F.size("_parts") > 4) & (inner != "")
    below = F.when(F.col("n_city") != "", CITY).when(F.col("n_admin2") != "", 2).when(F.col("n_admin1") != "", 1).otherwise(0)
    return (
        df.withColumn("_parts", F.split(key, ","))
        .withColumns({
            "n_country": nth(1), "n_admin1": nth(2), "n_admin2": nth(3), "n_city": nth(4),
            "prefix": F.when(has_prefix, F.trim(F.regexp_replace(spelt, " *, *", ","))).otherwise(""),
        })
        .withColumn("m_tier", below)
        .withColumns({
            "tier": F.when(F.col("prefix") != "", PREFIX).otherwise(F.col("m_tier")),
            "m_name": F.when(F.col("m_tier") == CITY, F.col("n_city")).when(F.col("m_tier") == 2, F.col("n_admin2"))
            .when(F.col("m_tier") == 1, F.col("n_admin1")).otherwise(F.col("n_country")),
        })
        .withColumn("loc", F.concat_ws("|", *LOCATION)).drop("_parts", "n_city")
    )


def searchable(gazetteer: DataFrame, validity: DataFrame | None = None) -> DataFrame:
    """Gazetteer rows with the compared parts and ``first_year``, the first year their admin1 name was in use."""
    if validity is None:
        dated = gazetteer.withColumn("first_year", F.lit(None).cast("int"))
    else:
        dated = gazetteer.join(validity, ["country_iso", "admin1_id"], "left")
    named = lambda c: normalize(F.coalesce(c, F.lit("")))
    return dated.select(
        *CANDIDATE_FIELDS, F.col("tier").alias("m_tier"), named("country_name").alias("n_country"),
        named("admin1_name").alias("n_admin1"), named("admin2_name").alias("n_admin2"), F.col("norm").alias("m_name"),
    )


def valid_year(event_year: Column, first_year: Column, pad_years: int = 0) -> Column:
    """True unless the event is known to be earlier than the name."""
    return F.coalesce((event_year == 0) | (event_year + pad_years >= first_year), F.lit(True))


# --- candidates ----------------------------------------------------------------------------------------------------


def _candidate(score: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), *CANDIDATE_FIELDS)


def key_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, best): how many rows there are under each key, and the one of least geoid.

    All rows of a key are alike to an equality lookup, so looking up is a join with one row per key. Both values are
    combined on the map side: a name that half the gazetteer bears costs one row per task, and no list of it is made.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_candidate(F.lit(EXACT))).alias("best"))


def key_summary_by_year(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, best, steps): as :func:`key_summary`, and the best for each first year there is under a key.

    A key has at most as many steps as years in which names came into use, however many rows bear it.
    """
    by_year = key_summary(rows, [*keys, "first_year"])
    return by_year.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.collect_list(F.struct("first_year", "best")).alias("steps"))


def as_of(best: Column, steps: Column, year: Column, pad_years: int = 0) -> Column:
    """The best among those whose names were in use in ``year``; without any, the best of all."""
    in_use = F.filter(steps, lambda s: valid_year(year, s["first_year"], pad_years))
    return F.coalesce(F.array_min(F.transform(in_use, lambda s: s["best"])), best)


def best_each(candidates: DataFrame) -> DataFrame:
    """(loc, score, candidate fields): each place once per location, with its best score."""
    best = candidates.groupBy("loc", "geoid").agg(F.min(_candidate(F.col("score"))).alias("cand"))
    return best.select("loc", "cand.*")


def summary(candidates: DataFrame, years: DataFrame | None = None, pad_years: int = 0, **salting) -> DataFrame:
    """(loc, n, best) of candidate rows: how many a location has, and the best by score, then geoid.

    With ``years`` (loc, year), of equal scores a name that was in use in that year comes before one that wasn't.
    """
    if years is None:
        return candidates.groupBy("loc").agg(F.count("*").alias("n"), F.min(_candidate(F.col("score"))).alias("best"))
    dated = salted_join(candidates, years.select("loc", "year"), ["loc"], spread=["geoid"], **salting)
    late = ~valid_year(F.col("year"), F.col("first_year"), pad_years)
    found = dated.groupBy("loc").agg(F.count("*").alias("n"), F.min(F.struct("score", late.alias("late"), _candidate(F.col("score")).alias("best"))).alias("least"))
    return found.select("loc", "n", "least.best")


def ranked(candidates: DataFrame, by: str = "loc") -> DataFrame:
    """Candidate rows with ``rank`` within their location, from 1, by score, then geoid; for listings only."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("score", "geoid")))


def rescored(best: Column, extra: Column) -> Column:
    return best.withField("score", best["score"] + extra)


# --- stages --------------------------------------------------------------------------------------------------------


def country_support(locations: DataFrame, countries: DataFrame) -> DataFrame:
    """Add ``support``: null when the country is supported, else NO_COUNTRY or NOT_SUPPORTED.

    ``countries`` is (n_country, supported) over all countries there are. It carries no hint: the planner broadcasts
    it once it has measured it to be small, and splits skewed partitions if it is not.
    """
    listed = countries.select("n_country", "supported").dropDuplicates(["n_country"])
    return locations.join(listed, "n_country", "left").withColumn(
        "support", F.when(F.col("supported").isNull(), "NO_COUNTRY").when(~F.col("supported"), "NOT_SUPPORTED")
    ).drop("supported")


def _cities(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("m_tier") == CITY)


def with_exact(locations: DataFrame, rows: DataFrame, pad_years: int = 0, **salting) -> DataFrame:
    """Add ``n``, ``best`` and ``lookup`` by equality of all parts ("full"), else of a city's name, admin1 and country ("city").

    The second is for cities with a wrong or missing admin2, and for texts of three parts, whose first may be a city as well
    as a county. A location that is settled by the first lookup takes a key of its own into the second. Where locations have a ``year``,
    the best is the best as of that year.
    """
    dated = "year" in locations.columns
    summed = key_summary_by_year if dated else key_summary
    full = summed(rows, LOCATION).withColumnsRenamed({"n": "_n_full", "best": "_full", "steps": "_full_steps"})
    loose = summed(_cities(rows), LOOSE[1:]).withColumnsRenamed({"n": "_n_loose", "best": "_loose", "m_name": "_name", "steps": "_loose_steps"})
    again = F.col("_full").isNull() & (F.col("m_tier") >= 2)
    tried = locations.join(full, LOCATION, "left").withColumn("_name", F.when(again, F.col("m_name")).otherwise(F.concat(F.lit("="), "loc")))
    key = [*LOOSE[1:3], "_name"]
    counts = locations.groupBy(*LOOSE[1:3], F.col("m_name").alias("_name")).agg(F.count("*").alias("n"))
    found = salted_join(tried, loose, key, spread=["loc"], counts=counts, **salting)
    best = lambda c: as_of(F.col(c), F.col(f"{c}_steps"), F.col("year"), pad_years) if dated else F.col(c)
    return found.select(
        *locations.columns, F.coalesce("_n_full", "_n_loose").alias("n"), F.coalesce(best("_full"), rescored(best("_loose"), F.lit(PER_PART))).alias("best"),
        F.when(F.col("_full").isNotNull(), "full").when(F.col("_loose").isNotNull(), "city").alias("lookup"),
    )


def exact_match(locations: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, n, best, lookup) of the locations that :func:`with_exact` finds."""
    return with_exact(locations, rows, **salting).where("best IS NOT NULL").select("loc", "n", "best", "lookup")


def exact_candidates(found: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields): all rows behind what :func:`with_exact` found, for a listing."""
    full = salted_join(rows, found.where("lookup = 'full'").select("loc", *LOCATION), LOCATION, spread=["geoid"], how="inner", **salting)
    loose = salted_join(
        _cities(rows), found.where("lookup = 'city'").select("loc", *LOOSE[1:]), LOOSE[1:], spread=["geoid"], how="inner", **salting)
    pick = lambda df, score: df.select("loc", F.lit(score).alias("score"), *CANDIDATE_FIELDS)
    return pick(full, EXACT).unionByName(pick(loose, PER_PART))


def exact_result(n: Column) -> Column:
    return F.when(n == 1, "STRONG_MATCH").when(n > 1, "MULTIPLE_MATCHES")


def wildcard_regex(pattern: Column) -> Column:
    """``*`` stands for any text; everything else is literal."""
    return F.concat(F.lit("^\\Q"), F.replace(pattern, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))


def like(part: str, pattern: str) -> Column:
    """Whether ``part`` is as ``pattern`` says. Only patterns with several ``*`` need a regular expression, which is compiled for each row."""
    text, asked = F.col(part), F.col(pattern)
    stars = F.length(asked) - F.length(F.replace(asked, F.lit("*"), F.lit("")))
    ends = F.startswith(text, F.substring_index(asked, "*", 1)) & F.endswith(text, F.substring_index(asked, "*", -1))
    return F.when(stars == 0, text == asked).when(stars == 1, ends & (F.length(text) >= F.length(asked) - 1)).otherwise(F.rlike(text, wildcard_regex(asked)))


def is_pattern(*parts: str) -> Column:
    """Whether any of these parts of a location holds a ``*``."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(part, F.lit("*"))
    return out


WILD_PARTS = ("n_country", "n_admin1", "m_name")


def _by_mask(mask: int) -> Column:
    """The parts of a location as one text: those without ``*`` first, so that as much as possible of it is literal."""
    order = sorted(range(len(WILD_PARTS)), key=lambda i: mask >> i & 1)
    return F.concat_ws("|", *[F.col(WILD_PARTS[i]) for i in order])


def also_as_cities(locations: DataFrame) -> DataFrame:
    """Locations, and those that end at a county once more as cities without one: the first of three parts may be either."""
    named = locations.select("loc", *LOCATION)
    return named.unionByName(named.where(F.col("m_tier") == 2).withColumns({"m_tier": F.lit(CITY), "n_admin2": F.lit("")}))


GRAM = 3
ANY = "*"
POSTING = ["m_tier", "g_country", "gram"]


def grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` characters in a name, or in the literal parts of a pattern; its two ends count as characters."""
    ended = F.concat(F.lit("^"), text, F.lit("$"))
    runs = F.transform(F.sequence(F.lit(1), F.length(ended) - GRAM + 1), lambda i: F.substring(ended, i, F.lit(GRAM)))
    return F.when(F.length(ended) >= GRAM, F.array_distinct(F.filter(runs, lambda g: ~F.contains(g, F.lit("*"))))).otherwise(F.array().cast("array<string>"))


#: Characters of a pattern's beginning or end that names are filed by, at most.
MOST_ENDS = 40
BEGINNING, END = "<", ">"


def pattern_keys(pattern: Column) -> Column:
    """What a name must hold to match: the pattern's grams, its literal beginning and its literal end, the latter two marked as such."""
    pieces = F.split(F.concat(F.lit("^"), pattern, F.lit("$")), r"\*")
    first, last = F.substring(F.get(pieces, F.lit(0)), 1, MOST_ENDS), F.right(F.element_at(pieces, -1), F.lit(MOST_ENDS))
    ends = [F.when(F.length(text) > GRAM, F.concat(F.lit(kind), text)) for kind, text in ((BEGINNING, first), (END, last))]
    return F.concat(grams(pattern), F.array_compact(F.array(*ends)))


def filings(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(m_tier, n_country, m_name, g_country, gram): the names under all their keys of the kinds and lengths that ``keys`` has, by country.

    A name is filed under ``ANY`` country, too, if one of ``keys`` is.
    """
    kind = F.when(F.length("gram") == GRAM, "").otherwise(F.left("gram", F.lit(1)))
    kinds = keys.agg(F.collect_set(F.struct(kind.alias("kind"), (F.length("gram") - 1).alias("length")))).scalar()
    anywhere = keys.agg(F.bool_or(F.col("g_country") == ANY)).scalar()
    ended = F.concat(F.lit("^"), F.col("m_name"), F.lit("$"))
    of = lambda kind: F.filter("_kinds", lambda k: (k["kind"] == kind) & (k["length"] <= F.length(ended)))
    runs = F.when(F.exists("_kinds", lambda k: k["kind"] == ""), grams(F.col("m_name"))).otherwise(F.array().cast("array<string>"))
    firsts = F.transform(of(BEGINNING), lambda k: F.concat(F.lit(BEGINNING), F.substring(ended, F.lit(1), k["length"])))
    lasts = F.transform(of(END), lambda k: F.concat(F.lit(END), F.right(ended, k["length"])))
    filed = names.withColumn("_kinds", kinds).select(*NAME, F.explode(F.concat(runs, firsts, lasts)).alias("gram"))
    return filed.select(*NAME, F.explode(F.when(anywhere, F.array("n_country", F.lit(ANY))).otherwise(F.array("n_country"))).alias("g_country"), "gram")


def postings(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(m_tier, n_country, m_name, g_country, gram): the names under the keys in ``asked``, each once under a key, however many patterns there are."""
    wanted = asked.select(*POSTING).distinct()
    return filings(names, wanted).join(wanted, POSTING, "left_semi")


def rarest_keys(asked: DataFrame, names: DataFrame, **salting) -> DataFrame:
    """(m_tier, p_country, p_name, g_country, gram): for each name asked for the key that the fewest names have; none if one of its keys has no name.

    ``asked`` is (m_tier, p_country, p_name, g_country, all, gram). Names are counted under their keys with a map-side combine; no list is made of them.
    """
    counts = filings(names, asked).groupBy(*POSTING).agg(F.count("*").alias("n"))
    wanted = asked.groupBy(*POSTING).agg(F.count("*").alias("_asked"))
    known = stage(counts.join(wanted, POSTING), "key-counts")
    held = salted_join(asked, known.drop("_asked"), POSTING, spread=["p_name"], how="inner", counts=known.select(*POSTING, F.col("_asked").alias("n")), **salting)
    return held.groupBy("m_tier", "p_country", "p_name", "g_country").agg(
        F.max(F.struct(-F.col("n"), "gram"))["gram"].alias("gram"), F.count("*").alias("held"), F.max("all").alias("all")).where("held = all").drop("held", "all")


def wildcard_match(locations: DataFrame, rows: DataFrame, task_pairs: int = TASK_PAIRS, **salting) -> DataFrame:
    """(loc, score, candidate fields) for locations with ``*`` in their name, admin1 or country.

    A pattern whose name holds three literal characters in a row, its ends included, is looked up by the rarest of its keys, such runs and its
    literal beginning and end, among the names of its country, or of all countries where that is a pattern too. Each pattern of a name is
    looked up once in a country, however many locations share it; these come in with the places, by their admin1 where it is none. All joins are dealt out by the
    pairs they make. The few others are tested by :func:`wildcard_by_lead`.
    """
    wild = stage(locations.where(is_pattern(*WILD_PARTS)).select("loc", *LOCATION, F.size(grams(F.col("m_name"))).alias("grams")), "patterns")
    places = wild.where("grams > 0").select("loc", "m_tier", F.col("n_country").alias("p_country"), F.col("n_admin1").alias("p_admin1"),
                                            F.col("n_admin2").alias("p_admin2"), F.col("m_name").alias("p_name"))
    country = F.when(F.contains("p_country", F.lit("*")), F.lit(ANY)).otherwise(F.col("p_country"))
    asked = places.select("m_tier", "p_country", "p_name").distinct().withColumn("keys", pattern_keys(F.col("p_name"))).select(
        "m_tier", "p_country", "p_name", country.alias("g_country"), F.size("keys").alias("all"), F.explode("keys").alias("gram"))
    asked = stage(asked, "asked-keys")
    names = dealt_out(stage(rows.select(*NAME).distinct(), "names"), NAME)
    rarest = stage(rarest_keys(asked, names, **salting), "rarest-keys")
    filed = stage(postings(names, rarest), "postings")
    found = sized_join(filed, rarest, POSTING, ["n_country", "m_name"], ["p_country", "p_name"], task_pairs)
    pairs = stage(found.where(like("m_name", "p_name") & like("n_country", "p_country")).select(*NAME, "p_country", "p_name"), "name-pairs")
    here = stage(sized_join(rows, pairs, NAME, ["geoid"], ["p_country", "p_name"], task_pairs), "pattern-places")
    by_name, pattern = ["m_tier", "p_country", "p_name"], F.contains("p_admin1", F.lit("*"))
    literal = places.where(~pattern).withColumnRenamed("p_admin1", "n_admin1")
    inside = sized_join(here, literal, [*by_name, "n_admin1"], ["geoid"], ["loc"], task_pairs)
    around = sized_join(here, places.where(pattern), by_name, ["geoid"], ["loc"], task_pairs).where(like("n_admin1", "p_admin1"))
    score = WILDCARD + F.when(like("n_admin2", "p_admin2"), 0.0).otherwise(PER_PART)
    hits = [df.select("loc", score.alias("score"), *CANDIDATE_FIELDS) for df in (inside, around)]
    return best_each(hits[0].unionByName(hits[1]).unionByName(wildcard_by_lead(wild.where("grams = 0").drop("grams"), rows, **salting)))


def wildcard_by_lead(wild: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields) for patterns without three literal characters in a row.

    Joined on the tier, on which parts hold a ``*``, and on the literal text before the first one, when the parts without
    ``*`` are put in front. So a pattern is tested only on places that agree with its literal parts and begin like the
    next. Places are keyed only by the kinds and lengths of patterns that there are.
    """
    masks = range(1, 1 << len(WILD_PARTS))
    mask = sum(F.contains(part, F.lit("*")).cast("int") * (1 << i) for i, part in enumerate(WILD_PARTS))
    text = F.coalesce(*[F.when(F.col("mask") == m, _by_mask(m)) for m in masks])
    patterns = wild.withColumn("mask", mask).select(
        "loc", "m_tier", "mask", F.regexp_extract(text, r"^([^*]*)", 1).alias("lead"), F.col("n_admin2").alias("p_admin2"),
        *[F.col(part).alias(f"p_{part}") for part in WILD_PARTS],
    )
    kinds = patterns.agg(F.collect_set(F.struct("mask", F.length("lead").alias("length")))).scalar()
    keyed = rows.withColumn("_kinds", kinds).withColumn("_texts", F.array(*[_by_mask(m) for m in masks])).withColumn("_keys", F.transform("_kinds", lambda k: F.struct(
        k["mask"].alias("mask"), F.substring(F.element_at("_texts", k["mask"]), F.lit(1), k["length"]).alias("lead"), k["length"].alias("length"))))
    leads = keyed.select(*rows.columns, F.inline(F.filter("_keys", lambda k: F.length(k["lead"]) == k["length"]))).drop("length")
    pairs = salted_join(leads, patterns, ["m_tier", "mask", "lead"], spread=["geoid"], how="inner", **salting)
    for part in WILD_PARTS:
        pairs = pairs.where(F.rlike(part, wildcard_regex(F.col(f"p_{part}"))))
    same_admin2 = F.rlike("n_admin2", wildcard_regex(F.col("p_admin2")))
    score = WILDCARD + F.when(same_admin2, 0.0).otherwise(PER_PART)
    return pairs.select("loc", score.alias("score"), *CANDIDATE_FIELDS)


NAME = ["m_tier", "n_country", "m_name"]


def names_asked(locations: DataFrame) -> DataFrame:
    """The distinct names that locations ask for in a country, which is what the fuzzy stages compare."""
    return locations.select(*NAME).distinct()


def attached(pairs: DataFrame, locations: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields) from (m_tier, n_country, m_name, found, score), pairs of a name asked for and one found.

    The places of a found name and the locations that ask for the other come in only now, with ``PER_PART`` for each part
    above the name that differs.
    """
    places = salted_join(
        rows.select("m_tier", "n_country", F.col("m_name").alias("found"), F.col("n_admin1").alias("g_admin1"), F.col("n_admin2").alias("g_admin2"), *CANDIDATE_FIELDS),
        pairs, ["m_tier", "n_country", "found"], spread=["geoid"], how="inner", **salting)
    full = salted_join(places, locations.select("loc", *LOCATION), NAME, spread=["geoid"], how="inner", **salting)
    differs = lambda part, tier: F.when((F.col("m_tier") >= tier) & (F.col(f"n_{part}") != F.col(f"g_{part}")), PER_PART).otherwise(0.0)
    score = F.col("score") + differs("admin1", 2) + differs("admin2", CITY)
    return best_each(full.select("loc", score.alias("score"), *CANDIDATE_FIELDS))


def soundex_match(locations: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields) of names that sound alike in the same country, scored by edit distance.

    Distinct names meet by sound and are scored; nothing is left out before that.
    """
    block = ["m_tier", "n_country", "sound"]
    asked = names_asked(locations).withColumn("sound", F.soundex("m_name"))
    known = rows.select("m_tier", "n_country", F.col("m_name").alias("found")).distinct().withColumn("sound", F.soundex("found"))
    pairs = salted_join(known, asked, block, spread=["found"], how="inner", **salting)
    score = SOUNDEX + PER_EDIT * F.levenshtein("found", "m_name")
    return attached(pairs.select(*NAME, "found", score.alias("score")), locations, rows, **salting)


WORD_BLOCK = ["m_tier", "n_country", "word"]


def _name_words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct names by word, and in how many of them each word occurs."""
    by_word = rows.select(*NAME).distinct().withColumn("words", words(F.col("m_name"))).select("*", F.explode("words").alias("word"))
    return by_word, by_word.groupBy(*WORD_BLOCK).agg(F.count("*").alias("n"))


def _entry_words(locations: DataFrame) -> DataFrame:
    entries = names_asked(locations).select("*", words(F.col("m_name")).alias("entry_words")).withColumnRenamed("m_name", "entry")
    return entries.select("*", F.explode("entry_words").alias("word"))


def word_match(locations: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields) of names that hold every word of the entry; a point per further word.

    Names are compared only where they hold the entry's rarest word, which loses none: a name that holds all words
    holds that one too. So common words are hardly ever joined on, and where one is, the names are spread by salt.
    """
    by_word, frequency = _name_words(rows)
    known = salted_join(_entry_words(locations), frequency, WORD_BLOCK, spread=["entry"], **salting)
    rarest = known.groupBy("entry", "m_tier", "n_country", "entry_words").agg(
        F.min(F.struct("n", "word")).alias("rare"), F.count_if(F.col("n").isNull()).alias("unknown")
    ).where("unknown = 0").select("entry", "m_tier", "n_country", "entry_words", F.col("rare.word").alias("word"))
    holding = salted_join(by_word, rarest, WORD_BLOCK, spread=["m_name"], how="inner", counts=frequency, **salting).where(
        F.size(F.array_except("entry_words", "words")) == 0
    )
    score = WORD + F.size("words") - F.size("entry_words")
    pairs = holding.select("m_tier", "n_country", F.col("m_name").alias("found"), F.col("entry").alias("m_name"), score.alias("score"))
    return attached(pairs, locations, rows, **salting)


def partial_match(locations: DataFrame, rows: DataFrame, **salting) -> DataFrame:
    """(loc, score, candidate fields) of names whose words the entry all holds; a point per word the name leaves out.

    The mirror image of :func:`word_match`: each distinct name is keyed by its own rarest word.
    """
    by_word, frequency = _name_words(rows)
    keyed = salted_join(by_word.select(*WORD_BLOCK, "m_name"), frequency, WORD_BLOCK, spread=["m_name"], **salting).groupBy(*NAME).agg(
        F.min(F.struct("n", "word"))["word"].alias("word")
    )
    held = salted_join(_entry_words(locations), keyed, WORD_BLOCK, spread=["entry"], how="inner", **salting).where(
        F.size(F.array_except(words(F.col("m_name")), "entry_words")) == 0
    )
    score = PARTIAL + F.size("entry_words") - F.size(words(F.col("m_name")))
    pairs = held.select("m_tier", "n_country", F.col("m_name").alias("found"), F.col("entry").alias("m_name"), score.alias("score"))
    return attached(pairs, locations, rows, **salting)


def fill_admin2(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Fill a blank admin2 id and name where all cities of that name in the admin1 agree on one.

    A place that stays without an id but has a county name keeps a blank as its id.
    """
    by_city = ["country_iso", "admin1_id", "city_norm"]
    agreed = (
        rows.where(F.col("m_tier") == CITY).where(F.trim(F.coalesce("admin2_id", F.lit(""))) != "")
        .groupBy("country_iso", "admin1_id", F.col("m_name").alias("city_norm"))
        .agg(F.min("admin2_id").alias("_low"), F.max("admin2_id").alias("_high"), F.min("admin2_name").alias("_name"))
        .where("_low = _high").select(*by_city, F.col("_low").alias("_id"), "_name")
    )
    blank = F.trim(F.coalesce("admin2_id", F.lit(""))) == ""
    named = F.trim(F.coalesce("admin2_name", F.lit(""))) != ""
    keyed = places.withColumn("city_norm", normalize(F.col("city")))
    return salted_join(keyed, agreed, by_city, spread=places.columns).select(
        *[c for c in places.columns if c not in ("admin2_id", "admin2_name")],
        F.when(blank, F.coalesce("_id", F.when(named, F.lit(" ")).otherwise(F.lit("")))).otherwise(F.col("admin2_id")).alias("admin2_id"),
        F.when(blank & F.col("_id").isNotNull(), F.col("_name")).otherwise(F.col("admin2_name")).alias("admin2_name"),
    )
