"""Lookups on the hand gazetteer and, for the fuzzy ones, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from placewright.operators import hierarchy, lookup, match, people, spelling
from placewright.plans import jobs
from placewright.schemas import RESULTS
from test_functions import osa

KEY_CASES = {
    "Dover,Kent,England,United Kingdom": "DOVER_G5_ENG_GB", "Kent,England,United Kingdom": "G5_ENG_GB", "England,United Kingdom": "ENG_GB",
    "United Kingdom": "GB", "Scotland,United Kingdom": "SCT_GB", "Dover,xyz,England,United Kingdom": "DOVER_G5_ENG_GB",
    "Dover, ,England,United Kingdom": "DOVER_G5_ENG_GB", "Marks Square,Dover,,England,United Kingdom": "MARKS SQUARE_DOVER_G5_ENG_GB",
    "St. Andrews,Charlotte County,new brunswick,Canada": "ST ANDREWS_1302_04_CA",
}


def place_rows(spark, texts, years=None):
    rows = [("f", 0, i, t, (years or {}).get(t, 0)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "file STRING, rec LONG, pos LONG, place_text STRING, event_year INT")
    return frame


def no_tables(spark, gazetteer):
    empty = spark.createDataFrame([], "key STRING, val STRING")
    return lookup.resolve_replacements(empty, gazetteer), empty


def settled(spark, gazetteer, countries, texts, years=None, validity=None, **kw):
    repl, skips = no_tables(spark, gazetteer)
    return jobs.settle(place_rows(spark, texts, years), repl, skips, match.searchable(gazetteer, validity), countries, **kw)


def test_keys_of_matched_places(spark, gazetteer, countries):
    got = settled(spark, gazetteer, countries, list(KEY_CASES)).rows
    places = jobs.hierarchy_places(got.withColumn("seq", F.col("pos")).withColumn("id", F.lit("")), gazetteer)
    keys = {r.seq: r.key for r in hierarchy.nodes(places).collect()}
    assert [keys[i] for i in range(len(KEY_CASES))] == list(KEY_CASES.values())


def test_result_classes(spark, gazetteer, countries):
    cases = {
        "Dover, Kent, England, United Kingdom": ("STRONG_MATCH", "UPDATE"), "Paris, , , France": ("NOT_SUPPORTED", "ASIS_REVIEW"),
        "Nowhere": ("NO_COUNTRY", "ASIS_REVIEW"), "Do*r, Kent, England, United Kingdom": ("WILDCARD_MATCH", "ASIS_REVIEW"),
        "Andrews, , New Brunswick, Canada": ("WORD_MATCH", "ASIS_REVIEW"), "Old Dover Town, Kent, England, United Kingdom": ("PARTIAL_MATCH", "ASIS_REVIEW"),
        "Dofer, Kent, England, United Kingdom": ("SOUNDEX_MATCH", "ASIS_REVIEW"), "Odver, Kent, England, United Kingdom": ("PARTIAL_MATCH", "ASIS_REVIEW"),
        "Dxover, Kent, England, United Kingdom": ("PARTIAL_MATCH", "ASIS_REVIEW"), "": ("DELETE", "ASIS_REVIEW"),
        "Atlantis, Kent, England, United Kingdom": ("NO_MATCH", "ASIS_REVIEW"), "*, *, England, United Kingdom": ("WILDCARD_MATCH", "ASIS_REVIEW"),
    }
    got = {r.place_text: (r.result, r.disposition) for r in settled(spark, gazetteer, countries, list(cases)).rows.collect()}
    assert got == cases
    assert {result for result, _ in got.values()} <= {*RESULTS}


def test_every_row_is_settled_under_salting(spark, gazetteer, countries):
    texts = ["Dover, Kent, England, United Kingdom"] * 400 + ["Kent, England, United Kingdom"] * 5 + ["?"] * 30
    got = settled(spark, gazetteer, countries, texts, fuzzy=False, hot_rows=50).rows
    counts = {r.disposition: r["count"] for r in got.groupBy("disposition").count().collect()}
    assert counts == {"UPDATE": 405, "ASIS_REVIEW": 30}


def test_review_rows(spark, gazetteer, countries):
    validity = spark.createDataFrame([("gb", "ENG", 1800)], "country_iso STRING, admin1_id STRING, first_year INT")
    texts = ["Do*r, Kent, England, United Kingdom", "Mars"]
    done = settled(spark, gazetteer, countries, texts, years={texts[0]: 1700}, validity=validity)
    queue = jobs.review_rows(done)
    got = {r.place_text: r for r in queue.collect()}
    listing = {r.key: r for r in jobs.review_listing(done, queue).collect()}
    one, offered = got[texts[0]], listing[got[texts[0]].key]
    assert (one.action, one.save_allowed, one.candidates, one.stage) == ("save", True, 1, "WILDCARD")
    assert (offered.rank, offered.flag, offered.name) == (1, "VERIFY DATE", "Dover, Kent, England, United Kingdom")
    none = got["Mars"]
    assert (none.action, none.save_allowed, listing["mars"].score) == ("verify", False, 9999.0)


def test_valid_year(spark):
    rows = [(0, 1800), (1700, 1800), (1700, None), (1795, 1800), (1800, 1800)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, y INT, f INT")
    for pad, want in ((0, [True, False, True, False, True]), (5, [True, False, True, True, True])):
        got = [r.v for r in frame.select("i", match.valid_year(F.col("y"), F.col("f"), pad).alias("v")).orderBy("i").collect()]
        assert got == want


@pytest.fixture(scope="module")
def synthetic(spark):
    """Many names from few words, so that blocks are crowded."""
    pick = random.Random(11)
    words = ["saint", "mary", "port", "new", "old", "town", "dover", "kent"]
    names = [" ".join(pick.sample(words, pick.randrange(1, 4))) for _ in range(300)]
    rows = [(f"s{i:04}", n, "PPL", "xx" if i % 3 else "yy", "Xland" if i % 3 else "Yland", "", "", "", "", 1.0, 2.0, n, 3) for i, n in enumerate(names)]
    gaz = spark.createDataFrame(rows, "geoid STRING, name STRING, feature STRING, country_iso STRING, country_name STRING, admin1_id STRING, admin1_name STRING, admin2_id STRING, admin2_name STRING, lat DOUBLE, lon DOUBLE, norm STRING, tier INT")
    return rows, match.searchable(gaz)


def located(spark, names):
    rows = [(f"3|xland|||{n}", 3, "xland", "", "", n) for n in names]
    return spark.createDataFrame(rows, "loc STRING, m_tier INT, n_country STRING, n_admin1 STRING, n_admin2 STRING, m_name STRING")


def found(frame):
    out = {}
    for r in frame.orderBy("score", "geoid").collect():
        out.setdefault(r.loc.rsplit("|", 1)[1], []).append((r.score, r.geoid))
    return out


def test_word_partial_and_wildcard_against_brute_force(spark, synthetic):
    rows, searchable = synthetic
    here = [(r[0], r[1]) for r in rows if r[4] == "Xland"]
    entries = ["saint", "mary saint", "port unknown", "new old town dover", "kent dover", "nothing", "town"]
    locs = located(spark, entries)
    by_word, by_part = {}, {}
    for e in entries:
        w = set(e.split())
        hold = sorted((30.0 + len(set(n.split())) - len(w), g) for g, n in here if w <= set(n.split()))
        part = sorted((35.0 + len(w) - len(set(n.split())), g) for g, n in here if set(n.split()) <= w)
        if hold:
            by_word[e] = hold
        if part:
            by_part[e] = part
    assert found(match.word_match(locs, searchable, hot_rows=10)) == by_word
    got = found(match.partial_match(locs, searchable, hot_rows=10))
    assert {e: got[e] for e in got} == by_part
    patterns = ["sa*", "*mary", "s*t m*", "*", "dover*", "a*", "p.rt*"]
    want = {}
    for p in patterns:
        rx = re.compile(".*".join(map(re.escape, p.split("*"))) + r"\Z")
        hits = sorted((20.0, g) for g, n in here if rx.match(n))
        if hits:
            want[p] = hits
    assert found(match.wildcard_match(located(spark, patterns), searchable, hot_rows=10)) == want


def test_spelling_against_brute_force(spark):
    pick = random.Random(2)
    vocab = {"".join(pick.choice("abc") for _ in range(pick.randrange(3, 7))): pick.randrange(1, 9) for _ in range(60)}
    terms = ["".join(pick.choice("abcd") for _ in range(pick.randrange(1, 8))) for _ in range(80)] + list(vocab)[:5] + ["a*b", "zzzzzz"]
    table = spark.createDataFrame(list(vocab.items()), "word STRING, freq LONG")
    got = {r.term: r.suggestion for r in spelling.suggest(spark.createDataFrame([(t,) for t in terms], "term STRING"), table).collect()}
    for t in set(terms):
        near = sorted((osa(t, w), -f, w) for w, f in vocab.items() if osa(t, w) <= 2) if len(t) > 1 and "*" not in t else []
        best = [w for d, _, w in near if d == near[0][0]][:4]
        want = t if not near else (" ".join(w for w in best if w[0] == t[0]) or None)
        assert got[t] == want, t


def test_tables_fold_decisions(spark):
    base = spark.createDataFrame([("dover", "@g5@old"), ("kent", "@g4@"), ("gone", "@g1@")], "key STRING, val STRING")
    rows = [(1, "Dover", "prefix", "", "new"), (2, "Mars", "prefix", "", "x"), (3, "Kent ", "delete", "", ""), (4, "gone", "delete", "", ""),
            (5, "gone", "save", "g2", "p"), (6, "Skip me", "skip", "", ""), (7, "later", "prefix", "", "q"), (8, "later", "save", "g3", "")]
    decisions = spark.createDataFrame(rows, "seq LONG, key STRING, op STRING, geoid STRING, prefix STRING")
    repl, skips = jobs.apply_decisions(base, base.where("false"), decisions)
    assert {r.key: r.val for r in repl.collect()} == {"dover": "@g5@new", "kent": "@@", "gone": "@g2@p", "later": "@g3@"}
    assert {r.key: r.val for r in skips.collect()} == {"skip me": " "}
    assert {r.key for r in lookup.delete_keys(repl, skips.unionByName(repl.where("key = 'kent'"))).collect()} == {"dover", "gone", "later"}


def test_replacement_results(spark, gazetteer):
    table = spark.createDataFrame([("a", "@g5@church"), ("b", "@@"), ("c", "@nope@"), ("d", ""), ("e", "junk")], "key STRING, val STRING")
    resolved = lookup.resolve_replacements(table, gazetteer)
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key STRING")
    skips = spark.createDataFrame([("a", " "), ("f", " ")], "key STRING, val STRING")
    got = {r.key: (r.repl_result, r.skipped) for r in lookup.apply_tables(keys, resolved, skips).collect()}
    assert got == {"a": ("STRONG_MATCH", False), "b": ("DELETE", False), "c": ("ERROR", False), "d": (None, False), "e": ("DELETE", False), "f": (None, True)}
    listing = {r.key: r.line for r in lookup.replacement_listing(resolved).collect()}
    assert listing == {"a": "[church],Dover, Kent, England, United Kingdom", "c": "Database error for GeoID nope"}


def test_fuzzy_joins_have_no_cross_product(spark, synthetic):
    """Each lookup joins on a key; none falls back to a nested loop."""
    _, searchable = synthetic
    locs = located(spark, ["saint mary", "port*"])
    for frame in (match.word_match(locs, searchable), match.partial_match(locs, searchable), match.wildcard_match(locs, searchable),
                  match.soundex_match(locs, searchable), match.exact_match(locs, searchable)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def same_names(spark, names):
    rows = [(f"s{i:04}", n, "PPL", "xx", "Xland", "", "", "", "", 1.0, 2.0, n, 3) for i, n in enumerate(names)]
    gaz = spark.createDataFrame(rows, "geoid STRING, name STRING, feature STRING, country_iso STRING, country_name STRING, admin1_id STRING, admin1_name STRING, admin2_id STRING, admin2_name STRING, lat DOUBLE, lon DOUBLE, norm STRING, tier INT")
    return match.searchable(gaz)


def test_lookups_count_and_list_every_candidate(spark):
    rows = same_names(spark, ["dover"] * 400)
    found_ = match.with_exact(located(spark, ["dover"]), rows)
    first = found_.first()
    assert (first.n, first.best.geoid, first.lookup) == (400, "s0000", "full")
    assert match.exact_candidates(found_, rows).count() == 400


def test_the_right_name_is_found_among_many_that_sound_alike(spark):
    rows = same_names(spark, [f"dofer{'e' * (i % 20)}{'i' * (i // 20)}" for i in range(200)] + ["dover"])
    hits = match.soundex_match(located(spark, ["dovver"]), rows)
    assert hits.count() == 201
    assert match.summary(hits).first().best.name == "dover"


def test_differing_parts_cost_points(spark, gazetteer):
    rows = match.searchable(gazetteer)
    place = [("a", 3, "united kingdom", "england", "kent", "dofer"), ("b", 3, "united kingdom", "scotland", "fife", "dofer")]
    locs = spark.createDataFrame(place, "loc STRING, m_tier INT, n_country STRING, n_admin1 STRING, n_admin2 STRING, m_name STRING")
    got = {r.loc: r.score for r in match.soundex_match(locs, rows).collect()}
    assert got == {"a": 50.0, "b": 60.0}


def test_a_city_without_its_county(spark, gazetteer, countries):
    got = settled(spark, gazetteer, countries, ["Dover, England, United Kingdom"], fuzzy=False).rows.first()
    assert (got.result, got.text) == ("STRONG_MATCH", "Dover, Kent, England, United Kingdom")


@pytest.mark.parametrize("pattern, hit", [("Eng*,United Kingdom", "g2"), ("Unit*", "g1"), ("Dov*,Kent,Engl*,United Kingdom", "g5"), ("Dover,K*t,*land,Un*", "g5")])
def test_wildcards_in_every_part(spark, gazetteer, pattern, hit):
    from placewright.functions.text import normalize

    locs = match.with_location(spark.createDataFrame([(pattern,)], "place_text STRING").withColumn("key", normalize(F.col("place_text"))))
    assert [r.geoid for r in match.wildcard_match(locs.select("loc", *match.LOCATION), match.searchable(gazetteer)).collect()] == [hit]


def test_spelling_reads_the_built_vocabulary_and_index(spark, gazetteer, countries, tmp_path):
    jobs.build_spelling(gazetteer, str(tmp_path / "words"))
    words, filed = spark.read.parquet(str(tmp_path / "words")), spark.read.parquet(str(tmp_path / "words-index"))
    locs = match.with_location(spark.createDataFrame([("dxover,kent,england,united kingdom",), ("do ver,kent,england,united kingdom",)], "place_text STRING").withColumn("key", F.col("place_text")))
    asked, rows = locs.select("loc", *match.LOCATION), match.searchable(gazetteer)
    for index in (None, filed):
        assert [r.geoid for r in jobs.spelling_match(asked, rows, words, index).collect()] == ["g5", "g5"]
    assert jobs.spelling_match(asked, rows, words.where("word != 'dover'")).count() == 0
    assert jobs.spelling_match(asked, rows, words.where("word != 'dover'"), filed.where("word != 'dover'")).count() == 0
    keys = filed.groupBy("word").count().collect()
    assert len(keys) == words.count() and max(r["count"] for r in keys) <= 29


def test_a_key_that_very_many_words_share_is_cut_into_parts(spark):
    vocab = spark.createDataFrame([(f"a{c}{d}", 1) for c in "bcdefghij" for d in "bcdefghijklmnopqrstuvwxyz"], "word STRING, freq LONG")
    terms = spark.createDataFrame([("axq",), ("bb",)], "term STRING")
    plain = sorted(map(str, spelling.ranked_suggestions(terms, vocab).collect()))
    spread = spelling.ranked_suggestions(terms, vocab, hot_rows=20)
    assert sorted(map(str, spread.collect())) == plain
    assert "_salt" in spread._jdf.queryExecution().analyzed().toString()


COMPOUND = {
    "newyork": ("new york", 1), "do ver": ("dover", 1), "new york": ("new york", 0), "nwe yrok": ("new york", 2), "doverr castel": ("dover castle", 2), "dovercastle": ("dover castle", 1),
    "new yorkdover": ("new york dover", 1), "qqqqqqqq": ("qqqqqqqq", 3), "": ("", 0), "n ew york": ("new york", 1), "dvoercastle": ("dover castle", 2), "  dover  ": ("dover", 0), "a": ("a", 3),
}


def test_compound_spelling(spark):
    vocab = spark.createDataFrame([("new", 50), ("york", 40), ("dover", 30), ("castle", 20)], "word STRING, freq LONG")
    phrases = spark.createDataFrame([(p, p) for p in COMPOUND], "id STRING, phrase STRING")
    got = {r.id: (r.corrected, r.cost) for r in spelling.correct_compound(phrases, vocab).collect()}
    assert got == {p: v for p, v in COMPOUND.items() if p}  # no words, no row


def test_compound_spelling_against_every_cut(spark):
    pick = random.Random(4)
    vocab = {"".join(pick.choice("abcd") for _ in range(pick.randrange(3, 6))): pick.randrange(1, 9) for _ in range(25)}
    phrases = [" ".join("".join(pick.choice("abcd") for _ in range(pick.randrange(1, 8))) for _ in range(pick.randrange(1, 5))) for _ in range(40)]
    phrases += [" ".join(pick.sample(list(vocab), 2)).replace(" ", "") for _ in range(10)]

    def best(term):
        near = [(osa(term, w), -f, w) for w, f in vocab.items() if osa(term, w) <= 2] if len(term) > 1 else []
        return min(near) if near else None

    def unit(w):
        options = [(3, 0, w)] + ([best(w)] if best(w) else [])
        if not best(w) or best(w)[0]:
            for k in range(1, len(w)):
                x, y = best(w[:k]), best(w[k:])
                if x and y:
                    options.append((1 + x[0] + y[0], x[1] + y[1], f"{x[2]} {y[2]}"))
        return min(options)

    def cuts(ws):
        if not ws:
            yield 0, 0, ""
        for n in (1, 2):
            if len(ws) >= n:
                own = unit(ws[0]) if n == 1 else best(ws[0] + ws[1]) and (1 + best(ws[0] + ws[1])[0], *best(ws[0] + ws[1])[1:])
                for rest in cuts(ws[n:]) if own else ():
                    yield own[0] + rest[0], own[1] + rest[1], (own[2] + " " + rest[2]).strip()

    got = {r.id: (r.cost, r.corrected) for r in spelling.correct_compound(spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "id INT, phrase STRING"),
                                                                          spark.createDataFrame(list(vocab.items()), "word STRING, freq LONG"), hot_rows=15).collect()}
    for i, p in enumerate(phrases):
        cheapest = min(cuts(p.split()))
        assert got[i][0] == cheapest[0]
        assert got[i][1] in {c[2] for c in cuts(p.split()) if c[:2] == cheapest[:2]}


def test_three_part_texts_are_tried_as_cities_by_every_stage(spark, gazetteer, countries):
    cases = {
        "Dov*,England,United Kingdom": "WILDCARD", "Kent Dover,England,United Kingdom": "PARTIAL", "Dofer,England,United Kingdom": "SOUNDEX", "Dxover,England,United Kingdom": "SPELLING",
        "Andrews,New Brunswick,Canada": "WORD", "K*t,England,United Kingdom": "WILDCARD",
    }
    out = settled(spark, gazetteer, countries, list(cases))
    stages = {r.key: r.stage for r in out.keys.collect()}
    geoids = {r.place_text: r.geoid for r in out.rows.collect()}
    assert {t: stages[t.lower()] for t in cases} == cases | {"Kent Dover,England,United Kingdom": "PARTIAL"}
    assert geoids == {t: "g6" if "Andrews" in t else "g4" if t.startswith("K") else "g5" for t in cases}


def test_wildcards_are_looked_up_by_their_rarest_gram(spark, monkeypatch):
    names = [f"saint mary {i}" for i in range(300)] + ["saint xylophone", "dover", "old dover"]
    rows = same_names(spark, names)
    seen = []
    plain = match.postings
    monkeypatch.setattr(match, "postings", lambda *a: seen.append(plain(*a)) or seen[-1])
    few = ["saint x*", "*ver"]
    many = few + ["d*r", "do*", "dov*", "dove*", "s* xylo*", "sa*xylophone", "*xylophone", "*lophon*"]

    def hits(patterns):
        got = match.wildcard_match(located(spark, patterns), rows, hot_rows=20).collect()
        by = {}
        for r in got:
            by.setdefault(r.loc.rsplit("|", 1)[1], []).append(r.name)
        return {k: sorted(v) for k, v in by.items()}

    assert hits(few) == {"saint x*": ["saint xylophone"], "*ver": ["dover", "old dover"]}
    found_ = hits(many)
    assert found_["s* xylo*"] == found_["*lophon*"] == ["saint xylophone"] and found_["do*"] == ["dover"] and found_["d*r"] == ["dover"]
    # A name is filed once under a gram that is asked for, whatever the number of patterns and the lengths of what they begin with.
    for filed in seen:
        assert filed.count() == filed.distinct().count()
    assert seen[1].where("gram = 'ver'").count() == seen[0].where("gram = 'ver'").count() == 2
    assert seen[1].select("gram").distinct().count() <= len("".join(many)) + 2 * len(many)


def test_a_leading_star_on_a_hot_country(spark):
    rows = same_names(spark, [f"place {i}" for i in range(500)] + ["dover"])
    got = match.wildcard_match(located(spark, ["*9", "*", "*over"]), rows, hot_rows=10)
    counts = {}
    for r in got.collect():
        counts[r.loc.rsplit("|", 1)[1]] = counts.get(r.loc.rsplit("|", 1)[1], 0) + 1
    assert counts == {"*9": 50, "*": 501, "*over": 1}


@pytest.mark.parametrize("year, geoid", [(0, "a"), (1700, "a"), (1850, "b"), (1890, "b"), (1900, "a")])
def test_names_in_use_in_the_year_come_first(spark, year, geoid):
    hits = spark.createDataFrame([("x", 5.0, g, "n", 1.0, 2.0, *["t"] * 1, 3, *["t"] * 6, first) for g, first in (("a", 1900), ("b", 1800))] + [("x", 9.0, "c", "n", 1.0, 2.0, "t", 3, *["t"] * 6, 1)],
                                 "loc STRING, score DOUBLE, geoid STRING, name STRING, lat DOUBLE, lon DOUBLE, feature STRING, tier INT, country_iso STRING, country_name STRING, admin1_id STRING, admin1_name STRING, admin2_id STRING, admin2_name STRING, first_year INT")
    row = match.summary(hits, spark.createDataFrame([("x", year)], "loc STRING, year INT")).first()
    assert (row.n, row.best.geoid, row.best.score) == (3, geoid, 5.0)


@pytest.mark.parametrize("year, geoid", [(1850, "b")])
def test_the_year_reaches_every_stage(spark, countries, year, geoid):
    """Two of one name, the lesser geoid in use from 1900, the other from 1800; before that neither is."""
    rows = [(g, "Dover", "PPL", "gb", "United Kingdom", "ENG", "England", county, "Kent", 1.0, 2.0, "dover", 3, first) for g, county, first in (("a", "K1", 1900), ("b", "K2", 1800))]
    gaz = spark.createDataFrame(rows, "geoid STRING, name STRING, feature STRING, country_iso STRING, country_name STRING, admin1_id STRING, admin1_name STRING, admin2_id STRING, admin2_name STRING, lat DOUBLE, lon DOUBLE, norm STRING, tier INT, first_year INT")
    searchable = match.searchable(gaz.drop("first_year")).drop("first_year").join(gaz.select("geoid", "first_year"), "geoid")
    texts = ["Dover,Kent,England,United Kingdom", "Dover,Essex,England,United Kingdom", "Dov*,Kent,England,United Kingdom", "Old Dover,Kent,England,United Kingdom", "Dofer,Kent,England,United Kingdom"]
    repl, skips = no_tables(spark, gaz)
    later = [("g", 0, i, t, 1 if year == 0 else 0 if i % 2 else 2000) for i, t in enumerate(texts)]  # what comes after the first doesn't matter
    places = place_rows(spark, texts, dict.fromkeys(texts, year)).unionByName(spark.createDataFrame(later, "file STRING, rec LONG, pos LONG, place_text STRING, event_year INT"))
    out = jobs.settle(places, repl, skips, searchable, countries)
    assert {r.stage for r in out.keys.collect()} == {"EXACT", "WILDCARD", "PARTIAL", "SOUNDEX"}
    assert {r.geoid for r in out.keys.collect()} == {geoid}


def test_files_of_countries_that_nobody_asks_for_are_not_read(spark, gazetteer, countries, tmp_path):
    path = str(tmp_path / "gaz")
    gazetteer.write.partitionBy("country_iso").parquet(path)
    stored = spark.read.schema(gazetteer.schema).parquet(path)
    for part in (tmp_path / "gaz" / "country_iso=ca").glob("part-*"):
        part.write_bytes(b"not a table")
        (part.parent / f".{part.name}.crc").unlink()
    coded = countries.withColumn("country_iso", F.when(F.col("n_country") == "canada", "CA").when(F.col("n_country") == "france", "FR").otherwise("GB"))
    here = place_rows(spark, ["Dover, Kent, England,  united KINGDOM", "Nowhere", "Paris, France", ""])
    assert {r.geoid for r in jobs.of_asked_countries(stored, here, coded).collect()} == {f"g{i}" for i in range(1, 6)}
    for texts in (["St. Andrews, Canada"], ["Dover, Un*"]):
        with pytest.raises(Exception, match="(?i)parquet"):
            jobs.of_asked_countries(stored, place_rows(spark, texts), coded).collect()
    assert jobs.of_asked_countries(stored, here, countries) is stored
    assert jobs.of_asked_countries(stored, place_rows(spark, ["Nowhere"]), coded).count() == 0


def test_pointers_that_lead_to_one_id_are_spread(spark):
    from placewright.operators import people

    names = [("f", "@I1@", "Ann /Lee/")] + [("f", f"@F{i}@", "@I1@" if i % 2 else f"@F{i + 1}@") for i in range(200)] + [("f", "@X@", "@none@")]
    frame = spark.createDataFrame(names, "file STRING, id STRING, name STRING")
    got = {r.id: r.name for r in people.resolve_pointers(frame, hot_rows=10).collect()}
    assert got == {"@I1@": "Ann /Lee/", "@X@": None} | {f"@F{i}@": "Ann /Lee/" for i in range(200)}


def test_long_literal_ends_of_patterns_narrow_the_names_down(spark):
    names = [f"place#{i:05d}" for i in range(2000)]
    rows = spark.createDataFrame([(f"g{i:05d}", n, "x", s, "") for i, n in enumerate(names) for s in ("east", "west")], "geoid STRING, m_name STRING, n_country STRING, n_admin1 STRING, n_admin2 STRING")
    rows = rows.withColumn("m_tier", F.lit(3)).select("*", *[F.lit(None).cast("string").alias(c) for c in match.CANDIDATE_FIELDS if c != "geoid"])
    locs = spark.createDataFrame([(f"{p}|{a}", 3, "x", a, "", p) for p in ("place#0012*", "*1234", "pl*7*99") for a in ("east", "*st")], "loc STRING, m_tier INT, n_country STRING, n_admin1 STRING, n_admin2 STRING, m_name STRING")
    asked = locs.select("m_tier", F.col("n_country").alias("p_country"), F.col("m_name").alias("p_name")).distinct().withColumn("keys", match.pattern_keys(F.col("p_name")))
    asked = asked.select("m_tier", "p_country", "p_name", F.col("p_country").alias("g_country"), F.size("keys").alias("all"), F.explode("keys").alias("gram"))
    kept = {r.p_name: r.gram for r in match.rarest_keys(asked, rows.select(*match.NAME).distinct()).collect()}
    assert kept["place#0012*"] == "<^place#0012" and kept["*1234"] == ">1234$"  # 10 names and 1; runs of three have more
    want = sorted((loc.loc, r.geoid) for loc in locs.collect() for r in rows.collect() if re.fullmatch(loc.m_name.replace("*", ".*"), r.m_name) and re.fullmatch(loc.n_admin1.replace("*", ".*"), r.n_admin1))
    for limit in (20, 1 << 20):
        got = match.wildcard_match(locs, rows, task_pairs=limit).collect()
        assert sorted({(r.loc, r.geoid) for r in got}) == sorted(set(want))


def test_patterns_with_one_star_need_no_regular_expression(spark):
    parts, patterns = ["aba", "ab", "a", "", "a.b", "xaby"], ["a*a", "*", "*b", "a*", "ab", "a*b*", "*a*", "a.*"]
    both = spark.createDataFrame([(t, p) for t in parts for p in patterns], "t STRING, p STRING")
    for r in both.select("t", "p", match.like("t", "p").alias("found")).collect():
        assert r.found == bool(re.fullmatch(re.escape(r.p).replace(r"\*", ".*"), r.t)), r


def test_places_are_worked_out_once_for_their_people(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def record(i):
        worked.add(1)
        return f"@I{i}@"

    names = spark.createDataFrame([("f", "@I1@", "Ann /Lee/")], "file STRING, id STRING, name STRING")
    rows = spark.createDataFrame([("f", i % 3, i) for i in range(30)], "file STRING, rec LONG, pos LONG")
    got = people.with_person(rows.select("*", record("rec").alias("record_id"), F.lit("nobody").alias("person")), names, hot_rows=3).collect()
    assert sorted({(r.rec, r.person) for r in got}) == [(0, "nobody"), (1, "Ann Lee"), (2, "nobody")] and len(got) == 30
    assert worked.value == 30
