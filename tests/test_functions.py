import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placewright.functions import coordinates, dates, hierarchy_key, replacement, spelling, text
from placewright.sources.gedcom import parse


def column(spark, values, fn, kind="STRING"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in frame.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_line_parse(spark):
    raws = ["0 @I1@ INDI", "1 BIRT", "2 PLAC Dover, Kent\\", "garbage", "2 PLAC", "1 NOTE  two  blanks ", "1 @X@", " 1 BIRT", "2 PLAC a b", "1 BIRT\r", ""]
    lines = spark.createDataFrame([("f", 0, i, r) for i, r in enumerate(raws)], "file STRING, rec LONG, pos LONG, raw STRING")
    got = [(r.level, r.label, r.tag, r.value) for r in parse(lines).orderBy("pos").collect()]
    assert got == [
        (0, "@I1@", "INDI", ""), (1, None, "BIRT", ""), (2, None, "PLAC", "Dover, Kent"), (99, "", "", ""), (2, None, "PLAC", ""),
        (1, None, "NOTE", "two  blanks "), (1, None, "@X@", ""), (99, "", "", ""), (2, None, "PLAC", "a b"), (1, None, "BIRT", ""), (99, "", "", ""),
    ]


def test_event_year(spark):
    cases = {
        "3 JAN 1850": (1850, False), "ABT 3 JAN 1850": (1850, True), "JAN 1850": (1850, False), "12 1850": (1850, False),
        "ABT 850": (850, True), "12345": (1234, False), "1850-1860": (1850, False), "BEF 1850": (0, False), "abt 1850": (0, False),
        "BET 1800 AND 1810": (0, False), "FROM 1900": (0, False), "1/2/1850": (0, False), "": (0, False),
    }
    years = column(spark, list(cases), dates.event_year)
    abouts = column(spark, list(cases), dates.is_about)
    assert dict(zip(cases, zip(years, abouts))) == cases


def test_replacement_entries(spark):
    cases = {"@123@St Mary": ("St Mary", "123"), "@123@": ("", "123"), "@@": ("", ""), "@123": ("", "123"), "junk": ("", "")}
    got = zip(column(spark, list(cases), replacement.entry_prefix), column(spark, list(cases), replacement.entry_geoid))
    assert dict(zip(cases, got)) == cases
    assert column(spark, ["7"], lambda c: replacement.build_entry(c, F.lit("x"))) == ["@7@x"]


def test_capwords(spark):
    cases = {"o'neil's": "O'Neil's", "D'ARCY's 2nd": "D'Arcy's 2Nd", "ab'c'd": "Ab'c'D", "st. andrews-by-the-sea": "St. Andrews-By-The-Sea", "": "", "straße ÉTÉ": "Straße Été"}
    assert dict(zip(cases, column(spark, list(cases), text.capwords))) == cases
    assert column(spark, [None], text.capwords) == [None]


def test_normalize(spark):
    cases = {"St. Andrews": "st andrews", " Dover ,  KENT , ,England": "dover,kent,,england", "Île-de-France": "ile-de-france", "a;b  (c)": "a b c", "Do*er": "do*er", "St James's": "st jamess"}
    assert dict(zip(cases, column(spark, list(cases), text.normalize))) == cases
    assert column(spark, ["Dover, Kent"], lambda c: text.normalize(c, remove_commas=True)) == ["dover kent"]


def test_every_letter_gives_one_key_in_both_forms(spark):
    import sys
    import unicodedata

    forms = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0x80, sys.maxunicode)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFD", c) != c}
    assert len(forms) > 12_000 and "각" in forms and "ế" in forms and "が" in forms
    apart = [c for c, one, other in zip(forms, column(spark, [f"a{c} b" for c in forms], text.normalize), column(spark, [f"a{d} b" for d in forms.values()], text.normalize)) if one != other]
    assert not apart, apart[:20]


def test_normalize_is_idempotent(spark):
    pick = random.Random(5)
    values = ["".join(pick.choice(string.printable + "éüßñ,,  ") for _ in range(20)) for _ in range(500)]
    once = column(spark, values, text.normalize)
    assert column(spark, once, text.normalize) == once


def test_output_text_uses_its_own_prefix(spark):
    assert column(spark, ["st mary", "", ", x"], lambda c: text.output_text(c, F.lit("Dover, Kent"))) == ["St Mary,Dover, Kent", "Dover, Kent", "X,Dover, Kent"]


def test_rules_run_in_order(spark):
    frame = spark.createDataFrame([("ab ab", [(0, "ab", "b"), (1, "b", "c"), (2, "", "z")])], "t STRING, r ARRAY<STRUCT<seq: INT, orig: STRING, repl: STRING>>")
    assert frame.select(text.apply_rules(F.col("t"), F.col("r"))).first()[0] == "c c"


def test_parts_from_end(spark):
    values = ["p,c,a2,a1,cc", "c,a2,a1,cc", "a1,cc"]
    assert column(spark, values, text.city_part) == ["c", "c", None]
    assert column(spark, values, text.prefix_part) == ["p", None, None]


def test_coordinates(spark):
    values = [-65.35255, 51.13, float("nan"), None, 0.00005, 2.0]
    assert column(spark, values, coordinates.four_decimals, "DOUBLE") == ["-65.3525", "51.1300", None, None, "0.0001", "2.0000"]
    assert column(spark, [0.0005, 1.5, -0.00001234, 100.0], coordinates.plain, "DOUBLE") == ["0.0005", "1.5", "-0.00001234", "100.0"]
    assert column(spark, [99.9, 1.0, float("nan")], coordinates.unset_to_null, "DOUBLE") == [None, 1.0, None]


def test_key_parts(spark):
    rows = [("Marks Square", "dover", "G5", "ENG", "gb"), ("", "dover", " ", "ENG", "gb"), ("", "", "", "", "gb"), ("", "", "G5", "ENG", "gb")]
    frame = spark.createDataFrame(rows, "prefix STRING, city STRING, a2 STRING, a1 STRING, iso STRING")
    p = [F.col(c) for c in ("prefix", "city", "a2", "a1")]
    tier = hierarchy_key.tier(*p)
    got = frame.select(tier.alias("t"), hierarchy_key.key_at(tier, *p, F.col("iso")).alias("k")).collect()
    assert [(r.t, r.k) for r in got] == [(4, "MARKS SQUARE_DOVER_G5_ENG_GB"), (3, "DOVER_ENG_GB"), (0, "GB"), (2, "G5_ENG_GB")]
    assert column(spark, ["P0001", "G5_ENG_GB", "GB"], hierarchy_key.is_synthetic) == [False, True, True]
    assert column(spark, ["A_B_C", "A"], hierarchy_key.level) == [2, 0]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def mutate(pick, word):
    for _ in range(pick.randrange(4)):
        i = pick.randrange(len(word) + 1)
        kind = pick.randrange(4)
        if kind == 0:
            word = word[:i] + pick.choice("abc") + word[i:]
        elif kind == 1:
            word = word[:i] + word[i + 1:]
        elif kind == 2:
            word = word[:i] + pick.choice("abc") + word[i + 1:]
        elif i + 1 < len(word):
            word = word[:i] + word[i + 1] + word[i] + word[i + 2:]
    return word


def test_edit_distance_and_keys_against_brute_force(spark):
    """Every pair within two edits shares a key, and a word has at most 29 of them."""
    pick = random.Random(7)
    pairs = []
    for size in [*range(0, 12), 30, 37, 38, 39, 40, 41, 42, 43, 60, 90]:
        for _ in range(40):
            word = "".join(pick.choice("abc" if size < 20 else string.ascii_lowercase) for _ in range(size))
            pairs.append((word, mutate(pick, word)))
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    got = frame.select(
        "i", spelling.within_distance(F.col("a"), F.col("b")).alias("d"),
        F.arrays_overlap(spelling.deletion_keys(F.col("a")), spelling.deletion_keys(F.col("b"))).alias("meet"), F.size(spelling.deletion_keys(F.col("a"))).alias("keys"),
    ).orderBy("i").collect()
    for row, (a, b) in zip(got, pairs):
        assert row.d == min(osa(a, b), 3), (a, b)
        assert row.keys <= 29
        if row.d <= 2:
            assert row.meet, (a, b)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abé'", max_size=8), st.text("abé'", max_size=8)), min_size=1, max_size=60))
def test_edit_distance_property(spark, pairs):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    got = [r.d for r in frame.select("i", spelling.within_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [min(osa(a, b), 3) for a, b in pairs]


def test_marks_in_keys(spark):
    from pyspark.sql import functions as F

    from placewright.functions.text import normalize

    cases = {"Orle\u0301ans": "orleans", "Orléans": "orleans", "İzmir": "izmir", "दिल्ली": "दिल्ली", "A\u030Angstro\u0308m, Sverige": "angstrom,sverige"}
    rows = spark.createDataFrame([(k,) for k in cases], "t STRING")
    assert {r.t: r.n for r in rows.select("t", normalize(F.col("t")).alias("n")).collect()} == cases


def test_letters_before_the_first_composed_one_are_turned_away_at_once():
    assert len(text.COMPOSED) < len(text._SEVERAL) + 20  # neighbours are one range
    first, last, several = re.fullmatch(r"\[(.)-(.)&&\[(.*)\]\]", text.COMPOSED).groups()
    held = {chr(c) for a, b in re.findall(r"(.)(?:-(.))?", several) for c in range(ord(a), ord(b or a) + 1)}
    assert held == {*text._SEVERAL, *map(chr, range(0xAC00, 0xD7A4))} and min(held) == first > "Ԁ" and max(held) == last


def test_both_forms_of_a_key_come_from_one_cleaned_text(spark):
    frame = spark.createDataFrame([("Ổ Łódź, ’s .,  x",), ("A.B's , c",), ("각 ড়, ́e",), (None,), ("",)], "t STRING")
    got = frame.select("t", text.cleaned(F.col("t")).alias("c")).select(
        text.normalize(F.col("t")).alias("a"), text.key_of(F.col("c")).alias("b"), text.normalize(F.col("t"), True).alias("d"), text.key_of(F.col("c"), True).alias("e"))
    rows = got.collect()
    assert all(r.a == r.b and r.d == r.e for r in rows) and rows[0].a == "o lodz,s,x" and rows[1].d == "abs c"
