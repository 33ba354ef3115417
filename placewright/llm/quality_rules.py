"""Quality rules whose limits follow the data: quantile sketches for each language and source, and a joined filter.

Each measure of a document is sketched for its language and source. Sketches merge, so those of a language and of the whole
table come from the same ones, and a group too small to speak for itself is judged by its language, or by all. A document fails
a measure that lies further from its group's median than ``REACH`` times the distance of the median from the tenth on the good
side, and at least ``REACH`` times the measure's least spread, without which groups that are all alike would reject any other.
Medians and good-side tenths hold as long as less than half of a group is junk. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import stage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-ZÀ-ÖØ-Þ]"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
SKETCH = 1024
MIN_GROUP = 50
REACH = 6.0
#: Least spread of each measure.
MEASURES = {"symbols": 0.02, "dup_lines": 0.08, "repeats": 0.03, "capitals": 0.04, "word_length": 0.8}
SALTS = 16


def paired(a: str, b: Column) -> Column:
    """A hash of each value of one array with the one beside it in another."""
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def later(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def repeated(hashes: Column, window: int) -> Column:
    """From the windows' hashes: sort them with their places, keep those equal to a neighbour, and add up what they cover."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = F.arrays_zip(ordered.alias("a"), F.concat(none, ordered).alias("b"), F.concat(F.slice(ordered, 2, F.size(hashes)), none).alias("c"))
    same = F.filter(beside, lambda x: x["a"].isNotNull() & (F.coalesce(x["a"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["a"]["h"] == x["c"]["h"], F.lit(False))))
    places = F.sort_array(F.transform(same, lambda x: x["a"]["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    total = F.aggregate(places, start, lambda acc, i: F.struct((i + window).alias("end"), (acc["words"] + i + window - F.greatest(acc["end"], i)).alias("words")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total["words"]).otherwise(0)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts and the measures of each whole text, all under names that begin with an underscore."""
    value = F.coalesce(df[text], F.lit(""))
    inner = F.btrim(F.col("_text"), F.lit(BLANKS))
    out = df.withColumn("_text", value)
    out = out.withColumn("_words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    # Hashes of the windows of five words, from those of words, pairs and fours; each column is used more than once below.
    out = out.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_h2", paired("_h1", later("_h1", 1)))
    out = out.withColumn("_h4", paired("_h2", later("_h2", 2)))
    windows = F.slice(paired("_h4", later("_h1", WINDOW - 1)), 1, F.greatest(F.size("_h1") - (WINDOW - 1), F.lit(0)))
    out = out.withColumn("_windows", windows)
    out = out.select(
        *df.columns, F.size("_words").cast("long").alias("_n_words"), F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("_n_symbols"), F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        repeated(F.col("_windows"), WINDOW).cast("long").alias("_n_repeat_words"), F.regexp_count("_text", F.lit(UPPER)).cast("long").alias("_n_upper"))
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("_n_words", "_word_chars", "_n_lines"))
    shares = {"symbols": F.col("_n_symbols") / words, "dup_lines": F.col("_n_dup_lines") / lines, "repeats": F.col("_n_repeat_words") / words,
              "capitals": F.col("_n_upper") / chars, "word_length": F.col("_word_chars") / words}
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED * F.col("_n_words"))
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns], *[e.cast("double").alias(f"_{m}") for m, e in shares.items()], failed.alias("_base_failed"))


def sketches(measures: DataFrame, lang: str, source: str) -> DataFrame:
    """A sketch of each measure for each language and source, of the documents that pass the base rules.

    Sketching starts before the shuffle, so a source with a third of all rows sends one row for each task.
    """
    keys = [F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")]
    # A condition within the sum, and not a filter: a filter would be pushed below the measures and work them out once more.
    passed = F.when(~F.col("_base_failed"), F.lit(1))
    return measures.groupBy(*keys).agg(
        F.count(passed).alias("n"), *[F.kll_sketch_agg_double(F.when(passed == 1, F.col(f"_{m}")), SKETCH).alias(m) for m in MEASURES])


def limits(found: DataFrame) -> DataFrame:
    """For each language and source, the lowest and highest value that each measure may have."""
    merge = lambda level: [F.sum(f"n").alias(f"n_{level}"), *[F.kll_merge_agg_double(m, SKETCH).alias(f"{m}_{level}") for m in MEASURES]]
    of_lang = found.groupBy("_lang").agg(*merge("lang"))
    of_all = found.agg(*merge("all")).withColumn("one", F.lit(1))
    levels = found.withColumn("one", F.lit(1)).join(of_lang, "_lang").join(of_all, "one")
    own, wide = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    out = []
    for m, least in MEASURES.items():
        sketch = F.when(own, F.col(m)).when(wide, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
        at = lambda rank, sketch=sketch: F.kll_sketch_get_quantile_double(sketch, F.lit(rank))
        room = REACH * F.greatest(at(0.5) - at(0.1), F.lit(least))
        out += [(at(0.5) + room).alias(f"{m}_high"), (at(0.5) - room if m == "word_length" else F.lit(float("-inf"))).alias(f"{m}_low")]
    return levels.select("_lang", "_source", *out)


def limits_of(measures: DataFrame, lang: str, source: str) -> DataFrame:
    """The limits of all groups, as a written table. The sketches are read three times, so they are staged too."""
    return stage(limits(stage(sketches(measures, lang, source), "quality-sketches")), "quality-limits")


def held_against(measures: DataFrame, known: DataFrame, doc_id: str, lang: str, source: str) -> DataFrame:
    """``measures`` with ``_kept``. Spark broadcasts the limits while their table's size is below its threshold; beyond it, the
    join is salted."""
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = measures.withColumns({
        "_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_salt": F.pmod(F.xxhash64(doc_id, "_word_chars", "_n_words"), F.lit(SALTS)).cast("int")})
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(f"_{m}").between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    # One condition on both sides of the join, so that no part of it is pushed below the measures.
    verdict = F.coalesce(~F.col("_base_failed") & inside, F.lit(False))
    return rows.join(spread, ["_lang", "_source", "_salt"], "left").select(*measures.columns, verdict.alias("_kept"))


def judged(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns of ``df`` but the text, with counts, measures, ``_base_failed`` and ``_kept``; one pass over the texts.

    Null texts are empty, null languages and sources are groups of their own, and repeated rows are judged alike.
    """
    measures = stage(measured(df, text).drop(text), "quality-measures")
    return held_against(measures, limits_of(measures, lang, source), doc_id, lang, source)


def kept(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, as they were; two passes over the texts, none of which shuffles them."""
    known = limits_of(measured(df.select(text, *sorted({lang, source} - {text})), text), lang, source)
    return held_against(measured(df, text), known, doc_id, lang, source).where("_kept").select(*df.columns)
