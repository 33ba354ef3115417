"""Word frequencies of the gazetteer and spelling suggestions from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.spelling import MAX_DISTANCE, deletion_keys, within_distance
from placewright.operators.skew import salted_join
from placewright.schemas import NOISE_NAMES, NOISE_PHRASE, NOISE_WORD
from placewright.workspace import stage

# Words this short stay out of the vocabulary; suggestions looked at per term.
SHORTEST_LEFT_OUT = 2
SUGGESTIONS = 4


def vocabulary(names: DataFrame, name: str = "name") -> DataFrame:
    """(word, freq) over all names, noise left out."""
    kept = names.where(~F.contains(name, F.lit(NOISE_PHRASE)) & ~F.col(name).isin(*NOISE_NAMES))
    return (
        kept.select(F.explode(F.split(name, " ")).alias("word"))
        .where((F.length("word") > SHORTEST_LEFT_OUT) & (F.col("word") != NOISE_WORD))
        .groupBy("word").agg(F.count("*").alias("freq"))
    )


def lookup_allowed(term: Column) -> Column:
    """Terms that are looked up at all; others are returned as they are."""
    return ~F.contains(term, F.lit("*")) & (F.length(term) > 1)


def correction_allowed(text: Column) -> Column:
    """Texts that are corrected: no digit, no ``st``, no wildcard, more than one letter."""
    return ~F.rlike(text, F.lit(r"\d")) & ~F.contains(text, F.lit("st ")) & lookup_allowed(text)


POSTING = "key STRING, word STRING, freq LONG"


def index(vocab: DataFrame) -> DataFrame:
    """(key, word, freq): the words under each of their deletion keys."""
    return vocab.select(F.explode(deletion_keys(F.col("word"))).alias("key"), "word", F.col("freq").cast("long").alias("freq"))


def ranked_suggestions(terms: DataFrame, vocab: DataFrame, filed: DataFrame | None = None, **salting) -> DataFrame:
    """(term, found): up to four (distance, -freq, word) at the smallest distance, best first.

    A known term suggests itself, which an equality join settles. For the others, term and word meet on a key that both
    must have if they are within the distance, so no word list is compared with another as a whole. ``filed`` is what :func:`index`
    gives, if it is kept. A key that very many words are filed under, as the few letters that short ones leave, is cut into parts by its
    count; the terms that ask for it are copied to each part.
    """
    distinct = terms.select("term").where(lookup_allowed(F.col("term"))).distinct()
    marked = stage(distinct.join(vocab.withColumnRenamed("word", "term"), "term", "left"), "terms")
    entry = lambda d, f, w: F.struct(d.cast("int").alias("distance"), (-f).alias("less"), w.alias("word"))
    known = marked.where("freq IS NOT NULL").select("term", F.array(entry(F.lit(0), F.col("freq"), F.col("term"))).alias("found"))

    asked = stage(marked.where("freq IS NULL").select("term", F.explode(deletion_keys(F.col("term"))).alias("key")), "asked-keys")
    wanted = stage((filed if filed is not None else index(vocab)).join(asked.select("key").distinct(), "key", "left_semi"), "postings")
    near = (
        salted_join(wanted, asked, ["key"], spread=["word"], how="inner", **salting)
        .where(F.abs(F.length("term") - F.length("word")) <= MAX_DISTANCE)
        .groupBy("term", "word").agg(F.max("freq").alias("freq"))
        .withColumn("distance", within_distance(F.col("term"), F.col("word"))).where(F.col("distance") <= MAX_DISTANCE)
    )
    best = Window.partitionBy("term").orderBy("distance", F.desc("freq"), "word")
    found = (
        near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= SUGGESTIONS)
        .groupBy("term").agg(F.array_sort(F.collect_list(entry(F.col("distance"), F.col("freq"), F.col("word")))).alias("found"))
        .select("term", F.filter("found", lambda s: s["distance"] == F.col("found")[0]["distance"]).alias("found"))
    )
    return known.unionByName(found)


def suggest(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, suggestion): suggestions that share the first letter, joined by blanks.

    An unknown term without any suggestion returns itself; one whose suggestions all start with another letter gets
    null. Terms that are not looked up return themselves.
    """
    distinct = terms.select("term").distinct()
    same_first = lambda s: F.substring(s["word"], 1, 1) == F.substring(F.col("term"), 1, 1)
    text = F.array_join(F.transform(F.filter("found", same_first), lambda s: s["word"]), " ")
    return distinct.join(ranked_suggestions(distinct, vocab), "term", "left").select(
        "term", F.when(F.col("found").isNull(), F.col("term")).when(text != "", text).alias("suggestion")
    )


def correct_phrases(phrases: DataFrame, vocab: DataFrame, keep: str = "id", **salting) -> DataFrame:
    """(id, corrected): each word of ``phrase`` replaced by its best suggestion; a word without one stays."""
    words = phrases.select(keep, F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    best = ranked_suggestions(words, vocab).select("term", F.col("found")[0]["word"].alias("word"))
    return (
        salted_join(words, best, ["term"], spread=[keep, "at"], **salting)
        .groupBy(keep).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", "term").alias("word")))).alias("w"))
        .select(keep, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("corrected"))
    )


# What a join or a split of words costs beside the edits in them, and a word that nothing is suggested for.
REJOINED, UNKNOWN = 1, MAX_DISTANCE + 1
UNIT = "struct<cost:int,less:bigint,text:string>"


def _unit(cost: Column, less: Column, text: Column) -> Column:
    return F.struct(cost.cast("int").alias("cost"), less.cast("long").alias("less"), text.alias("text"))


def correct_compound(phrases: DataFrame, vocab: DataFrame, keep: str = "id", filed: DataFrame | None = None, **salting) -> DataFrame:
    """(id, corrected, cost): each ``phrase`` with the spelling that is the least changed, words glued together or torn apart included.

    A phrase is cut into units: a word with its best suggestion, two neighbours that together come near a word, or a word that comes near
    two. A unit costs its edits, and one more where it joins or splits; a word without a suggestion stays and costs ``UNKNOWN``. The cheapest
    cut is found by dynamic programming from word to word; of equal ones the more frequent words win, then the lesser text. Known words
    are never split. Terms are looked up once, however many phrases hold them. A phrase without words has no row.
    """
    spelt = phrases.select(keep, F.filter(F.split("phrase", " "), lambda w: w != "").alias("words"))
    last = F.size("words") - 1
    pairs = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat(F.get("words", i), F.get("words", i + 1))))
    at = F.posexplode(F.arrays_zip("words", F.concat(F.array(F.lit(None).cast("string")), F.coalesce(pairs, F.array().cast("array<string>"))).alias("pairs"))).alias("at", "x")
    placed = stage(spelt.select(keep, at).select(keep, "at", F.col("x.words").alias("word"), F.col("x.pairs").alias("pair")).where("word IS NOT NULL"), "phrase-words")

    terms = placed.select(F.col("word").alias("term")).unionByName(placed.select(F.col("pair").alias("term")).where("term IS NOT NULL"))
    first = stage(ranked_suggestions(terms, vocab, filed, **salting).select("term", F.col("found")[0].alias("best")), "term-suggestions")
    unknown = placed.select(F.col("word").alias("term")).distinct().join(first.where("best.distance = 0"), "term", "left_anti").where(lookup_allowed(F.col("term")))
    cuts = stage(unknown.where(F.length("term") > 1).select("term", F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("k")).select(
        "term", F.substring("term", F.lit(1), F.col("k")).alias("left"), F.substring(F.col("term"), F.col("k") + 1, F.length("term")).alias("right")), "cuts")
    halves = cuts.select(F.col("left").alias("term")).unionByName(cuts.select(F.col("right").alias("term")))
    second = stage(ranked_suggestions(halves, vocab, filed, **salting).select("term", F.col("found")[0].alias("best")), "half-suggestions")
    side = lambda name: second.select(F.col("term").alias(name), F.col("best").alias(f"{name}_best"))
    split = _unit(REJOINED + F.col("left_best.distance") + F.col("right_best.distance"), F.col("left_best.less") + F.col("right_best.less"),
                  F.concat_ws(" ", "left_best.word", "right_best.word"))
    by_split = salted_join(salted_join(cuts, side("left"), ["left"], spread=["term", "right"], how="inner", **salting), side("right"), ["right"], spread=["term", "left"], how="inner", **salting)
    splits = by_split.groupBy(F.col("term").alias("word")).agg(F.min(split).alias("split"))

    single = first.select(F.col("term").alias("word"), _unit(F.col("best.distance"), F.col("best.less"), F.col("best.word")).alias("single"))
    of_word = single.join(splits, "word", "full").select("word", F.array_min(F.array("single", "split")).alias("unit"))
    of_pair = first.select(F.col("term").alias("pair"), _unit(REJOINED + F.col("best.distance"), F.col("best.less"), F.col("best.word")).alias("joined"))
    rated = salted_join(placed, of_word, ["word"], spread=[keep, "at"], **salting)
    rated = salted_join(rated.where("pair IS NOT NULL"), of_pair, ["pair"], spread=[keep, "at"], **salting).unionByName(
        rated.where("pair IS NULL").withColumn("joined", F.lit(None).cast(UNIT)))
    stays = _unit(F.lit(UNKNOWN), F.lit(0), F.col("word"))
    units = rated.groupBy(keep).agg(F.array_sort(F.collect_list(F.struct("at", F.array_min(F.array("unit", stays)).alias("unit"), "joined"))).alias("units"))

    after = lambda best, unit: F.when(best.isNotNull() & unit.isNotNull(), _unit(
        best["cost"] + unit["cost"], best["less"] + unit["less"], F.concat_ws(" ", F.when(best["text"] != "", best["text"]), unit["text"])))
    start = F.struct(F.lit(None).cast(UNIT).alias("before"), _unit(F.lit(0), F.lit(0), F.lit("")).cast(UNIT).alias("best"))
    step = lambda state, word: F.struct(
        state["best"].cast(UNIT).alias("before"), F.array_min(F.array(after(state["best"], word["unit"]), after(state["before"], word["joined"]))).cast(UNIT).alias("best"))
    done = units.select(keep, F.aggregate("units", start, step)["best"].alias("best"))
    return done.select(keep, F.col("best.text").alias("corrected"), F.col("best.cost").alias("cost"))
