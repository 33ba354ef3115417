"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators also give to results of their own.
CLASHING = "n_tokens string, key string, class string, score string, kept string, bands string, _text string, h1 string, bucket string"

SYLLABLES = "an er in on re st th ea or ti en ha ou nd es".split()


def prose(seed: int, words: int = 120, per_line: int = 25) -> str:
    chance = random.Random(seed)
    made = ["".join(chance.choice(SYLLABLES) for _ in range(chance.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(made[i:i + per_line]) + "." for i in range(0, words, per_line))


def edited(text: str, seed: int, changes: int) -> str:
    chance, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[chance.randrange(len(words))] = "changed" + str(chance.randrange(1000))
    return " ".join(words)


def documents(spark, extra: bool = True):
    """Ids from 0; 3 and 4 are equal, 5 and 6 nearly so, 7 is null, 8 empty, 9 long, 10 one word, 11 odd signs; row 12 twice."""
    texts = [prose(i) for i in range(4)]
    texts += [texts[3], prose(5), edited(prose(5), 1, 1), None, "", prose(9, 30_000), "word", "a  b\t c\r\n\x1c x  y 日本語 🙂 <|endoftext|> ▁ it's\x00 ", prose(12)]
    rows = [(i, t, "en" if i % 2 else None, None if i == 5 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12]]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c.split()[0]: F.lit("clash") for c in CLASHING.split(", ")})
    return frame.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, name: str = "doc_id") -> dict:
    return {r[name]: r for r in df.collect()}
