"""A quality classifier of hashed subword embeddings, averaged over a document, with a softmax on top.

Features of a text are its words, the three- and four-grams of characters in each word, the shape of each word (runs of capitals,
small letters, digits, other signs), and pairs of neighbouring words; a pair of equal words is one feature of its own. All are
hashed into one table of vectors. Training is stochastic gradient descent in numpy, document by document, over a bounded sample of
labelled rows. As the output is linear in the averaged vectors, each table row is folded with the output layer into one number
for scoring, so that what tasks receive is one array of ``BUCKETS`` numbers.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import columns_of
from placewright.llm.fingerprints import mixed

BUCKETS = 1 << 18
DIMENSIONS = 8
#: Labelled rows of each class that a model is fitted on, at most; those with the smallest hashes of their ids.
SAMPLE = 2000
EPOCHS = 6
RATE = 8.0
THRESHOLD = 0.3
GRAMS = (3, 4)
RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([a-zß-öø-ÿ]+)|([0-9]+)|(.)", re.DOTALL)
MODEL = "table binary, bias double"


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


SAME = bucket("= =")


def shape(word: str) -> str:
    return "/" + RUNS.sub(lambda m: "X" if m[1] else "x" if m[2] else "9" if m[3] else m[4], word)


def word_features(word: str) -> list[int]:
    marked = f"<{word}>"
    return [bucket(marked), bucket(shape(word)), *[bucket(marked[i:i + n]) for n in GRAMS for i in range(len(marked) - n + 1)]]


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours in a sequence of word hashes."""
    if len(hashes) < 2:
        return np.zeros(0, dtype=np.int64)
    pairs = (mixed(hashes[:-1]) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.where(hashes[:-1] == hashes[1:], SAME, (pairs % np.uint64(BUCKETS)).astype(np.int64))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features, and the share of each."""
    words = text.split()
    own = [f for word in words for f in word_features(word)]
    hashes = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
    found, counts = np.unique(np.concatenate([np.array(own, dtype=np.int64), pair_features(hashes)]), return_counts=True)
    return found, (counts / max(1, counts.sum())).astype(np.float32)


def trained(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """The log odds of label 1 that each bucket adds, and those of no features at all.

    Without both labels there is nothing to tell apart, and every text gets the smoothed share of label 1.
    """
    ones = sum(label for _, label in rows)
    prior = float(np.log((ones + 1) / (len(rows) - ones + 1)))
    if ones in (0, len(rows)):
        return np.zeros(BUCKETS, dtype=np.float32), prior
    chance = np.random.default_rng(seed)
    vectors = chance.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    examples = [(*features(text), label) for text, label in rows]
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for at in chance.permutation(len(examples)):
            found, share, label = examples[at]
            now = rate * (1 - step / steps)
            step += 1
            if not len(found):
                continue
            mean = share @ vectors[found]
            odds = output @ mean + bias
            odds -= odds.max()
            error = np.exp(odds)
            error /= error.sum()
            error[label] -= 1
            back = error @ output
            output -= 0.05 * now * np.outer(error, mean)
            bias -= 0.01 * now * error
            vectors[found] -= now * share[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


SCORERS: dict[str, Scorer] = {}


class Scorer:
    """Scores texts with a folded table; sums over a word's features are remembered, for at most about ``limit`` words."""

    def __init__(self, table: np.ndarray, bias: float, limit: int = 400_000):
        self.table, self.bias, self.limit = table, bias, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros(1 << 16)
        self.counts = np.zeros(1 << 16, dtype=np.int64)
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)

    def _add(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        if at == len(self.sums):
            self.sums, self.counts, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.hashes))
        found = word_features(word)
        self.sums[at], self.counts[at], self.hashes[at] = self.table[found].sum(), len(found), zlib.crc32(word.encode())
        return at

    def score(self, text: str) -> float:
        if len(self.known) > self.limit:
            self._clear()
        known = self.known
        at = np.array([known[w] if w in known else self._add(w) for w in text.split()], dtype=np.int64)
        odds = self.bias
        if len(at):
            pairs = pair_features(self.hashes[at])
            odds += (self.sums[at].sum() + self.table[pairs].sum(dtype=np.float64)) / (self.counts[at].sum() + len(pairs))
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model of labelled rows that are not held out: at most ``sample`` of each label, read by one task.

    Nothing of a row but its text becomes a feature. Labels other than 0 and 1, and labels without a document, are passed over.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).withColumn("_order", F.xxhash64("_id"))
    chosen = [usable.where(F.col("_label") == k).orderBy("_order", "_id").limit(sample) for k in (0, 1)]
    # At most twice ``sample`` rows, so that broadcasting them is safe.
    rows = df.select(df[doc_id].cast("long").alias("_id"), df[text].alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((order, key, t or "", kind) for part in columns_of(batches) for order, key, t, kind in zip(*part, strict=True))
        table, bias = trained([(t, kind) for _, _, t, kind in found])
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["table", "bias"])

    model = rows.select("_order", "_id", "_text", "_label").repartition(1).mapInArrow(train, MODEL).first()
    if model is None:
        return trained([])
    return np.frombuffer(model["table"], dtype=np.float32), model["bias"]


def scored(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``df`` with ``_score``: how likely label 1 is for each whole text, from 0 to 1; null and empty texts have a score too."""
    sent, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if key not in SCORERS:  # a worker keeps the scorer of the last model from task to task
            SCORERS.clear()
            SCORERS[key] = Scorer(*sent.value)
        return pd.Series([SCORERS[key].score(t or "") for t in texts], dtype="float64")

    return df.withColumn("_score", score(df[text]))


def classified(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, with a model fitted on ``labels``."""
    out = scored(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")), fitted(df, labels, doc_id, text))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
