"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find what lies within a Hamming radius.

Terms are runs of five words, weighted by how often they occur in the text; a shorter text is one term. Each term has a hash of
``BITS`` bits, each bit votes with the term's weight for or against, and the fingerprint has the bits with a majority.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from placewright.llm.common import Memo, checked_broadcast, columns_of, partitions, stage

BITS = 128
WORDS = 5
RADIUS = 3
#: Fingerprints of one block, about, that one part of it has.
PART = 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each 64-bit number."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hash(word: str) -> int:
    data = word.encode()
    return zlib.crc32(data) << 32 | zlib.crc32(data[::-1], len(data))


class Fingerprints:
    """Fingerprints of texts, as lower-case hexadecimal text of ``BITS`` bits."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.word = Memo(word_hash, 400_000)

    def terms(self, text: str) -> np.ndarray:
        """The hashes of a text's terms, each as often as it occurs."""
        h = np.array([*map(self.word.__getitem__, WORD.findall(text))], dtype=np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        total = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            total = mixed(total + h[k:len(h) - n + 1 + k] + np.uint64(k + 1))
        return total

    def of(self, terms: np.ndarray) -> str:
        """The fingerprint of terms; their repetition is their weight. No terms give zero bits."""
        votes = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(terms), 8192):
            part = terms[at:at + 8192]
            hashes = np.stack([part, mixed(part ^ MIX[1])], axis=1)
            votes += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(2 * votes > len(terms), bitorder="little").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal bits."""
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / BITS


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint) of every whole text. A null text is an empty one, whose fingerprint is all zeros."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprints(words)
        for keys, texts in columns_of(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([own.of(own.terms(t or "")) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def blocks(fingerprint: Column, radius: int) -> Column:
    """The block tables' keys of a fingerprint: (table, bits of the table's block).

    The bits fall into ``radius`` + 1 blocks. Two fingerprints within the radius agree on at least one whole block, so each
    table, which is the fingerprints with one block permuted to the front, is looked up by that block.
    """
    digits, tables = BITS // 4, radius + 1
    if digits < tables:
        raise ValueError(f"at most {digits - 1} bits of radius")
    edges = [digits * i // tables for i in range(tables + 1)]
    return F.array(*[F.struct(F.lit(i).alias("table"), F.substring(fingerprint, a + 1, b - a).alias("block")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which two fingerprints differ."""
    return pd.Series([(int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a, b, strict=True)], dtype="int32")


def within(queries: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, doc_id, bits) for each row within ``radius`` bits of each query; both sides are (doc_id, fingerprint).

    Both are reduced to distinct fingerprints before they meet in the block tables, so a group of equal rows is one entry there;
    pairs of different fingerprints are found once, and ids are attached at the end. A block that very many fingerprints share is
    cut into parts by its count, each of which meets all queries of that block. Null fingerprints match nothing.
    """
    asked = queries.where(F.col("fingerprint").isNotNull()).select(F.col("doc_id").alias("query"), F.col("fingerprint").alias("asked"))
    known = rows.where(F.col("fingerprint").isNotNull()).select("doc_id", "fingerprint")
    left = asked.select("asked").distinct().select("asked", F.inline(blocks(F.col("asked"), radius)))
    right = known.select("fingerprint").distinct().select("fingerprint", F.inline(blocks(F.col("fingerprint"), radius)))
    counts = right.groupBy("table", "block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where(F.col("parts") > 1)
    counts = stage(counts, "hot-blocks")
    hot = checked_broadcast(counts, counts.count())
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(hot, ["table", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = right.join(hot, ["table", "block"], "left").withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int")).drop("parts")
    pairs = left.join(right, ["table", "block", "part"]).select("asked", "fingerprint").distinct()
    near = pairs.withColumn("bits", distance("asked", "fingerprint")).where(F.col("bits") <= radius)
    return asked.join(near, "asked").join(known, "fingerprint").select("query", "doc_id", "bits")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(cuts: list[int]):
    """How many of the sorted cuts lie below a number."""
    @F.pandas_udf("int")
    def of(value: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, dtype=np.int64), value.to_numpy(dtype=np.int64)), dtype="int32")

    return of


def looked_up(values: dict[int, int]):
    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return key.map(values).astype("int32")

    return of


def compared(df: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, words: int = WORDS) -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and how like they and the next document's are.

    Edited: the last floor(n_chars / 4) code points give way to the first as many, or all, of the document next in ascending id;
    after the last comes the first. Documents go to ranges of ids cut at quantiles, and each range also gets the first document of
    the one after it, so that a task sees every neighbour it needs while no text is moved twice. Null ids come first, rows of
    one id in the order of their texts; a null text is an empty one. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(df[doc_id].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), df[doc_id].isNull().alias("no_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    count = buckets or 4 * partitions(spark)
    cut = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100 * count).alias("at")).first()["at"] or []
    cuts = sorted(set(cut))  # as many as there are ranges
    placed = docs.withColumn("bucket", ranges(cuts)("doc_id"))
    heads = placed.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()  # one row for each range
    before = {h.doc_id: heads[i - 1].bucket for i, h in enumerate(heads)}
    firsts = docs.where(F.col("doc_id").isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
    extra = firsts.select("doc_id", F.lit(None).cast("boolean").alias("no_id"), "text", looked_up(before)("doc_id").alias("bucket"))
    dealt = placed.unionByName(extra).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", F.isnull("no_id"), "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprints(words)
        held = None  # the document before, with its terms
        for part in columns_of(batches):
            out: list[tuple] = []
            for key, no_id, t, _ in zip(*part, strict=True):
                terms = own.terms(t)
                print_ = own.of(terms)
                if held is not None:
                    n = len(held[2])
                    moved = n // 4
                    edited = held[2][:n - moved] + t[:moved]
                    of_edited = own.of(own.terms(edited)) if edited != held[2] else held[3]
                    out.append((None if held[1] else held[0], n, hashlib.sha256(edited.encode()).hexdigest(), held[3], of_edited,
                                likeness(held[3], of_edited), likeness(held[3], print_)))
                held = None if no_id is None else (key, no_id, t, print_)
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in COMPARED.split(", ")])

    return dealt.select("doc_id", "no_id", "text", "bucket").mapInArrow(run, COMPARED)
