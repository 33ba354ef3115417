"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is a weighted set: its five-word shingles, each with weight 1, or with the number of times it occurs. Darts are thrown at
the plane of weight and rank above every possible element, where the hash of the element alone fixes them, at one for each unit of
area. A dart counts if it lies below the element's weight; the darts with the lowest ranks, up to a rank at which about
K (ln K + 4) of them count, are spread over the K coordinates of a signature, and each coordinate keeps its earliest. Two
signatures agree in a coordinate with the probability of their sets' weighted Jaccard similarity. The time is that of the
elements and the darts, however large K or the weights are.

Coordinates form bands, and documents that agree on a band are compared: at first with the first documents of that band's bucket
and with the one before. Whole signatures settle what is clear; else the shingles are compared. Then all pairs of a bucket that are
not in one class by now are looked at within blocks of documents, so that no pair sharing a band is passed over and none but
those that join two classes leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm import stars
from placewright.llm.common import checked_broadcast, columns_of, partitions, stage
from placewright.llm.fingerprints import mixed
from placewright.llm.shingles import Together, shingles

BANDS, ROWS = 40, 6
WORDS, SIMILARITY = 5, 0.8
LEADERS = 2
#: Documents in a block of a bucket, about; a task compares two blocks at a time.
BLOCK = 512
#: Shingles in a block of a bucket, about, or those of its longest document.
BLOCK_SHINGLES = 1 << 19
#: Parts that a bucket's rows are dealt over where they are joined by band.
SALTS = 16
#: Partners of a document, about, whose shingles are sent or compared in one row's part.
PART = 512
#: Estimates from signatures below the one are too low, and those from the other on need no further look: at 240 coordinates a pair of
#: similarity 0.8 is estimated below 0.65 about four times in a hundred million.
TOO_LOW, CLEAR = 0.65, 0.92
NO_ID = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
NTH = np.arange(1, 13, dtype=np.uint64) * ODD
#: A 64-bit hash is below the first k of these if a cell of unit area holds at most k - 1 darts: the Poisson distribution.
POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])
POISSON = (np.minimum(POISSON, 1 - 2.0**-53) * 2.0**64).astype(np.uint64)


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, rank: float, start: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The ranks and hashes of the darts below each element's weight, from rank ``start`` and below ``rank``.

    The weights from 2^(v-1) to 2^v (from 0 to 1 for v = 0) make one row of cells of unit area, as high in rank as they are narrow.
    """
    ranks, hashes = [], []
    level = 0
    while True:
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        above = weights > low
        if not above.any():
            break
        own, weight = (elements, weights) if above.all() else (elements[above], weights[above])
        full = bool((weight >= low + width).all())
        cells = np.arange(int(start * width), int(np.ceil(rank * width)), dtype=np.uint64)
        step = max(1, (1 << 20) // len(own))
        for at in range(0, len(cells), step):
            some = cells[at:at + step]
            h = mixed((own[:, None] + mixed(some * ODD + np.uint64(level + 1))[None, :]).ravel())
            count = np.searchsorted(POISSON, h, side="right")
            cell = np.repeat(np.arange(len(h)), count)
            nth = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(h[cell] + NTH[nth])
            its_rank = (some[cell % len(some)].astype(np.float64) + uniform(dart)) / width
            hit = (its_rank < rank) & (its_rank >= start)
            if not full:
                hit &= low + width * uniform(mixed(dart ^ ODD)) < weight[cell // len(some)]
            ranks.append(its_rank[hit])
            hashes.append(dart[hit])
        level += 1
    return np.concatenate(ranks or [np.zeros(0)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def signature(elements: np.ndarray, weights: np.ndarray | None = None, size: int = BANDS * ROWS) -> np.ndarray:
    """The signature of a weighted set: for each coordinate the hash of its earliest dart. An empty set has none.

    About K (ln K + 2) darts fill K coordinates seven times in eight; else the next ranks are looked at, for the empty ones.
    """
    weights = np.ones(len(elements)) if weights is None else weights
    total = float(weights.sum())
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    start, rank = 0.0, size * (np.log(size) + 2) / total
    out, filled = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)
    while True:
        ranks, hashes = darts(elements, weights, rank, start)
        at = ((mixed(hashes) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        earliest = np.full(size, np.inf)
        np.minimum.at(earliest, at, ranks)
        first = (ranks == earliest[at]) & ~filled[at]
        out[at[first]] = hashes[first]
        filled[at] = True
        if filled.all():
            return out
        start, rank = rank, rank + 2 * size / total


def bands_of(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a signature."""
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64) * ODD)
    for column in values.reshape(bands, rows).T:
        out = mixed(out + column)
    return out


def shingle_set(text: str, words: int = WORDS, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(shingles(text, words), return_counts=True)
    return found, counts.astype(float) if weighted else np.ones(len(found))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sorted sets; of two empty ones 1."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 1.0


def signed(df: DataFrame, doc_id: str, text: str, words: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(doc, key, bands, sketch, weight) of each row: the text's hash, its band hashes, eight bits of each coordinate, its set's weight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        for docs, keys, texts in columns_of(batches):
            found = []
            for key, t in zip(keys, texts, strict=True):
                if key not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    elements, weights = shingle_set(t, words, weighted)
                    values = signature(elements, weights, bands * rows)
                    packed = (bands_of(values, bands, rows).tobytes(), values.astype(np.uint8).tobytes()) if len(values) else (b"", b"")
                    known[key] = (*packed, float(weights.sum()))
                found.append(known[key])
            columns = [docs, keys, *zip(*found, strict=True)] if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "key", "bands", "sketch", "weight"])

    return keyed(df, doc_id, text).select("_doc", "_key", F.coalesce(F.col(text), F.lit(""))).mapInArrow(
        run, "doc long, key binary, bands binary, sketch binary, weight double")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` after a row's id (the lowest integer for null) and the hash of its text (an empty one for null)."""
    return df.select(F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("_doc"), F.unhex(F.md5(F.coalesce(df[text], F.lit("")))).alias("_key"), *df.columns)


def banded(reps: DataFrame) -> DataFrame:
    """(band, doc) for each band of each document."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, packed in columns_of(batches):
            hashes = [np.frombuffer(b, dtype=np.int64) for b in packed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes or [np.zeros(0, np.int64)])), pa.array(np.repeat(np.array(docs, dtype=np.int64), [len(h) for h in hashes]))], ["band", "doc"])

    return reps.where(F.length("bands") > 0).select("doc", "bands").mapInArrow(spread, "band long, doc long")


def candidates(reps: DataFrame, leaders: int = LEADERS) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) of documents that share a band: each with its bucket's first ones and with the one before it.

    And the distinct ``band`` of the buckets that have further pairs: those of more than ``leaders`` + 2 documents, and those that
    go on in another partition.

    Band hashes are range-partitioned together with a random order of documents, so a bucket with a third of all documents is
    spread over many tasks. A bucket that goes on in another partition has its first documents there as well; these are paired
    with those of the partition before, of which there is one row for each end of a partition.
    """
    spark = reps.sparkSession

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, heads, before, first_band, seen = None, [], None, None, 0

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bands, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            if band is not None and band == bands[0]:  # put the open bucket's first documents and the last one before
                lead = np.array([*heads, before] if len(heads) == leaders else heads, dtype=np.int64)
                carried = len(lead)
                bands, docs = np.concatenate([np.full(carried, band), bands]), np.concatenate([lead, docs])
            else:
                carried = 0
            start = np.concatenate([[True], bands[1:] != bands[:-1]])
            begins = np.maximum.accumulate(np.where(start, np.arange(len(bands)), 0))
            nth = np.arange(len(bands)) - begins
            new = np.arange(len(bands)) >= carried
            a, b = [], []
            for k in range(leaders):
                at = np.flatnonzero(new & (nth > k))
                a.append(docs[begins[at] + k])
                b.append(docs[at])
            at = np.flatnonzero(new & (nth > leaders))
            a.append(docs[at - 1])
            b.append(docs[at])
            a, b = np.concatenate(a), np.concatenate(b)
            all_before = np.where(begins == 0, seen - carried, 0) if carried else 0  # of the open bucket, without those put before
            more = bands[new & (nth + all_before == leaders + 2)]
            if len(more):
                yield out(3, more, np.zeros(len(more), np.int64))
            if first_band is None:
                first_band = bands[0]
                yield out(1, bands[:1], docs[:1])
            different = a != b
            low, high = np.minimum(a, b)[different], np.maximum(a, b)[different]
            if len(low):
                yield out(0, low, high)
            last = int(begins[-1])
            seen = len(bands) - last + (seen - carried if carried and last == 0 else 0)
            band, heads, before = bands[-1], docs[last:last + leaders].tolist(), int(docs[-1])
        if band is not None:
            yield out(2, np.array([band]), np.array(heads[:1]))

    ordered = banded(reps).select("band", F.xxhash64("doc").alias("_order"), "doc").repartitionByRange(partitions(spark), "band", "_order").sortWithinPartitions("band", "_order", "doc")
    found = stage(ordered.mapInArrow(pair, "kind int, a long, b long"), "band-pairs")
    heads = found.where(F.col("kind") == 1).select(F.col("a").alias("band"), F.col("b").alias("head"))
    tails = found.where(F.col("kind") == 2).groupBy(F.col("a").alias("band")).agg(F.min_by("b", F.xxhash64("b")).alias("tail"))
    over = heads.join(F.broadcast(tails), "band").where(F.col("head") != F.col("tail"))
    pairs = found.where(F.col("kind") == 0).select("a", "b").unionByName(over.select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"))).distinct()
    return pairs, found.where(F.col("kind") == 3).select(F.col("a").alias("band")).unionByName(over.select("band")).distinct()


def left_out(reps: DataFrame, bands: DataFrame, roots: DataFrame, texts: DataFrame, size: int, words: int, weighted: bool, least: float) -> DataFrame:
    """(a, b): links between documents of different roots that share one of the buckets ``bands``, enough to join all that are alike.

    A bucket's largest class is one side and the rest the other, both cut into blocks by a hash, so that a block has few documents and
    few shingles. Every block of the rest meets every block of either side in a unit of its own, so that the largest class, which may
    be all of a hot bucket but a few, is never compared with itself. No pair is ever a row. A unit is looked at twice: signatures
    join what is clearly alike and tell which documents have a partner that isn't clear; these come back with their shingles,
    which are compared within the unit. Either time only such pairs are handed on that join two classes of the unit. A pair is
    looked at in the first of the bands that it shares.
    """
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    bands = stage(salted(bands), "large-buckets")
    members = banded(reps).select("band", "doc", salt).join(checked_broadcast(bands, bands.count()), ["band", "salt"])
    members = members.join(roots, "doc", "left").join(reps.select("doc", "weight"), "doc")
    members = stage(members.select("band", "salt", "doc", "weight", F.coalesce("root", "doc").alias("root")), "bucket-members")
    classes_of = members.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).groupBy("band").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "w")).alias("most"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    sides = classes_of.where(F.col("n") > F.col("most.n")).select(
        "band", F.col("most.root").alias("most"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("rest"),
        blocks(F.col("most.n"), F.col("most.w")).alias("own"))
    sides = stage(salted(sides), "bucket-sides")
    is_most, order = F.col("root") == F.col("most"), F.xxhash64("doc", F.lit(1))
    dealt = members.join(checked_broadcast(sides, sides.count()), ["band", "salt"]).select(
        "band", "doc", "root", F.when(is_most, F.col("rest") + F.pmod(order, "own")).otherwise(F.pmod(order, "rest")).cast("int").alias("block"),
        F.when(is_most, F.col("rest")).otherwise(F.col("rest") + F.col("own")).alias("meets"))
    dealt = dealt.join(reps.select("doc", "sketch", "weight", "bands"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    units = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "root", "sketch", "weight", "bands")

    def column(unit: list[pa.RecordBatch], k: int) -> np.ndarray:
        return np.concatenate([part.column(k).to_numpy() for part in unit])

    def packed(unit: list[pa.RecordBatch], k: int) -> list[bytes]:
        return [v for part in unit for v in part.column(k).to_pylist()]

    def partners(unit: list[pa.RecordBatch], roots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Each document, the first that it is to be compared with, and which from there on have other roots."""
        i, j = unit[0].column(1)[0].as_py(), unit[0].column(2)[0].as_py()
        end = len(roots) if i == j else int((column(unit, 3) == i).sum())  # block i comes first
        for x in range(end):
            first = x + 1 if i == j else end
            other = roots[first:] != roots[x]
            if other.any():
                yield x, first, other

    def joined(docs: np.ndarray, roots: np.ndarray, x: int, alike: np.ndarray, kept: list) -> None:
        for y in alike:
            if roots[y] != roots[x]:
                kept.append((0, 0, 0, 0, 0, docs[x], docs[y]))
                roots[roots == roots[y]] = roots[x]

    def by_signatures(unit: list[pa.RecordBatch]) -> list[tuple]:
        band = unit[0].column(0)[0].as_py()
        blocks, docs, roots, weights = column(unit, 3), column(unit, 4), column(unit, 5).copy(), column(unit, 7)
        sketches = np.frombuffer(b"".join(packed(unit, 6)), dtype=np.uint8).reshape(-1, size)
        of_bands = np.frombuffer(b"".join(packed(unit, 8)), dtype=np.int64).reshape(len(docs), -1)
        before = of_bands[:, :int((of_bands == band).any(axis=0).argmax())]
        kept, asked = [], []
        for x, first, other in partners(unit, roots):
            y = first + np.flatnonzero(other & (np.minimum(weights[first:], weights[x]) >= (least - 1e-9) * np.maximum(weights[first:], weights[x])))
            estimate = ((sketches[y] == sketches[x]).mean(axis=1) * 256 - 1) / 255
            y, estimate = y[estimate >= TOO_LOW], estimate[estimate >= TOO_LOW]
            new = ~(before[y] == before[x]).any(axis=1)
            y, estimate = y[new], estimate[new]
            joined(docs, roots, x, y[estimate >= CLEAR], kept)
            asked.append((x, y[estimate < CLEAR]))
        wanted = np.zeros(len(docs), dtype=bool)
        for x, y in asked:
            y = y[roots[y] != roots[x]]
            wanted[y] = True
            wanted[x] |= len(y) > 0
        i, j = unit[0].column(1)[0].as_py(), unit[0].column(2)[0].as_py()
        return kept + [(1, band, i, j, blocks[x], docs[x], roots[x]) for x in np.flatnonzero(wanted)]

    def by_shingles(unit: list[pa.RecordBatch]) -> list[tuple]:
        docs, roots, kept = column(unit, 4), column(unit, 5).copy(), []
        sets = Together([(np.frombuffer(d, dtype=np.uint64), np.frombuffer(w)) for d, w in zip(packed(unit, 6), packed(unit, 7), strict=True)])
        for x, first, other in partners(unit, roots):
            joined(docs, roots, x, first + np.flatnonzero(other & (sets.similarities(x, first) >= least)), kept)
        return kept

    names = ["kind", "band", "i", "j", "block", "doc", "other"]

    def each(look: Callable[[list[pa.RecordBatch]], list[tuple]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(np.array(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, unit = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
                for at, end in pairwise([0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]):
                    if now != (key := tuple(keys[:, at])):
                        if unit and (found := look(unit)):
                            yield out(found)
                        now, unit = key, []
                    unit.append(batch.slice(at, end - at))
            if unit and (found := look(unit)):
                yield out(found)

        return run

    def in_units(df: DataFrame, look: Callable[[list[pa.RecordBatch]], list[tuple]]) -> DataFrame:
        dealt = df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block")
        return dealt.mapInArrow(each(look), "kind int, band long, i int, j int, block int, doc long, other long")

    def set_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, held in columns_of(batches):
            for doc, text in zip(docs, held, strict=True):
                found, weights = shingle_set(text, words, weighted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([found.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], ["doc", "data", "weights"])

    seen = stage(in_units(units, by_signatures), "by-signatures")
    asked = seen.where(F.col("kind") == 1).select("band", "i", "j", "block", "doc", F.col("other").alias("root"))
    own_texts = texts.join(asked.select("doc").distinct().hint("shuffle_hash"), "doc").dropDuplicates(["doc", "key"])
    sets = own_texts.select("doc", "text").mapInArrow(set_of, "doc long, data binary, weights binary")
    with_sets = beside(asked, "doc", stage(sets, "shingle-sets"), "doc", crowded(asked, "doc"), F.xxhash64("band", "i", "j"))
    exact = in_units(with_sets.select("band", "i", "j", "block", "doc", "root", "data", "weights"), by_shingles)
    links = seen.where(F.col("kind") == 0).select("doc", "other").unionByName(exact.select("doc", "other"))
    return links.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def crowded(pairs: DataFrame, name: str) -> DataFrame:
    """(doc, parts) of the documents that are ``name`` in more than ``PART`` rows: a staged table, broadcast if it is small."""
    counts = pairs.groupBy(F.col(name).alias("doc")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where(F.col("parts") > 1)
    counts = stage(counts, "crowded")
    return checked_broadcast(counts, counts.count())


def beside(pairs: DataFrame, name: str, rows: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """``pairs`` with the columns of the ``rows`` whose ``key`` is ``name``; a hot one's pairs are dealt over its parts ``by`` a hash."""
    one = lambda: F.coalesce("parts", F.lit(1))
    dealt = pairs.withColumn("_by", by).join(hot.withColumnRenamed("doc", name), name, "left").withColumn("_part", F.pmod("_by", one()).cast("int")).drop("_by", "parts")
    spread = rows.join(hot.withColumnRenamed("doc", key), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one() - 1))).drop("parts")
    return dealt.join(spread.withColumnRenamed(key, name), [name, "_part"]).drop("_part")


def estimated(pairs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """The pairs with ``estimate``, the similarity that their signatures suggest."""
    sketch = lambda name: reps.select(F.col("doc").alias(name), F.col("sketch").alias(f"sketch_{name}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, size) for i in (2, 3))
            agree = (x == y).mean(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((agree * 256 - 1) / 255)], ["a", "b", "estimate"])

    rated = beside(pairs, "a", sketch("a"), "a", crowded(pairs, "a"), F.xxhash64("b"))
    rated = beside(rated, "b", sketch("b"), "b", crowded(pairs, "b"), F.xxhash64("a"))
    return rated.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, estimate double")


def asked_of(pairs: DataFrame, counts_a: DataFrame, counts_b: DataFrame) -> DataFrame:
    """(doc, nth, of, to): to whom, as (a, part of a), each document b sends its shingles; one of its ``of`` parts in a row.

    The counts need not have those of one part.
    """
    numbered = pairs.select("a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64("b", "a").alias("g")).join(counts_a, "a", "left").join(counts_b, "b", "left")
    numbered = numbered.fillna(1, ["parts_a", "parts_b"])
    placed = numbered.select("a", F.pmod("h", "parts_a").cast("int").alias("part"), F.col("b").alias("doc"), F.pmod("g", "parts_b").cast("int").alias("nth"), F.col("parts_b").alias("of"))
    return placed.groupBy("doc", "nth", "of").agg(F.collect_list(F.struct("a", "part")).alias("to"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, weighted: bool, least: float) -> DataFrame:
    """Those of the pairs whose shingles have a similarity of ``least`` or more; ``texts`` is (doc, text), one row for each document.

    Each document's shingles are worked out once and sent to the documents it is paired with, where they are streamed past that
    document's own. A document with very many partners is cut into parts by count on either side: each part of what it is
    compared with is a task's row, and so is each part of those that it is sent to, dealt over the tasks with its text.
    """
    renamed = lambda hot, name: hot.select(F.col("doc").alias(name), F.col("parts").alias(f"parts_{name}"))
    hot_a, hot_b = crowded(pairs, "a"), crowded(pairs, "b")
    asked = asked_of(pairs, renamed(hot_a, "a"), renamed(hot_b, "b"))
    own_parts = pairs.groupBy(F.col("a").alias("doc")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    few = asked.where(F.col("of") == 1).select("doc", "to").join(own_parts, "doc", "full")
    sent = texts.join(few.hint("shuffle_hash"), "doc").select("doc", "text", "to.a", "to.part", "parts")
    some_hot = not hot_b.isEmpty()
    if some_hot:
        hot_texts = stage(texts.join(hot_b.select("doc"), "doc"), "texts-sent-to-many")
        many = asked.where(F.col("of") > 1).join(hot_texts, "doc").select("doc", "text", "to.a", "to.part", "nth")
        many = many.repartition("doc", "nth").select("doc", "text", "a", "part", F.lit(None).cast("int").alias("parts"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in columns_of(batches):
            out: list[tuple] = []
            for doc, text, to, to_part, parts in zip(*columns, strict=True):
                found, weights = shingle_set(text or "", words, weighted)
                data, extra = found.tobytes(), weights.tobytes() if weighted else b""
                for a, p, is_own in chain(((doc, p, True) for p in range(parts or 0)), ((a, p, False) for a, p in zip(to or [], to_part or [], strict=True))):
                    out.append((a, p, is_own, doc, data, extra))
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "part", "own", "doc", "data", "extra"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = mine = None
        read = lambda data, extra: (v := np.frombuffer(data, dtype=np.uint64), np.frombuffer(extra) if weighted else np.ones(len(v)))
        for columns in columns_of(batches):
            out = []
            for a, p, is_own, doc, data, extra in zip(*columns, strict=True):
                if is_own:
                    at, mine = (a, p), read(data, extra)
                elif at == (a, p) and similarity(mine, read(data, extra)) >= least:
                    out.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    shape = "a long, part int, own boolean, doc long, data binary, extra binary"
    moved = sent.mapInArrow(sets, shape)
    if some_hot:
        moved = moved.unionByName(many.mapInArrow(sets, shape))
    return moved.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"), "doc").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, root) for every document in the links (a, b) that is not its component's smallest, which is ``root``."""
    return stars.components(links).withColumnRenamed("id", "doc")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS,
            rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(doc, key, class, n_links) of each row: its class is the smallest id among the documents it is linked to, however far.

    Equal texts are one class from the start, and one row for all that follows; null and empty texts are equal. Rows of one id are one document. ``n_links``
    is the number of other texts that the row's text was found to resemble. A shingle weighs as often as it occurs, or 1 if not ``weighted``. A text of fewer words than a shingle is one
    shingle. Rows without an id count as the lowest integer.
    """
    marked = stage(signed(df, doc_id, text, words, bands, rows, weighted), "signatures")
    reps = stage(marked.groupBy("key").agg(F.min(F.struct("doc", "bands", "sketch", "weight")).alias("x")).select("key", "x.*"), "texts")
    pairs, large = candidates(reps)
    rated = stage(estimated(stage(pairs, "pairs"), reps, bands * rows).where(F.col("estimate") >= TOO_LOW), "estimates")
    texts = keyed(df, doc_id, text).select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = linked(rated, texts, words, weighted, least)
    roots = components(links)
    further = stage(left_out(reps, large, roots, texts, bands * rows, words, weighted, least), "further-links")
    if not further.isEmpty():
        roots = components(further.unionByName(roots.select(F.col("root").alias("a"), F.col("doc").alias("b"))))
        links = links.unionByName(further)
    return settled(marked, reps, links, roots)


def linked(rated: DataFrame, texts: DataFrame, words: int, weighted: bool, least: float) -> DataFrame:
    """Those of the rated pairs that are alike, by their signatures where these are clear, else by their shingles."""
    unclear = rated.where(F.col("estimate") < CLEAR).select("a", "b")
    return stage(rated.where(F.col("estimate") >= CLEAR).select("a", "b").unionByName(verified(unclear, texts.select("doc", "text"), words, weighted, least)), "near-links")


def settled(marked: DataFrame, reps: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("n_links"))
    of_text = reps.select("key", "doc").join(roots, "doc", "left").join(degree, "doc", "left").select(
        "key", F.coalesce("root", "doc").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marked.select("doc", "key").join(of_text, "key").select("doc", "key", "class", "n_links")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept, n_links) of every row; the document with the class's id is the one that is kept."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes(df, doc_id, text).select(
        real("doc").alias("doc_id"), real("class").alias("class_id"), (F.col("doc") == F.col("class")).alias("kept"), F.col("n_links").cast("long").alias("n_links"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each class, as it was: that of the smallest id; of several with this id, that of the smallest hash."""
    first = classes(df, doc_id, text).groupBy("class").agg(F.min(F.struct("doc", "key")).alias("x")).select(F.col("x.doc").alias("_doc"), F.col("x.key").alias("_key"))
    return keyed(df, doc_id, text).join(first.hint("shuffle_hash"), ["_doc", "_key"]).dropDuplicates(["_doc", "_key"]).select(*df.columns)
