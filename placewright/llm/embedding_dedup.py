"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is kept as 8-bit codes q and a scale s, u = s q + e. By Cauchy and Schwarz the cosine of two of them differs from
s s' (q . q') by no more than |s q| |e'| + |e| |s' q'| + |e| |e'|, where the lengths are known for each vector. Products of codes are
worked out tile against tile: as sums of integers below 2^24 they are exact in single precision, which lets one matrix product
serve. A pair that is certainly below the threshold is done, one certainly above is a link, and only a pair between is worked out
again from the unit vectors in double precision.

Vectors are laid into tiles by the nearest of some pivots. Each tile keeps the range of its vectors' angles to every pivot, and two
tiles whose ranges lie further apart than the threshold's angle never meet. Equal vectors are one row with a number of copies. What
leaves a pair of tiles is a row for each linked vector, its number of links and the smallest vector of its group there, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import new_folder, partitions, stage
from placewright.llm.fingerprints import mixed
from placewright.llm.stars import components
from placewright.llm.vectors import NO_ID, Held, dimension, doubles, matrix, put

COSINE = 0.9
#: Bytes of a tile's vectors, about, and the most vectors in it.
TILE_BYTES, TILE = 32 << 20, 32_768
#: Vectors on either side of one matrix product.
BLOCK = 1024
#: The most pivots; they are the distinct vectors with the smallest hashes of their ids.
PIVOTS = 1024
#: The widest product of codes whose sum is exact in single precision.
EXACT = (1 << 24) // (127 * 127)
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-6


def units(x: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows can have that: those that are ``fine`` and not zero."""
    most = np.abs(np.where(fine[:, None], x, 0)).max(axis=1, initial=0)
    fine = fine & (most > 0)
    x = np.where(fine[:, None], x, 0) / np.where(fine, most, 1)[:, None]
    return x / np.where(fine, np.sqrt((x * x).sum(axis=1)), 1)[:, None], fine


class Tile:
    """Unit vectors with their codes, scales, code lengths and error lengths."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.vec, self.copies, self.unit = arrays["vec"], arrays["copies"], arrays["unit"]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        coded = self.codes * self.scale[:, None]
        self.length = np.sqrt((coded * coded).sum(axis=1)) * (1 + 1e-9)
        self.error = np.sqrt(((self.unit - coded) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12

    def __len__(self) -> int:
        return len(self.vec)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of two blocks of codes, exact: in single precision by as many components at a time as that allows."""
    parts = [a[:, k:k + EXACT].astype(np.float32) @ b[:, k:k + EXACT].astype(np.float32).T for k in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def linked(a: Tile, b: Tile, least: float, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x in a, y in b) of the pairs with a cosine of ``least`` or more; x < y where the tiles are one."""
    for r in range(0, len(a), block):
        rows = slice(r, r + block)
        for c in range(r if a is b else 0, len(b), block):
            columns = slice(c, c + block)
            products = product(a.codes[rows], b.codes[columns])
            slack = a.length[rows] * b.error[columns].max() + a.error[rows] * (b.length[columns] + b.error[columns]).max() + SCORE_SLACK
            x, y = np.nonzero(products * b.scale[columns].astype(products.dtype) >= ((least - slack) / a.scale[rows])[:, None])
            if a is b and r == c:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 1 << 18):
                i, j = x[at:at + (1 << 18)], y[at:at + (1 << 18)]
                score, i, j = products[i, j].astype(np.float64), i + r, j + c
                score *= a.scale[i] * b.scale[j]
                bound = a.length[i] * b.error[j] + a.error[i] * (b.length[j] + b.error[j]) + 1e-9
                sure, maybe = score - bound >= least, np.flatnonzero(np.abs(score - least) <= bound)
                for part in np.array_split(maybe, len(maybe) // 4096 + 1):
                    sure[part] = (a.unit[i[part]] * b.unit[j[part]]).sum(axis=1) >= least
                yield i[sure], j[sure]


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels, each that of a smaller or equal position of the same group, after the groups of x and y have become one."""
    while True:
        at, to = label[x], label[y]
        differ = at != to
        if not differ.any():
            return label
        x, y, at, to = x[differ], y[differ], at[differ], to[differ]
        np.minimum.at(label, np.maximum(at, to), np.minimum(at, to))
        while not np.array_equal(label, after := label[label]):
            label = after


def met(a: Tile, b: Tile, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vec, root, n) of the vectors with links between two tiles, or within one: the smallest vector of the group there, and the links."""
    shift = 0 if a is b else len(a)
    count, label = np.zeros(len(a) + (len(b) if shift else 0), dtype=np.int64), np.arange(len(a) + (len(b) if shift else 0))
    for x, y in linked(a, b, least):
        np.add.at(count, x, b.copies[y])
        np.add.at(count, y + shift, a.copies[x])
        label = joined(label, x, y + shift)
    vec = np.concatenate([a.vec, b.vec]) if shift else a.vec
    smallest = vec.copy()
    np.minimum.at(smallest, label, vec)
    found = np.flatnonzero(count)
    return vec[found], smallest[label[found]], count[found]


def marked(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec, key, unit) of each row: the unit vector and its hash, or neither where a vector can't have links."""
    dim = dimension(df, vector)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fine = units(*matrix(batch.column(1), dim))
            data = [u.tobytes() if f else None for u, f in zip(x + 0.0, fine, strict=True)]
            keys = [d and hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec", "key", "unit"])

    rows = df.select(F.coalesce(df[vec_id].cast("long"), F.lit(NO_ID)).alias("vec"), doubles(df[vector]).alias("v"))
    return stage(rows.mapInArrow(run, "vec long, key binary, unit binary"), "unit-vectors"), dim


def tiled(distinct: DataFrame, rows: int, dim: int, folder: str, tile: int) -> tuple[DataFrame, int]:
    """Write the distinct vectors as tiles; (tile, name, low, high) with the ranges of angles to the pivots, and the number of tiles.

    The vectors nearest to one pivot are a tile, or as many tiles, by a hash, as their number takes.
    """
    spark = distinct.sparkSession
    tile = min(tile, max(256, TILE_BYTES // (9 * dim)))
    wanted = min(PIVOTS, 2 * max(math.ceil(rows / tile), math.ceil(math.sqrt(4 * partitions(spark)))))
    sample = distinct.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("unit").collect()  # PIVOTS rows at most
    pivots = np.frombuffer(b"".join(r.unit for r in sample)).reshape(-1, dim)

    def near(batch: pa.RecordBatch) -> np.ndarray:
        return (np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(-1, dim) @ pivots.T).argmax(axis=1)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((np.bincount(near(batch), minlength=len(pivots)) for batch in batches if batch.num_rows), np.zeros(len(pivots), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(n)], ["pivot", "n"])

    sizes = dict(distinct.select("unit").mapInArrow(counted, "pivot long, n long").groupBy("pivot").agg(F.sum("n")).collect())  # a row for each pivot
    parts = np.array([-(-sizes[p] // tile) for p in range(len(pivots))], dtype=np.int64)
    begins, count = np.cumsum(parts) - parts, int(parts.sum())

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = near(batch)
            spread = (mixed(batch.column(0).to_numpy().view(np.uint64) + np.uint64(1)) % np.maximum(parts[at], 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((begins[at] + spread).astype(np.int32)), *batch.columns], ["tile", "vec", "copies", "unit"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def done() -> pa.RecordBatch:
            vec, copies = (np.concatenate([part.column(k).to_numpy() for part in own]) for k in (1, 2))
            unit = np.frombuffer(b"".join(v for part in own for v in part.column(3).to_pylist())).reshape(-1, dim)
            angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([put(folder, vec=vec, copies=copies, unit=unit)]), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (angles.min(axis=0), angles.max(axis=0))]],
                ["tile", "name", "low", "high"])

        for batch in batches:
            tiles = batch.column(0).to_numpy()
            for at, end in pairwise([0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]):
                if at < end and tiles[at] != now:
                    if own:
                        yield done()
                    now, own = int(tiles[at]), []
                own.append(batch.slice(at, end - at))
        if own:
            yield done()

    placed = distinct.select("vec", "copies", "unit").mapInArrow(place, "tile int, vec long, copies long, unit binary").repartition(max(1, count), "tile")
    return stage(placed.sortWithinPartitions("tile", "vec").mapInArrow(write, "tile int, name string, low array<double>, high array<double>"), "tiles"), count


def facing(tiles: DataFrame, count: int, least: float) -> DataFrame:
    """(first, second), the names of each two tiles that may have links, and of each with itself."""
    reach = F.lit(math.acos(min(1.0, max(-1.0, least))) + ANGLE_SLACK)
    one = tiles.select("tile", F.col("name").alias("first"), F.col("low").alias("low_1"), F.col("high").alias("high_1"), F.explode(F.sequence(F.col("tile"), F.lit(max(0, count - 1)))).alias("other"))
    two = tiles.select(F.col("tile").alias("other"), F.col("name").alias("second"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    apart = lambda low, high: F.exists(F.zip_with(low, high, lambda a, b: a - b > reach), lambda x: x)
    return one.join(two, "other").where(~apart("low_1", "high_2") & ~apart("low_2", "high_1")).select("first", "second")


def links(distinct: DataFrame, dim: int, least: float, tile: int) -> DataFrame:
    """(vec, root, n) of the vectors with links, for each two tiles."""
    spark, folder = distinct.sparkSession, new_folder(distinct.sparkSession, "vector-tiles")
    tiles, count = tiled(distinct, distinct.count(), dim, folder, tile)
    pairs = stage(facing(tiles, count, least), "tile-pairs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(folder, 2, Tile)
        for batch in batches:
            for first, second in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in met(held[first], held[second], least)], ["vec", "root", "n"])

    tasks = max(1, min(pairs.count(), 8 * partitions(spark)))
    return stage(pairs.repartition(tasks).mapInArrow(run, "vec long, root long, n long"), "vector-links")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: its links, and the smallest id that they reach.

    Vectors that are null, empty, zero or hold a null or non-finite component have no links. Shorter vectors count as ending in
    zeros. Equal vectors, also of rows that are repeated, are linked with each other. Rows of one id are one vertex, whose links are
    summed. A row without an id counts as the lowest integer and is given back without one. Other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must lie above 0, up to 1")
    rows, dim = marked(df, vec_id, vector)
    fit = rows.where(F.col("key").isNotNull())
    distinct = stage(fit.groupBy("key").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "distinct-vectors")
    found = links(distinct, dim, least, tile)
    roots = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    n_links = found.groupBy("vec").agg(F.sum("n").alias("n"))
    of_key = distinct.select("key", "vec", "copies").join(n_links, "vec", "left").join(roots.withColumnRenamed("id", "vec"), "vec", "left").select(
        "key", F.coalesce("root", "vec").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    alone = rows.where(F.col("key").isNull()).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    settled = fit.select("vec", "key").join(of_key, "key").select("vec", "n_links", "component").unionByName(alone)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return settled.select(real("vec").alias("vec_id"), "n_links", real("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))
