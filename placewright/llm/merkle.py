"""Merkle manifest by time-forward processing.

The nodes of a tree are labelled level by level, so that a node comes after its children. Upwards, a queue ordered by label hands
each node the digests that its children have sent; downwards, a queue in reversed order hands each node what lies beside its path to
the root. Between tasks the queue is Spark's sorted shuffle: positions are cut into blocks of ``RUN`` ** ``LEVELS`` nodes, whose digests
are the nodes of the next tier. Inside a block it is a heap. A source with a third of all documents is many blocks, and the number of
shuffles is that of the tiers, one for each ``LEVELS`` levels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import checked_broadcast, columns_of, partitions, stage

RUN, LEVELS = 3, 6
SIZE = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """The labels of a tree over ``n`` leaves: those of a level follow those of the level below. It ends at a single node."""

    def __init__(self, n: int, levels: int):
        self.begins, size = [0], n
        for _ in range(levels):
            self.begins.append(self.begins[-1] + size)
            size = -(-size // RUN)
        self.end = self.begins[-1] + size

    def level(self, label: int) -> int:
        return next(k for k in range(len(self.begins) - 1, -1, -1) if label >= self.begins[k])


def swept_up(digests: list[str], levels: int) -> list[str]:
    """The digests of all nodes by label; each level's runs become the nodes above it."""
    block, out = Block(len(digests), levels), list(digests)
    queue: list[tuple[int, int, str]] = []
    level = 0

    def send(label: int) -> None:
        heappush(queue, (block.begins[level + 1] + (label - block.begins[level]) // RUN, label, out[label]))

    if levels:
        for label in range(len(digests)):
            send(label)
    for label in range(len(digests), block.end):
        text = ""
        while queue and queue[0][0] == label:
            text += heappop(queue)[2]
        out.append(digest(text))
        level += label == block.begins[level + 1]
        if level < levels:
            send(label)
    return out


def swept_down(digests: list[str], n: int, levels: int, steps: str) -> list[str]:
    """For each leaf what lies beside its path, from itself up: ``left|right`` for each level, between semicolons, then ``steps``."""
    block = Block(n, levels)
    queue, out = [(-(block.end - 1), steps)], [""] * n
    while queue:
        label, beside = heappop(queue)
        label = -label
        level = block.level(label)
        if not level:
            out[label] = beside
            continue
        first = block.begins[level - 1] + (label - block.begins[level]) * RUN
        run = digests[first:min(first + RUN, block.begins[level])]
        for k in range(len(run)):
            own = f"{''.join(run[:k])}|{''.join(run[k + 1:])}"
            heappush(queue, (-(first + k), f"{own};{beside}" if beside else own))
    return out


def folded(leaf: str, steps: str) -> str:
    """The root that a leaf gives with what lies beside its path."""
    for step in steps.split(";") if steps else ():
        left, right = step.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def proof(steps: str) -> str:
    return digest(steps.replace("|", "").replace(";", ""))


def height(total: int) -> int:
    """The levels above ``total`` nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // RUN), levels + 1
    return levels


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` within their group, from 0, and the group's ``total``, in ascending ``order``.

    Rows are range-partitioned and numbered by their place in the partition; a row for each group of each partition gives the rest.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    placed = stage(cut.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    same = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stage(runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(same).alias("total")), "runs")
    joined = placed.withColumn("_part", part).join(checked_broadcast(runs, runs.count()), [group, "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """A row for each block of (grp, pos, total, digest, ...), with its nodes in order as ``items``: at most ``SIZE`` of them."""
    others = [c for c in nodes.columns if c not in ("grp", "pos", "total")]
    packed = nodes.groupBy("grp", F.expr(f"pos div {SIZE}").alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", *others))).alias("items"))
    return stage(packed, "merkle-blocks")


def risen(blocks: DataFrame) -> DataFrame:
    """The blocks' digests as the nodes of the next tier: (grp, pos, total, digest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, block, totals, digests in columns_of(batches):
            tops = [swept_up(d, min(LEVELS, height(t)))[-1] for d, t in zip(digests, totals, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(block, pa.int64()), pa.array([-(-t // SIZE) for t in totals], pa.int64()), pa.array(tops, pa.string())],
                                             ["grp", "pos", "total", "digest"])

    return blocks.select("grp", "block", "total", "items.digest").mapInArrow(run, "grp string, pos long, total long, digest string")


def tiers_of(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier of (grp, pos, total, digest, ...), and (grp, digest) of each group's root."""
    most, tiers = nodes.agg(F.max("total")).first()[0] or 0, []
    while True:
        tiers.append(blocks_of(nodes))
        nodes = risen(tiers[-1])
        if most <= SIZE:
            return tiers, nodes.select("grp", "digest")
        most = -(-most // SIZE)


def fallen(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    """(grp, pos, steps, subroot) of the nodes of a tier's blocks, from those of the blocks, which are the nodes of the next tier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, positions, totals, digests, above, subroots in columns_of(batches):
            for g, p, t, d, a, s in zip(groups, positions, totals, digests, above, subroots, strict=True):
                levels = min(LEVELS, height(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(p), pa.string()), pa.array(p, pa.int64()), pa.array(swept_down(swept_up(d, levels), len(d), levels, a), pa.string()), pa.array([s] * len(p), pa.string())],
                    ["grp", "pos", "steps", "subroot"])

    return beside(blocks, steps).select("grp", "items.pos", "total", "items.digest", "steps", "subroot").mapInArrow(run, "grp string, pos long, steps string, subroot string")


def beside(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    steps = stage(steps.withColumnRenamed("pos", "block"), "proof-steps")
    return blocks.join(checked_broadcast(steps, steps.count()), ["grp", "block"])


def descended(tiers: list[DataFrame], steps: DataFrame) -> DataFrame:
    """The lowest tier's blocks with ``steps`` and ``subroot``, from (grp, pos, steps, subroot) of each group's root."""
    for blocks in reversed(tiers[1:]):
        steps = fallen(blocks, steps)
    return beside(tiers[0], steps)


def leaf_of(columns: dict[str, Column]) -> Column:
    written = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in written]), 256)


def leaves(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, grp, digest, tampered): the leaf, and the tampered one where the row is to be tampered with. ``grp`` sorts as the source does, null first."""
    doc_id, source, _, _, text = fields
    own = {c: df[c] for c in fields}
    hit = F.crc32(df[doc_id].cast("string")) % 2 == 0
    changed = leaf_of(own | {text: F.replace(df[text], F.lit("\n"), F.lit(""))})
    return df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), df[source]), F.lit("")).alias("grp"), leaf_of(own).alias("digest"), F.when(hit, changed).alias("tampered"))


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, for the trees of sources and the tree above them.

    Each field counts, null as ``-``; a null id comes first and is never tampered with. Rows of one id are ordered by their leaves, so repeated rows
    are leaves of their own with equal digests. Null and empty sources are two sources. An empty table has no rows. Other columns don't count.
    """
    spark = df.sparkSession
    rows = stage(leaves(df, fields), "leaves")
    if rows.isEmpty():
        return spark.createDataFrame([], MANIFEST)
    tiers, subroots = tiers_of(numbered(rows, "grp", ["doc_id", "digest"]))
    subroots = stage(subroots, "subroots")
    upper = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest"), "grp", ["source"])
    upper_tiers, top = tiers_of(upper)
    root = top.first()["digest"]
    start = top.select("grp", F.lit(0).cast("long").alias("pos"), F.lit("").alias("steps"), F.lit(root).alias("subroot"))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for totals, sources, digests, above in columns_of(batches):
            for t, s, d, a in zip(totals, sources, digests, above, strict=True):
                levels = min(LEVELS, height(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.string()), pa.array([0] * len(s), pa.int64()), pa.array(swept_down(swept_up(d, levels), len(d), levels, a), pa.string()), pa.array(d, pa.string())],
                    ["grp", "pos", "steps", "subroot"])

    steps = descended(upper_tiers, start).select("total", "items.source", "items.digest", "steps").mapInArrow(spread, "grp string, pos long, steps string, subroot string")

    def prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for totals, ids, digests, tampered, above, subroot in columns_of(batches):
            for t, i, d, x, a, s in zip(totals, ids, digests, tampered, above, subroot, strict=True):
                levels = min(LEVELS, height(t))
                paths = swept_down(swept_up(d, levels), len(d), levels, a)
                found = [folded(x[k] or d[k], p) for k, p in enumerate(paths)]
                columns = (i, d, [s] * len(d), [root] * len(d), [proof(p) for p in paths], found, [f == root for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    return descended(tiers, steps).select("total", "items.doc_id", "items.digest", "items.tampered", "steps", "subroot").mapInArrow(prove, MANIFEST)
