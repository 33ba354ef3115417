"""Hard negatives by cover trees over norm-augmented candidates.

Each candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its tree, so that all have the norm M and the
nearest to an anchor are those of the largest inner product. A node covers its points within a radius: below the root the
radii of a level are at most a power of ``BASE``, and the centres of one node's children lie further apart than that. For an anchor q, a node
with centre c and radius r holds only scores from q.c - |q| r to q.c + |q| r.

Candidates are dealt over groups by their nearest of some pivots and written as trees of bounded size. All anchors, in blocks, meet
all groups. In a group the node with the best bound goes first; it is left out for anchors none of whose windows it can improve, and points are
verified by exact integer products. Two passes: the first finds each anchor's positives, the second fills the windows below them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import new_folder, partitions, stage
from placewright.llm.vectors import Held, dimension, doubles, get, matrix, put

BASE = 1.3
#: Points of a tree; points below which a node isn't divided; points of a group of trees; anchors in a block.
TREE, LEAF, GROUP, ANCHORS = 2048, 32, 65_536, 1024
PIVOTS = 64
POSITIVES = NEGATIVES = 5
SCALE, CLASSES, MOVED, EVERY = 256, 10, 7, 100
#: The least share of the positive's score that a negative's must have, in hundredths; the most is the positive's own.
LEAST = 80
#: Integers are exact in double precision up to here.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1
FOUND = "anchor long, nth int, id long, score long"


class Tree:
    """A cover tree over the rows of ``x``. A node is (centre, radius, first child, children, first own point, own points).

    Own points are those verified with the node itself: children that cover nothing but themselves, or all points of a small node.
    """

    def __init__(self, x: np.ndarray):
        norms = (x * x).sum(axis=1)
        full = np.hstack([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]])
        squares = (full * full).sum(axis=1)
        far = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (full @ full.T), 0))
        slack = 1e-6 * math.sqrt(squares.max()) + 1e-12  # for what the line before loses by cancellation
        self.order: list[int] = []
        self.nodes: list[tuple[int, float, int, int, int, int]] = []
        waiting = [(0, np.arange(len(x)))]
        ahead = 0
        while ahead < len(waiting):  # children follow their parent's siblings' children, so those of a node are together
            centre, points = waiting[ahead]
            ahead += 1
            radius, first, begin = float(far[centre, points].max()), len(waiting), len(self.order)
            if len(points) <= LEAF or radius <= slack:
                self.order += points.tolist()
            else:
                below = BASE ** (math.ceil(math.log(radius, BASE)) - 1)
                left, at = points, centre
                while len(left):
                    inside = far[at, left] <= min(below, radius * (1 - 1e-9))
                    own, left = left[inside], left[~inside]
                    if len(own) > 1:
                        waiting.append((at, own))
                    else:
                        self.order.append(at)
                    at = int(left[0]) if len(left) else at
            self.nodes.append((centre, radius + slack, first, len(waiting) - first, begin, len(self.order) - begin))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; beyond the range of a long its ends."""
    reach = math.sqrt((q * q).sum(axis=1).max(initial=0)) * math.sqrt((x * x).sum(axis=1).max(initial=0))
    if reach < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.float64)
    if reach < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -LONGEST, LONGEST).astype(np.int64)


class Forest:
    """A group's trees: ids, labels and integer vectors of all points, and the nodes of all trees."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.labels, self.x = arrays["ids"], arrays["labels"], arrays["x"].astype(np.float64)
        self.order, self.nodes, self.radii, self.roots = arrays["order"], arrays["nodes"], arrays["radii"], arrays["roots"]


def planted(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a forest; a node is (centre, first child, children, first own point, own points)."""
    order, nodes, radii, roots = [], [], [], []
    for at in range(0, len(x), TREE):
        tree = Tree(x[at:at + TREE])
        base, points = len(nodes), len(order)
        roots.append(base)
        nodes += [(centre + at, first + base, children, begin + points, own) for centre, _, first, children, begin, own in tree.nodes]
        radii += [node[1] for node in tree.nodes]
        order += [p + at for p in tree.order]
    small = x.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x
    return {"ids": ids, "labels": labels, "x": small, "order": np.array(order), "nodes": np.array(nodes), "radii": np.array(radii), "roots": np.array(roots)}


class Search:
    """The best ``most`` points in each window of each anchor of a block: those of the greatest score, of equal ones the smallest id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.ids, self.labels, self.q, self.same, self.most = ids, labels, q, same, most
        self.norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
        self.high, self.least = high, low.copy()
        self.at, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))  # anchor and window of each point found
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(self) -> None:
        """Merge the points that wait into the best, and raise the least scores that still count."""
        at, ids, score = (np.concatenate(c) for c in zip((self.at, self.id, self.score), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        last = nth == self.most - 1
        self.least.reshape(-1)[at[last]] = score[last]
        self.at, self.id, self.score = at[nth < self.most], ids[nth < self.most], score[nth < self.most]

    def verify(self, forest: Forest, points: np.ndarray, who: np.ndarray) -> None:
        """Look at points exactly, for the anchors ``who``."""
        score = exact(self.q[who], forest.x[points])
        wanted = (self.labels[who][:, None] == forest.labels[points][None, :]) == self.same
        i, j = np.nonzero(wanted & (score >= self.least[who].min(axis=1)[:, None]))
        anchor, ids, score = who[i], forest.ids[points[j]], score[i, j]
        other = ids != self.ids[anchor]
        anchor, ids, score = anchor[other], ids[other], score[other]
        windows = self.high.shape[1]
        parts = [np.flatnonzero((score >= self.least[anchor, w]) & (score <= self.high[anchor, w])) for w in range(windows)]
        at = np.concatenate([anchor[p] * windows + w for w, p in enumerate(parts)])
        if len(at):
            some = np.concatenate(parts)
            self.waiting.append((at, ids[some], score[some].astype(np.int64)))
            if sum(len(w[0]) for w in self.waiting) > 2 * self.least.size:
                self.keep()

    def of_use(self, who: np.ndarray, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors and nodes: whether a window may gain from the node, and the node's bound."""
        reach = self.norm[who][:, None] * radius[None, :] + 1e-9 * np.abs(score) + 1e-6
        bound = score + reach
        useful = np.zeros(bound.shape, dtype=bool)
        for w in range(self.high.shape[1]):
            useful |= (bound >= self.least[who, w][:, None]) & (score - reach <= self.high[who, w][:, None])
        return useful, bound

    def descend(self, forest: Forest) -> None:
        """Search a group's trees best-first; points of nodes that no window can gain from are not looked at."""
        queue: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def push(nodes: np.ndarray, who: np.ndarray) -> None:
            centres = forest.nodes[nodes, 0]
            score = exact(self.q[who], forest.x[centres]).astype(np.float64)
            useful, bound = self.of_use(who, score, forest.radii[nodes])
            for k in np.flatnonzero(useful.any(axis=0)):
                own = useful[:, k]
                heappush(queue, (-float(bound[own, k].max()), int(nodes[k]), who[own], score[own, k]))

        push(forest.roots, np.arange(len(self.q)))
        while queue:
            _, node, who, score = heappop(queue)
            useful, _ = self.of_use(who, score[:, None], forest.radii[[node]])  # the best may have improved since
            who = who[useful[:, 0]]
            if not len(who):
                continue
            _, first, children, begin, own = forest.nodes[node]
            if own:
                self.verify(forest, forest.order[begin:begin + own], who)
            if children:
                push(np.arange(first, first + children), who)
        self.keep()


def candidates(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(id, label, x) of the rows that take part, one for each id; ``x`` holds integers as doubles."""
    dim = dimension(df, vector)
    rows = df.select(df[vec_id].cast("long").alias("id"), df[label].cast("long").alias("label"), doubles(df[vector]).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("label", F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fine = matrix(batch.column(2), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
            fine &= np.isfinite(x).all(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(pa.array(fine)) for k in (0, 1)], pa.array([v.tobytes() for v in x[fine]], pa.binary())], ["id", "label", "x"])

    whole = rows.mapInArrow(run, "id long, label long, x binary")
    return stage(whole.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x"), "candidates"), dim


def index(rows: DataFrame, dim: int, folder: str, group: int) -> DataFrame:
    """Write all rows as groups of cover trees; the name (forest) of each."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()  # PIVOTS rows at most
    pivots = np.frombuffer(b"".join(r.x for r in sample)).reshape(-1, dim)
    half = (pivots * pivots).sum(axis=1) / 2
    count = max(math.ceil(rows.count() / group), partitions(spark))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array((x @ pivots.T - half).argmax(axis=1).astype(np.int32)), *batch.columns], ["near", "id", "label", "x"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, data = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            labels.append(batch.column(1).to_numpy())
            data += batch.column(2).to_pylist()
        if not data:
            return
        x = np.frombuffer(b"".join(data)).reshape(-1, dim)
        name = put(folder, **planted(np.concatenate(ids), np.concatenate(labels), x))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["forest"])

    placed = rows.mapInArrow(near, "near int, id long, label long, x binary").repartitionByRange(count, "near", F.xxhash64("id"))
    return stage(placed.sortWithinPartitions("near", "id").select("id", "label", "x").mapInArrow(write, "forest string"), "tree-files")


def anchor_blocks(rows: DataFrame, dim: int, folder: str, block: int) -> tuple[DataFrame, int]:
    """Write anchors (id, label, x, low, high) as blocks of about ``block``; (nth, name) of each, and the number of blocks.

    ``low`` and ``high`` are arrays of the bounds of an anchor's windows; those of fewer windows are filled with an empty one.
    """
    count = max(1, math.ceil(rows.count() / block))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_pylist() for c in batch.columns] for batch in batches]
        ids, labels, data, low, high = ([v for part in parts for v in part[k]] for k in range(5))
        if ids:
            windows = max(map(len, low))
            filled = lambda v, empty: np.array([[*own, *[empty] * (windows - len(own))] for own in v], dtype=np.int64).reshape(len(v), windows)
            name = put(folder, ids=np.array(ids), labels=np.array(labels), x=np.frombuffer(b"".join(data)).reshape(-1, dim), low=filled(low, LONGEST), high=filled(high, -LONGEST))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name])], ["nth", "name"])

    dealt = rows.select("id", "label", "x", "low", "high").repartition(count, "id")
    return stage(dealt.mapInArrow(write, "nth int, name string"), "anchor-files"), count


def searched(forests: DataFrame, blocks: DataFrame, count: int, folder: str, same: bool, most: int) -> DataFrame:
    """(anchor, nth, id, score): the best ``most`` of each group for the ``nth`` window of each anchor. Each block meets each group."""
    spark = forests.sparkSession
    units = forests.select("forest", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("nth")).join(blocks, "nth").select("forest", "name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(folder, 1, Forest)
        for batch in batches:
            for forest, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = get(folder, name)
                search = Search(own["ids"], own["labels"], own["x"], own["low"], own["high"], same, most)
                search.descend(held[forest])
                windows = search.high.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own["ids"][search.at // windows]), pa.array((search.at % windows).astype(np.int32)), pa.array(search.id), pa.array(search.score)], ["anchor", "nth", "id", "score"])

    tasks = max(1, min(units.count(), 8 * partitions(spark)))
    found = units.repartition(tasks).sortWithinPartitions("forest").mapInArrow(run, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= most)


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   group: int = GROUP, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, ids divisible by ``EVERY``.

    Rows with a null id, label or vector, or with a null or non-finite component, or one whose multiple isn't finite, take no part.
    Shorter vectors count as ending in zeros, an empty one is all zeros. Of rows of one id that of the least label, then of the least
    bytes, counts. Equal scores go by id. An anchor without positives, or a positive without rows in its window, gives no rows; a negative
    positive score has an empty window. Scores beyond the range of a long count as its ends. Other columns are not read.
    """
    rows, dim = candidates(df, vec_id, vector, label)
    folder = new_folder(df.sparkSession, "cover-trees")
    forests = index(rows, dim, folder, group)
    asked = rows.where(F.col("id") % EVERY == 0)
    anywhere = asked.select("*", F.array(F.lit(-LONGEST)).alias("low"), F.array(F.lit(LONGEST)).alias("high"))
    best = searched(forests, *anchor_blocks(anywhere, dim, folder, block), folder, True, positives)
    best = stage(best.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"{LEAST} * (positive_score div 100) + ({LEAST} * (positive_score % 100) + 99) div 100")  # rounded up, without overflow
    low = F.when(F.col("positive_score") >= 0, least).otherwise(LONGEST)
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", low.alias("low"), F.col("positive_score").alias("high")))).alias("w"))
    below = asked.join(windows, asked["id"] == windows["anchor"]).select("id", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = searched(forests, *anchor_blocks(stage(below, "windows"), dim, folder, block), folder, False, negatives)
    return found.join(best, ["anchor", "nth"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
