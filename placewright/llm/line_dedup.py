"""Removal of lines that many documents share, without moving text.

Each line long enough has a 128-bit hash of its key. The hashes are range-partitioned with their documents, so that a line that
a third of all documents share is spread over as many tasks as it fills, and sorted by hash, document (largest first) and
position. Streaming over a partition, the first document of a run of equal hashes keeps its lines and the others lose theirs
once the run has shown enough documents. Only the runs at the two ends of a partition can go on in another; what is not clear
there is settled from one row of counts for each end. What comes out is a compressed bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placewright.llm.common import columns_of, partitions, stage

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
NO_ID = -(1 << 63)
DROP, OPEN, COUNT = 0, 1, 2
FOUND = "kind int, h1 long, h2 long, doc long, version long, pos int, docs long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def with_row_key(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of ``df`` after the key of a row's text: its id (the lowest integer for null) and a hash of the text."""
    return df.select(
        F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("_version"), *df.columns)


def streamed(min_docs: int):
    """The stream over one sorted partition of (h1, h2, doc, version, pos)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = key = last_doc = keeper = None
        docs, held = 0, []  # documents of the open run so far; its rows while they are too few

        def rows(kind: int, k: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            n = len(part)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(part[:, 0]), pa.array(part[:, 1]),
                 pa.array(part[:, 2].astype(np.int32)), pa.array(np.zeros(n, np.int64))], [c.split()[0] for c in FOUND.split(", ")])

        def count() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((COUNT, *key, keeper, 0, 0, docs), (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64()), strict=True)],
                [c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            keys, rest = table[:, :2], table[:, 2:]
            if key is None:
                first_key = key = (int(keys[0, 0]), int(keys[0, 1]))
                keeper, last_doc, docs = int(rest[0, 0]), None, 0
            before = np.vstack([[key], keys[:-1]])
            new_key = (keys != before).any(axis=1)
            new_doc = new_key | (rest[:, 0] != np.concatenate([[rest[0, 0] if last_doc is None else last_doc], rest[:-1, 0]]))
            if last_doc is None:
                new_doc[0] = True
            run_of = np.cumsum(new_key)  # 0: the open run goes on
            starts = np.flatnonzero(new_key)
            nth = np.cumsum(new_doc)
            n_runs = int(run_of[-1]) + 1
            edges = np.concatenate([starts, [len(table)]])
            through = nth[edges - 1] if n_runs > 1 or len(starts) else nth[[-1]]
            # Documents of each run: those that start in this batch, and for the first those seen before.
            if len(starts) and starts[0] == 0:
                through = np.concatenate([[0], nth[np.concatenate([starts[1:], [len(table)]]) - 1]])
            totals = np.diff(np.concatenate([[0], through]))
            totals[0] += docs
            keepers = np.concatenate([[keeper], rest[starts, 0]])
            ahead = run_of == 0 if key == first_key else np.zeros(len(table), bool)
            if ahead.any():
                yield rows(OPEN, keys[ahead], rest[ahead])
            if key != first_key and held:
                if totals[0] >= min_docs:
                    old = np.vstack(held)
                    old = old[old[:, 0] != keeper]
                    yield rows(DROP, np.tile(key, (len(old), 1)), old)
                    held = []
                elif n_runs > 1:
                    held = []
            drop = ~ahead & (totals[run_of] >= min_docs) & (rest[:, 0] != keepers[run_of])
            if drop.any():
                yield rows(DROP, keys[drop], rest[drop])
            if n_runs > 1:
                if key == first_key:
                    docs = int(totals[0])
                    yield count()
                key, keeper = (int(keys[-1, 0]), int(keys[-1, 1])), int(keepers[-1])
            docs, last_doc = int(totals[-1]), int(rest[-1, 0])
            if key != first_key and docs < min_docs:
                held.append(rest[run_of == n_runs - 1])
        if key is not None:
            if held:
                old = np.vstack(held)
                yield rows(OPEN, np.tile(key, (len(old), 1)), old)
            yield count()

    return run


def bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_doc, _version, n_dropped, keep) of the rows that lose lines, keyed as by ``with_row_key``.

    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents stays in the
    document of largest id only. Rows of one id are one document. ``keep`` is the compressed bitmap of the lines that stay;
    lines after its end stay.
    """
    spark = df.sparkSession
    lines = with_row_key(df, doc_id, text).select("_doc", "_version", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_doc", "_version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_doc", "_version", F.col("pos").cast("int"))
    ordered = hashed.repartitionByRange(partitions(spark), "h1", "h2", F.desc("_doc"), "_version").sortWithinPartitions("h1", "h2", F.desc("_doc"), "_version", "pos")
    found = stage(ordered.mapInArrow(streamed(min_docs), FOUND), "shared-lines")
    # At most two rows for each partition, so this side of the join is bounded by their number.
    ends = found.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("keeper"))
    ends = ends.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    settled = found.where(F.col("kind") == OPEN).join(F.broadcast(ends), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    dropped = found.where(F.col("kind") == DROP).select("doc", "version", "pos").unionByName(settled.select("doc", "version", "pos"))
    lists = dropped.groupBy("doc", "version").agg(F.collect_set("pos").alias("pos"))

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, versions, positions in columns_of(batches):
            maps = []
            for p in positions:
                keep = np.ones(max(p) // 8 * 8 + 8, dtype=bool)  # whole bytes
                keep[p] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array([len(p) for p in positions], pa.int64()), pa.array(maps, pa.binary())],
                ["_doc", "_version", "n_dropped", "keep"])

    return lists.mapInArrow(compress, "_doc long, _version long, n_dropped long, keep binary")


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t: str | None, bits: bytes | None) -> str | None:
        if bits is None:
            return t
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)).tolist()
        return "\n".join(line for i, line in enumerate((t or "").split("\n")) if i >= len(flags) or flags[i])

    return pd.Series([one(t, b) for t, b in zip(text, keep, strict=True)], dtype=object)


def without_shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``df`` with the lines that stay as ``text``, and two more columns: ``_n_lines`` before and ``_n_dropped``.

    A null or empty text is one empty line; a null stays null. Repeated rows lose the same lines. All other columns stay.
    """
    marks = bitmaps(df, doc_id, text, min_chars, min_docs)
    joined = with_row_key(df, doc_id, text).join(marks.hint("shuffle_hash"), ["_doc", "_version"], "left")
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[kept_text(F.col(c), F.col("keep")).alias(c) if c == text else F.col(c) for c in df.columns],
        F.coalesce(n_lines, F.lit(1)).cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"))
