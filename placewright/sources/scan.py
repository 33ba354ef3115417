"""Text files as numbered rows, whatever their size, compression or line ends."""

from __future__ import annotations

import gzip
import io
import string
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewright.workspace import stage

ROWS = "file STRING, block LONG, seq LONG, raw STRING, gz BOOLEAN"


def scan(
    spark: SparkSession, paths: str | list[str], line_sep: str | None = None,
    derive: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """(file, rec, pos, raw, ...): rows of the files, ``pos`` counting from 0 without gaps inside a file.

    Files are read in parallel splits. A row's place inside its split is known while it is read; the splits' row counts
    are added up afterwards from one small row per split, so no row is shuffled to be numbered. Rows are staged first,
    since a number given during a scan must not be worked out twice; ``derive`` adds columns to what is staged.

    The default separator is any of LF, CRLF and CR. Bad UTF-8 is replaced. Gzip is recognised by suffix, or by its
    first two bytes where the suffix says nothing. A missing path is an error.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.make_valid_utf8("value").alias("raw"),
        F.expr("_metadata.file_block_start = 0 AND substring(CAST(value AS BINARY), 1, 2) = X'1F8B'").alias("gz"),
    )
    staged = stage(derive(rows), "scan")
    counts = [F.min("seq").alias("first"), F.count("*").alias("rows")]
    blocks = stage(staged.groupBy("file", "block").agg(*counts, F.min_by("gz", "seq").alias("gz")), "blocks")

    zipped = blocks.where("gz").select("file")
    inflated = stage(derive(_inflate(zipped, line_sep)), "inflated")
    staged = staged.join(zipped, "file", "left_anti").unionByName(inflated)
    plain = blocks.drop("gz").join(zipped, "file", "left_anti")
    blocks = plain.unionByName(inflated.groupBy("file", "block").agg(*counts))

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    # One row per split, without a hint: the planner knows the size of the staged blocks.
    own = ("file", "block", "seq", "gz")
    return staged.join(starts, ["file", "block"]).select(
        "file", F.lit(0).cast("long").alias("rec"), (F.col("seq") + F.col("shift")).alias("pos"),
        *[c for c in staged.columns if c not in own],
    )


def _inflate(files: DataFrame, line_sep: str | None) -> DataFrame:
    """Rows of gzip files whose suffix the file system does not know; each is streamed by one task, as any gzip is.

    ``files`` is (file), a table of its own: the paths never reach the driver, and no file is held as a whole. Their
    store must be one that pyarrow opens (local, HDFS, S3, GCS, Azure); in another, give such files the suffix ``.gz``.
    """

    def unzip(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                number = 0
                for held in _batches(_lines(file, line_sep)):
                    columns = [[file] * len(held), [0] * len(held), range(number, number + len(held)), held, [False] * len(held)]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "seq", "raw", "gz"])
                    number += len(held)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(unzip, ROWS)


def _lines(file: str, line_sep: str | None) -> Iterator[str]:
    """The lines of a gzip file that is read as a stream; members that follow each other are one text."""
    scheme, colon, rest = quote(file, safe=string.punctuation).partition(":")  # letters beyond ASCII are still plain in it
    system, path = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)
    newline = None if line_sep is None else ""
    with system.open_input_stream(path, compression=None) as packed, io.TextIOWrapper(gzip.GzipFile(fileobj=packed), "utf-8", "replace", newline) as text:
        if line_sep is None:
            for line in text:
                yield line.removesuffix("\n")
            return
        held = ""
        while chunk := text.read(1 << 20):
            *whole, held = (held + chunk).split(line_sep)
            yield from whole
        if held:
            yield held


def _batches(lines: Iterable[str], rows: int = 50_000, characters: int = 1 << 23) -> Iterator[list[str]]:
    """Lists of lines that are limited in number and, but for a last long line, in length."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if len(held) >= rows or size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held
