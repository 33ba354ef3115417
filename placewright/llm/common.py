"""Helpers shared by the operators: reading tables, bounded memos, Arrow batches, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.workspace import folder, stage

__all__ = ["Memo", "checked_broadcast", "columns_of", "documents", "file_system", "new_folder", "partitions", "stage", "table", "text_rows"]

#: Rows of a table that may be broadcast, after they have been counted; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Memo(dict):
    """Results of a pure function, at most ``limit`` of them; keys over ``longest`` characters are worked out each time."""

    def __init__(self, make: Callable[[Any], Any], limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def columns_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield [column.to_pylist() for column in batch.columns]


def text_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts of each batch of (id, text); a null text is an empty one."""
    for ids, texts in columns_of(batches):
        yield ids, [t or "" for t in texts]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the session's shared one."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
