"""Lookup tables (key, val) kept as Parquet: whole, one folder per version, or in buckets that are replaced one by one.

A bucketed table is a folder ``data`` of bucket folders and a folder ``versions`` of small files, each of which names the bucket folders of a
version. A merge writes the buckets that it changes anew and lists the other ones as they are. A version's file can be created only
once, so of two writers that start from one version the second fails and nothing of it is seen.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.schemas import LOOKUP_SCHEMA
from placewright.workspace import stage

BUCKETS = 64


class VersionConflict(RuntimeError):
    """Another writer has made the next version of a table already."""


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 when there is none."""
    try:
        return spark.read.schema(f"{LOOKUP_SCHEMA}, version LONG").parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The newest version, and whether there is none: a missing table reads as an empty one."""
    version = _newest(spark, path)
    if not version:
        return spark.createDataFrame([], LOOKUP_SCHEMA), True
    return spark.read.schema(LOOKUP_SCHEMA).parquet(f"{path}/version={version}"), False


def write_table(table: DataFrame, path: str) -> int:
    """Write a new version beside the old ones, never over files that the plan of ``table`` may still read."""
    version = _newest(table.sparkSession, path) + 1
    table.select("key", "val").write.parquet(f"{path}/version={version}")
    return version


def _files(spark: SparkSession, path: str):
    """The file system and path object of a path, for the few small files that the driver lists and creates."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    system, where = _files(spark, f"{path}/versions")
    if not system.exists(where):
        return []
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def layout(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """The folder of each bucket that has rows; none for version 0."""
    if not version:
        return {}
    text = spark.read.option("wholetext", True).text(f"{path}/versions/{version:012d}.json").first()[0]
    return {int(bucket): folder for bucket, folder in json.loads(text).items()}


def _rows(spark: SparkSession, folders: dict[int, str]) -> DataFrame:
    paths = [f"{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.schema(LOOKUP_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOOKUP_SCHEMA)


def read_merged(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, int]:
    """A bucketed table as of a version, the newest if none is given, and that version; an empty table and 0 if there is none."""
    if version is None:
        version = max(versions(spark, path), default=0)
    return _rows(spark, layout(spark, path, version)), version


def merge(changes: DataFrame, path: str, version: int | None = None) -> int:
    """Fold ``changes`` (seq, key, val) into a bucketed table, the last one per key winning, a null ``val`` taking the key away.

    ``version`` is the version that the changes were made from; if it isn't the newest any more, or another writer comes first,
    VersionConflict is raised and the table stays as it is. Returns the new version. Buckets without a change keep their files.
    """
    spark = changes.sparkSession
    newest = max(versions(spark, path), default=0)
    if version is not None and version != newest:
        raise VersionConflict(f"version {version} of {path} isn't the newest, {newest}")
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    last = changes.groupBy("key").agg(F.max(F.struct("seq", F.struct("val").alias("to"))).alias("last"))
    last = stage(last.select("key", F.col("last.to.val").alias("val"), bucket), "changes")
    touched = {r.bucket for r in last.select("bucket").distinct().collect()}  # BUCKETS at most
    old = layout(spark, path, newest)
    kept = _rows(spark, {b: folder for b, folder in old.items() if b in touched}).join(last.select("key"), "key", "left_anti")
    new = stage(kept.select("key", "val", bucket).unionByName(last.where("val IS NOT NULL")), "merged")
    folder = f"{path}/data/{uuid.uuid4().hex}"
    filled = {r.bucket for r in new.select("bucket").distinct().collect()}
    new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    listed = {b: f for b, f in old.items() if b not in touched} | dict.fromkeys(filled, folder)
    _create(spark, f"{path}/versions/{newest + 1:012d}.json", json.dumps({str(b): f for b, f in sorted(listed.items())}))
    return newest + 1


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an error if it exists."""
    system, where = _files(spark, path)
    try:
        out = system.create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        raise VersionConflict(f"{path} has been written by another") from error
    out.write(bytearray(text.encode()))
    out.close()
