"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by id and sorted, and each partition writes one shard of three files, all little-endian:

* ``tokens-*.bin``: the ids, unsigned 16-bit if the vocabulary fits, else unsigned 32-bit;
* ``offsets-*.bin``: unsigned 64-bit, for each document its first id within the shard, then the shard's number of ids;
* ``docs-*.bin``: signed 64-bit document ids; the lowest integer stands for null.

``index`` is a small Parquet table with a row for each shard: its names, numbers of documents and ids, and its base, which is
the sum of the ids in the shards before it. A document begins at its shard's base plus its offset. Readers memory-map shards
in a local or mounted folder and open them by URI elsewhere. A shard counts only once the index names it, so files that a
lost or repeated task leaves behind are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from placewright.llm.common import file_system, new_folder, partitions
from placewright.llm.ids import END, ByteWords, words

VOCABULARY = "byte_bpe_50k.json"
NO_ID = -(1 << 63)
SHARD = "shard int, name string, width int, n_docs long, n_tokens long"
BATCH = 4000
#: Bytes of texts that are encoded at a time, about.
PART = 8 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and whole texts of (id, text) in parts of about ``PART`` bytes, a longer text alone; a null text is an empty one."""
    texts = batch.column(1).fill_null("")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    for at, stop in pairwise([0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]):
        if at < stop:
            yield batch.column(0).slice(at, stop - at).to_pylist(), texts.slice(at, stop - at)


def write(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END,
          shards: int | None = None) -> DataFrame:
    """Write every whole text's ids, each with ``end`` after it, in ascending ``doc_id``; return the index with bases.

    ``folder`` must be reachable by all executors. A null or empty text is the end id alone; null ids come first; repeated
    ids stay, in the order of their texts. An empty table gives an empty index.
    """
    spark, path = df.sparkSession, path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = words(path), TaskContext.get().partitionId()
        width = 2 if own.library.get_vocab_size() <= 1 << 16 else 4
        name, total, count, files = f"{shard:06d}-{uuid.uuid4().hex}", 0, 0, []
        system, root = file_system(folder)
        for keys, texts in ((keys, texts) for batch in batches for keys, texts in pieces(batch)):
            if not files:
                system.create_dir(root, recursive=True)
                files = [system.open_output_stream(f"{root}/{kind}-{name}.bin") for kind in ("tokens", "offsets", "docs")]
            if isinstance(own, ByteWords):
                ids, lengths = own.batch(texts)
            else:
                found = [np.frombuffer(own.ids(t), dtype=np.uint32) for t in texts.to_pylist()]
                ids, lengths = np.concatenate(found), np.array([len(f) for f in found])
            files[0].write(np.insert(ids, np.cumsum(lengths), end).astype(f"<u{width}").tobytes())
            ends = np.cumsum(lengths + 1).astype("<u8") + np.uint64(total)
            files[1].write(np.concatenate([[total], ends[:-1]]).astype("<u8").tobytes())
            files[2].write(np.array([NO_ID if k is None else k for k in keys], dtype="<i8").tobytes())
            total, count = int(ends[-1]), count + len(keys)
        if files:
            files[1].write(np.array([total], dtype="<u8").tobytes())
            for file in files:
                file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([width], pa.int32()), pa.array([count], pa.int64()),
                 pa.array([total], pa.int64())], ["shard", "name", "width", "n_docs", "n_tokens"])

    ordered = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).repartitionByRange(
        shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.parquet(f"{folder}/written")
    # One row for each shard, so their number is the partition count of this job.
    rows = sorted(spark.read.schema(SHARD).parquet(f"{folder}/written").collect())
    bases = accumulate((r.n_tokens for r in rows), initial=0)
    index = spark.createDataFrame([(*r, base) for r, base in zip(rows, bases, strict=False)], SHARD + ", base long")
    index.coalesce(1).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD + ", base long").parquet(f"{folder}/index")


def opened(folder: str, name: str, dtype: str) -> np.ndarray:
    """A shard's file as an array, memory-mapped if the folder is on a local or mounted disk."""
    system, root = file_system(folder)
    path = f"{root}/{name}.bin"
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype=dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone, a shard for each task.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    index = read_index(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = opened(folder, f"tokens-{row['name']}", f"<u{row['width']}")
                offsets, docs = opened(folder, f"offsets-{row['name']}", "<u8"), opened(folder, f"docs-{row['name']}", "<i8")
                for at in range(0, row["n_docs"], BATCH):
                    edges = offsets[at:at + BATCH + 1].astype(np.int64)
                    keys = docs[at:at + BATCH]
                    sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=keys == NO_ID), pa.array(edges[:-1] + row["base"]), pa.array(np.diff(edges)),
                         pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the files into a new folder below the shared one, and read them back."""
    folder = new_folder(df.sparkSession, "tokens")
    write(df, folder, doc_id, text, path)
    return read(df.sparkSession, folder)
