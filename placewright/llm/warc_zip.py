"""Web archives packaged in ZIP files: a writer, and a reader that takes records by range without extracting members.

A package holds ``archive/data.warc.gz``, stored as it is, with a gzip member for each WARC record, and ``indexes/index.cdxj``,
which gives each record's offset and length in it. The reader finds the end-of-central-directory record in the file's tail,
follows the ZIP64 locator if there is one, takes the members' places from the central directory and the local headers, reads
the index, and then range-reads blocks of records in separate tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.common import columns_of, file_system, new_folder, partitions

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 100
BLOCK = 4 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

# Signatures and layouts of the ZIP format: fixed values.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipWriter:
    """Writes stored members one after another to a stream; sizes follow the data, so nothing is held or rewritten."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterable[bytes]) -> None:
        header, crc, size, encoded = self.at, 0, 0, name.encode()
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(encoded), 0) + encoded)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._put(part)
        wide = self.zip64 or size >= MAX32
        self._put(DESCRIPTOR + struct.pack("<I2Q" if wide else "<3I", crc, size, size))
        self.members.append((encoded, crc, size, header))

    def close(self) -> None:
        start = self.at
        for encoded, crc, size, header in self.members:
            wide = self.zip64 or size >= MAX32 or header >= MAX32
            extra = struct.pack("<2H3Q", 1, 24, size, size, header) if wide else b""
            short = (MAX32, MAX32) if wide else (size, size)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x808, 0, 0, 0x21, crc, *short, len(encoded), len(extra), 0, 0, 0, 0,
                                            MAX32 if wide else header) + encoded + extra)
        length, count = self.at - start, len(self.members)
        wide = self.zip64 or start >= MAX32 or length >= MAX32 or count >= MAX16
        if wide:
            at = self.at
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, length, start))
            self._put(LOCATOR + struct.pack("<IQI", 0, at, 1))
        self._put(END + struct.pack("<4H2IH", 0, 0, *((MAX16, MAX16, MAX32, MAX32) if wide else (count, count, length, start)), 0))


def central_directory(file, size: int) -> list[Member]:
    """The members of a ZIP or ZIP64 file, from its tail and central directory."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - MAX16 - 22)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature within a comment
    if at < 0:
        raise ValueError("no ZIP: the end of the central directory is missing")
    count, length, start = struct.unpack_from("<H2I", tail, at + 10)
    if MAX16 == count or MAX32 in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == LOCATOR:
            wide = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != END64:
                raise ValueError("the ZIP64 end of the central directory is missing")
            count, length, start = struct.unpack_from("<3Q", wide, 32)
    directory, out, at = read(start, length), [], 0
    for _ in range(count):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, unpacked, n_name, n_extra, n_comment, header = struct.unpack_from("<10xH8x2I3H8xI", directory, at)
        name = directory[at + 46:at + 46 + n_name].decode()
        extra, wanted = directory[at + 46 + n_name:at + 46 + n_name + n_extra], [unpacked, packed, header]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4:4 + n // 8 * 8])]
                wanted = [wide.pop(0) if v == MAX32 and wide else v for v in wanted]
            extra = extra[4 + n:]
        out.append(Member(name, method, wanted[1], wanted[2]))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    file.seek(member.header)
    local = file.read(30)
    if local[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<2H", local, 26))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit that has the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else PROFILE), ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """The fields of ``RECORD`` of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    body = rest[:int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    number = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    if kind == "revisit":
        size, digest = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
        return number("warc-record-id"), fields.get("warc-target-uri"), None, size, digest, kind, number("warc-refers-to")
    return number("warc-record-id"), fields.get("warc-target-uri"), payload, len(payload), hashlib.sha256(payload).hexdigest(), kind, None


def write(df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a package for each task; return (path, size, records) of the packages.

    Of rows with equal payloads of ``min_bytes`` or more, those of the smallest id are responses and the others revisits of it.
    A null payload is an empty one, a null url is left out, and a row without an id is always a response. Only payloads found
    twice are joined back, on their digest; a digest that many rows share is split by the adaptive skew join.
    """
    pages = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"), F.encode(F.coalesce(df[html], F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    firsts = pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = pages.join(firsts.where(F.col("n") > 1).drop("n"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        out = package = None
        index: list[bytes] = []
        at = 0

        def records(first: list[list], more: Iterator[list[list]]) -> Iterator[bytes]:
            nonlocal at
            part: list[list] | None = first
            while part is not None:
                for key, address, payload, digest, refers_to in zip(*part, strict=True):
                    packed = gzip.compress(record(key, address, payload, digest, refers_to), compresslevel=1, mtime=0)
                    index.append(f"{key} {DATE} {json.dumps({'offset': at, 'length': len(packed)})}\n".encode())
                    at += len(packed)
                    yield packed
                part = next(more, None)

        parts = columns_of(batches)
        for first in parts:
            if not first[0]:
                continue
            system.create_dir(root, recursive=True)
            name = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
            out = system.open_output_stream(name)
            package = ZipWriter(out)
            package.member(ARCHIVE, records(first, parts))
            package.member(INDEX, iter(index))
            package.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([package.at]), pa.array([len(index)])], ["name", "size", "records"])

    rows.mapInArrow(run, "name string, size long, records long").write.parquet(f"{folder}/packages")
    return packages(df.sparkSession, folder)


def packages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, size long, records long").parquet(f"{folder}/packages")


def blocks(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(name, start, lengths) of runs of records of about ``block`` bytes in all, from the packages' directories and indexes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for names, sizes, _ in columns_of(batches):
            for name, size in zip(names, sizes, strict=True):
                with system.open_input_file(f"{root}/{name}") as file:
                    members = {m.name: m for m in central_directory(file, size)}
                    base, index = data_start(file, members[ARCHIVE]), members[INDEX]
                    file.seek(data_start(file, index))
                    places = [json.loads(line.split(b" ", 2)[2]) for line in file.read(index.size).splitlines()]
                starts, lengths = [], []
                for p in places:
                    if not starts or base + p["offset"] >= starts[-1] + block:
                        starts.append(base + p["offset"])
                        lengths.append([])
                    lengths[-1].append(p["length"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["name", "start", "lengths"])

    return packages(spark, folder).repartition(partitions(spark)).mapInArrow(run, "name string, start long, lengths array<long>")


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all packages. A revisit has no payload, but its length and digest; those of a response are worked out
    from the payload that was read. ``payload=False`` leaves that column null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for names, starts, lengths in columns_of(batches):
            for name, start, sizes in zip(names, starts, lengths, strict=True):
                with system.open_input_file(f"{root}/{name}") as file:
                    file.seek(start)
                    found = [parsed(zlib.decompress(file.read(size), 31)) for size in sizes]
                if not payload:
                    found = [(*r[:2], None, *r[3:]) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORD.split(", ")])

    return blocks(spark, folder).repartition(partitions(spark)).mapInArrow(run, RECORD)


def archived(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", payload: bool = False) -> DataFrame:
    """Write the packages into a new folder below the shared one, and read their records back."""
    folder = new_folder(df.sparkSession, "warc")
    write(df, folder, page_id, url, html)
    return read(df.sparkSession, folder, payload)
