"""Packing of documents into sequences of several context sizes.

Documents are routed to the smallest tier that holds them; whole windows of the longest tier are cut off those that none
holds. From the longest tier down, each window takes a document of its tier, and its gap is filled from shorter tiers: by whole
documents, largest first, then by the head of one more, whose tail goes back to be routed anew. So every window is full
except the last of a pool, which is cut into powers of two. The sequences of a pool are then dealt to step groups, longest
first and each to the group with the fewest tokens, so that all steps of a group's size cost about the same.

A pool is a bounded number of tokens within a task. Tasks pack on their own, so there is no shuffle and no task sees more than
its own input; what that costs is less than one window for each pool, and that has no padding either.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from placewright.llm.common import text_rows
from placewright.llm.ids import END, words

VOCABULARY = "word_bpe_49k.json"
TIERS = (512, 1024, 2048, 4096)
POOL_TOKENS = 4_000_000
GROUP_TOKENS = 1 << 16
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, step_group long")

Piece = tuple[int, int, int]  # document, first token, tokens


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """The sequences of documents of these lengths: each a list of pieces that together fill a tier or a power of two."""
    longest, sequences = tiers[-1], []
    items: list[tuple[int, int, int]] = []  # tokens, document, first token; in order
    for doc, length in enumerate(lengths):
        whole = (length - 1) // longest if length else 0
        sequences += [[(doc, k * longest, longest)] for k in range(whole)]
        if length:
            items.append((length - whole * longest, doc, whole * longest))
    items.sort()
    lower = dict(zip(tiers, (0, *tiers), strict=False))
    rest: list[Piece] = []
    for tier in reversed(tiers):
        while items and items[-1][0] > lower[tier]:
            length, doc, start = items.pop()
            window, gap = [(doc, start, length)], tier - length
            while gap and items:
                at = bisect_right(items, (gap, len(lengths), 0))
                length, doc, start = items.pop(max(at - 1, 0))
                taken = min(length, gap)
                window.append((doc, start, taken))
                gap -= taken
                if length > taken:
                    insort(items, (length - taken, doc, start + taken))
            if gap:
                rest = window
            else:
                sequences.append(window)
    return sequences + halved(rest)


def halved(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut pieces into sequences whose lengths are the powers of two in the pieces' sum."""
    total, out, todo = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, sequence = total & 1 << bit, []
        while room:
            doc, start, length = todo.pop()
            taken = min(length, room)
            sequence.append((doc, start, taken))
            room -= taken
            if length > taken:
                todo.append((doc, start + taken, length - taken))
        if sequence:
            out.append(sequence)
    return out


def step_groups(sizes: list[int], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """The group of each sequence: the longest are dealt first, each to the group that has the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // group_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, out[i] = groups[0]
        heapq.heapreplace(groups, (tokens + sizes[i], out[i]))
    return out


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END,
           tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """A row for each piece: document, first token, tokens, CRC-32 of its ids, the document's tokens, sequence and offset in it.

    A document is its whole text's ids with ``end`` after them, so a null or empty text is one token; repeated rows and ids are
    packed each for itself. ``sequence_id`` and ``step_group`` are unique over all tasks but leave numbers out.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, next_sequence = words(path), TaskContext.get().partitionId() << 40
        next_group = next_sequence
        ending = array("I", [end]).tobytes()
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def sequences() -> pa.RecordBatch:
            nonlocal next_sequence, next_group
            made = pack([len(i) // 4 for i in ids], tiers)
            sizes = [sum(p[2] for p in s) for s in made]
            groups = step_groups(sizes)
            columns: list[list] = [[] for _ in range(9)]
            for number, (sequence, size, group) in enumerate(zip(made, sizes, groups, strict=True)):
                offset = 0
                for doc, start, length in sequence:
                    data = ids[doc]
                    row = (keys[doc], start, length, zlib.crc32(memoryview(data)[4 * start:4 * (start + length)]), len(data) // 4,
                           next_sequence + number, offset, size, next_group + group)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
            next_sequence += len(made)
            next_group += max(groups, default=-1) + 1
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

        for some, texts in text_rows(batches):
            for key, t in zip(some, texts, strict=True):
                keys.append(key)
                ids.append(own.ids(t) + ending)
                held += len(ids[-1]) // 4
                if held >= pool_tokens:
                    yield sequences()
                    held = 0
        if keys:
            yield sequences()

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, PIECES)
