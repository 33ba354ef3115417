"""Hashed runs of words, worked out over a text's bytes at once, and the similarity of many sets of them at a time."""

from __future__ import annotations

import numpy as np

from placewright.llm.fingerprints import mixed

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Byte positions in a word whose hashes are kept in a table; those of longer words are worked out.
KEPT = 32
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True


def byte_hash(byte: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte and its position in a word."""
    return mixed(byte.astype(np.uint64) + at.astype(np.uint64) * np.uint64(256) + ODD)


TABLE = byte_hash(np.tile(np.arange(256), KEPT), np.repeat(np.arange(KEPT), 256))


def word_hashes(text: str) -> np.ndarray:
    """The hash of each word of ``[^\\x20\\x09-\\x0D]+`` in order: the sum of its bytes' hashes, mixed with its length."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    inside = ~BREAKS[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    byte = data[inside].astype(np.int64)
    if int(lengths.max()) <= KEPT:
        h = TABLE[at * 256 + byte]
    else:
        h = np.where(at < KEPT, TABLE[np.minimum(at, KEPT - 1) * 256 + byte], byte_hash(byte, at))
    return mixed(np.add.reduceat(h, firsts) + lengths.astype(np.uint64) * ODD)


def shingles(text: str, words: int) -> np.ndarray:
    """The hashes of all runs of ``words`` words, each as often as it occurs; a shorter text is one run, one without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = mixed(total + h[k:len(h) - n + 1 + k] + np.uint64(k + 1))
    return total


class Together:
    """Weighted sets, none of them empty, whose elements have been numbered, so that one is compared with many by looking up weights."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        lengths = np.array([len(s) for s, _ in sets])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        known, self.at = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in sets])
        self.totals = np.add.reduceat(self.weights, self.ends[:-1])
        self.own = np.zeros(len(known))

    def similarities(self, x: int, first: int) -> np.ndarray:
        """The weighted Jaccard similarity of set ``x`` to each set from ``first`` on."""
        mine = slice(self.ends[x], self.ends[x + 1])
        self.own[self.at[mine]] = self.weights[mine]
        low = self.ends[first]
        common = np.add.reduceat(np.minimum(self.own[self.at[low:]], self.weights[low:]), self.ends[first:-1] - low)
        self.own[self.at[mine]] = 0
        return common / (self.totals[x] + self.totals[first:] - common)
