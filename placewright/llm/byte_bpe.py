"""Byte-level byte-pair encoding as a finite-state transducer, and decoding with an incremental UTF-8 state machine.

A sequence of tokens is the byte-pair encoding of its bytes if and only if each two neighbours are a pair that encoding would
leave alone, and every prefix of a text has just one such sequence. Read from left to right, a text therefore keeps a few
alternatives open: for each place at which the token being read may have begun, the tokens before it and the node reached in
the vocabulary's trie. These sets of alternatives are the states of the determinised transducer. They are made when first
reached, and a token is emitted as soon as all open alternatives agree on it, which is at the latest after as many bytes as
the longest token has.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placewright.llm.common import Memo, text_rows

RANKS = "byte_bpe_multi_50k.tiktoken"
ROOT = 0
FEW = 8


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes byte strings by merge ranks. ``states`` bounds the states kept; beyond it they are forgotten and made anew."""

    def __init__(self, ranks: dict[bytes, int], states: int = 250_000):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.below: list[list[int]] = [[]]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                below = self.child.get(key)
                if below is None:
                    below = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.below.append([])
                    self.below[node].append(below)
                node = below
            self.token_at[node] = rank
        self.few = [1] * len(self.below)  # nodes of the trie from here down; children have higher numbers
        for node in range(len(self.below) - 1, -1, -1):
            self.few[node] += sum(self.few[n] for n in self.below[node])
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.lives: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = (-1, (((), ROOT),))
        self.number, self.states, self.moves, self.last = {start: 0}, [start], {}, [()]

    def merged(self, token: bytes, below: int) -> list[bytes]:
        """The parts of a token just before the merge of rank ``below`` would join them."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, rank: int) -> tuple:
        """The symbols on a token's left and on its right edge while it is being merged, each with the rank that ends it.

        None for a token that merging never makes.
        """
        if rank not in self.edges:
            token = self.bytes_of[rank]
            left = right = ((token, len(self.ranks)),)
            if len(token) > 1:
                parts = self.merged(token, rank)
                first, second = (self.ranks.get(p) for p in (parts[0], parts[-1]))
                inner = len(parts) == 2 and first is not None and second is not None and (self.edge(first), self.edge(second))
                if not inner or None in inner:
                    left = None
                else:
                    left += ((parts[0], rank), *inner[0][0][1:])
                    right += ((parts[1], rank), *inner[1][1][1:])
            self.edges[rank] = left and (left, right)
        return self.edges[rank]

    def stays(self, first: int, second: int) -> bool:
        """Whether encoding leaves these two tokens apart.

        They are joined across their border if two edge symbols merge at a rank at which both are there. At equal ranks the
        leftmost merge comes first: one inside the first token before the border's, the border's before one in the second.
        """
        key = (first, second)
        known = self.pairs.get(key)
        if known is None:
            a, b = self.edge(first), self.edge(second)
            known = a is not None and b is not None
            if known:
                get = self.ranks.get
                for x, x_ends in a[1]:
                    for y, y_ends in b[0]:
                        rank = get(x + y)
                        if rank is not None and rank < x_ends and rank <= y_ends:
                            known = False
                            break
                    if not known:
                        break
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def lasts(self, before: int, node: int) -> bool:
        """Whether a longer token through this node of the trie may stand after the token ``before`` (below 0: at the start).

        Looked up only where few tokens are left, to close alternatives early; elsewhere it is taken to be so.
        """
        if not 1 < self.few[node] <= FEW:
            return self.few[node] > 1
        known = self.lives.get((before, node))
        if known is None:
            known, todo = False, list(self.below[node])
            while todo and not known:
                at = todo.pop()
                token = self.token_at[at]
                known = token >= 0 and (self.stays(before, token) if before >= 0 else self.edge(token) is not None)
                todo += self.below[at]
            if len(self.lives) > 400_000:
                self.lives.clear()
            self.lives[before, node] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the move of a state on a byte: the state it leads to, and the tokens it emits."""
        committed, alternatives = self.states[state]
        after, border = [], None
        for pending, node in alternatives:
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            token = self.token_at[below]
            before = pending[-1] if pending else committed
            if token >= 0 and border is None:
                if (before < 0 and self.edge(token) is not None) or (before >= 0 and self.stays(before, token)):
                    border = (*pending, token)
            if self.lasts(before, below):
                after.append((pending, below))
        if border is None:
            raise ValueError(f"no token for the byte {byte}")
        after.append((border, ROOT))
        shared = 0
        shortest = min(len(p) for p, _ in after)
        while shared < shortest and all(p[shared] == border[shared] for p, _ in after):
            shared += 1
        emitted = border[:shared]
        if shared:
            committed = emitted[-1]
            after = [(p[shared:], node) for p, node in after]
        key = (committed if any(not p for p, _ in after) else -1, tuple(after))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(after[-1][0])
        self.moves[state << 8 | byte] = found = (to, emitted)
        return found

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one byte string."""
        if len(self.states) > self.limit:
            self._forget()
        state, out, moves = 0, [], self.moves
        for byte in data:
            found = moves.get(state << 8 | byte)
            if found is None:
                if len(self.states) > 4 * self.limit:  # one very long string
                    kept = self.states[state]
                    self._forget()
                    state = self.number[kept] = len(self.states)
                    self.states.append(kept)
                    self.last.append(kept[1][-1][0])
                    moves = self.moves
                found = self._move(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        return out + list(self.last[state])


def utf8_table() -> np.ndarray:
    """Next state of the UTF-8 machine by state and byte.

    0: between characters; 1, 2, 3: so many continuation bytes to come; 4, 5: after E0, ED; 6, 7: after F0, F4; 8: not UTF-8.
    """
    move = np.full((9, 256), 8, dtype=np.uint8)
    move[0, :0x80] = 0
    move[0, 0xC2:0xE0] = 1
    move[0, 0xE0:0xF0] = 2
    move[0, 0xF0:0xF5] = 3
    move[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1),
                                 (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        move[state, low:high] = to
    return move


class StreamingDecoder:
    """Turns tokens into text piece by piece: a character split over tokens is held back until it is whole."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.table = utf8_table()
        self.steps: dict[tuple[int, int], int] = {}
        self.whole = np.array([self._step(0, i) == 0 for i in range(len(self.tokens))], dtype=bool)
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def _step(self, state: int, token: int) -> int:
        """The machine's state after a token."""
        key = (state, token)
        if key not in self.steps:
            for byte in self.tokens[token]:
                state = int(self.table[state, byte])
            self.steps[key] = state
        return self.steps[key]

    def feed(self, ids: np.ndarray) -> str:
        """The text that these tokens complete. Bytes that are no UTF-8 become replacement characters at the end of the feed."""
        if not len(ids):
            return ""
        whole = self.whole[ids]
        done = -1  # up to here the tokens end between characters
        if self.state == 0 and whole.all():
            done = len(ids) - 1
        else:
            state, at = self.state, 0
            split = np.flatnonzero(~whole)
            while at < len(ids):
                if state == 0:  # whole tokens leave the machine between characters: on to the next split one
                    k = np.searchsorted(split, at)
                    stop = int(split[k]) if k < len(split) else len(ids)
                    done = stop - 1 if stop > at else done
                    at = stop
                    if at == len(ids):
                        break
                state = self._step(state, int(ids[at]))
                if state == 0:
                    done = at
                at += 1
            self.state = state
        tokens, listed = self.tokens, ids.tolist()
        text = b"".join([tokens[i] for i in listed[:done + 1]])
        if done >= 0:
            text, self.held = self.held + text, b"".join([tokens[i] for i in listed[done + 1:]])
        else:
            self.held += b"".join([tokens[i] for i in listed])
        return text.decode("utf-8", errors="replace")

    def finish(self) -> str:
        """What is still held back, with replacement characters for what never became whole."""
        rest = self.held.decode("utf-8", errors="replace")
        self.reset()
        return rest


class Codec:
    """Encoding of whole texts and decoding, with the transducer's results remembered by word.

    Texts are cut before each space that follows a character other than white space: the pattern ends a match there
    whatever stands around it, so the words can be encoded one by one.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.transducer = Transducer(ranks)
        self.decoder = StreamingDecoder(self.transducer.bytes_of)
        self.pattern = regex.compile(pattern)
        self.match = Memo(lambda m: array("I", self.transducer.encode(m.encode())).tobytes(), 200_000)
        self.word = Memo(self._word, 300_000)

    def _ids(self, text: str) -> bytes:
        return b"".join([self.match[m] for m in self.pattern.findall(text)])

    def _word(self, word: str) -> bytes | None:
        """The ids of a word with a space before it. Letters only, or letters and a comma or stop, need no pattern."""
        if word.isalpha():
            return self.match[" " + word]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return self.match[" " + word[:-1]] + self.match[word[-1]]
        return None if not word or word[-1].isspace() else self._ids(" " + word)

    def encode(self, text: str) -> np.ndarray:
        first, *others = text.split(" ")
        if not others or not first or first[-1].isspace():
            return np.frombuffer(self._ids(text), dtype=np.uint32)
        try:
            ids = self._ids(first) + b"".join(map(self.word.__getitem__, others))
        except TypeError:  # white space before a space
            ids = self._ids(text)
        return np.frombuffer(ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
        self.decoder.reset()
        for i in range(0, len(ids), step):
            yield self.decoder.feed(ids[i:i + step])
        yield self.decoder.finish()


CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The task's codec; a worker keeps it from task to task."""
    if (path, pattern) not in CODECS:
        CODECS[path, pattern] = Codec(path, pattern)
    return CODECS[path, pattern]


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null and empty texts have no ids; repeated rows stay; other columns go."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for keys, texts in text_rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([own.encode(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of arrays of ids. A null array is an empty text; bytes that are no UTF-8 become U+FFFD."""
    path, pattern = path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = ["".join(own.decode(np.array(i or [], dtype=np.uint32))) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, as decimals joined by commas, and of what they decode to.

    Null and empty texts have no ids, and the digests of the empty string. One pass, without a shuffle.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimals = [str(i) for i in range(len(own.decoder.tokens))]
        for keys, texts in text_rows(batches):
            counts, of_ids, of_text = [], [], []
            for t in texts:
                ids = own.encode(t)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([decimals[i] for i in ids.tolist()]).encode()).hexdigest())
                digest = hashlib.sha256()
                for part in own.decode(ids):
                    digest.update(part.encode())
                of_text.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
