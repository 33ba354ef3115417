"""Token ids of whole texts from the tokenizers library, remembered by word."""

from __future__ import annotations

import json
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from placewright.llm.common import Memo

END = 2
#: White space to Python's split(), but not to the library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
LATIN = regex.compile("[\x00-ɏ]*")


def _mapped() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words:
    """Ids of a text, word by word, as unsigned 32-bit integers.

    A word goes to the library's model; one with characters beyond Latin letters, or with the text of a special token, goes
    through the library's whole pipeline, and so does a text that can't be cut at its spaces.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            declared = json.load(file)
        self.special = [t["content"] for t in declared["added_tokens"]]
        self.byte_text = _mapped()
        self.model = self.library.model
        self.piece = Memo(self._piece, 300_000)
        self.word = Memo(self._word, 350_000)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = "".join(map(self.byte_text.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _plain(self, word: str) -> bool:
        return LATIN.fullmatch(word) is not None and not any(s in word for s in self.special)


class ByteWords(Words):
    """For byte_bpe_50k.json: a space belongs to the word after it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.first = Memo(self._first, 100_000)

    def _letters(self, word: str) -> bytes:
        """The ids of a space and a word of letters, which the pattern never cuts."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_text)
        return array("I", [t.id for t in self.model.tokenize(self.byte_text[32] + mapped)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        if word.isalpha():
            return self._letters(word) if word.isascii() or LATIN.fullmatch(word) else self.whole(" " + word)
        if not word or word[-1].isspace():
            return None
        if word[-1] in ",." and word[:-1].isalpha() and LATIN.fullmatch(word):
            return (self.word.get(word[:-1]) or self._letters(word[:-1])) + self.piece[word[-1]]
        spaced = " " + word
        return b"".join([self.piece[m] for m in self.pattern.findall(spaced)]) if self._plain(word) else self.whole(spaced)

    def _first(self, word: str) -> bytes | None:
        return self.whole(word) if word and not word[-1].isspace() else None

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; no text is null.

        The words of the batch are told apart in Arrow; only distinct ones are looked up, and numpy puts their ids together.
        """
        pieces = pc.split_pattern(texts, " ")
        words, offsets = pieces.flatten(), pieces.offsets.to_numpy().astype(np.int64)
        begins = offsets[:-1] - offsets[0]
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        known, found = self.word, []
        for w, n in zip(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)).tolist(), strict=True):
            # A word that occurs once here is hardly worth remembering.
            found.append(known[w] if n > 1 or w in known else self._word(w))
        first = words.take(pa.array(begins)).dictionary_encode()
        at[begins] = len(found) + first.indices.to_numpy()
        found += [self.first[w] for w in first.dictionary.to_pylist()]
        uncut = np.add.reduceat(np.array([f is None for f in found])[at], begins, dtype=np.int64) > 0
        odd = np.flatnonzero(uncut)
        at[begins[odd]] = len(found) + np.arange(len(odd))
        found += [self.whole(t) for t in texts.take(pa.array(odd)).to_pylist()]
        sizes = np.array([len(f or b"") // 4 for f in found], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        counts = sizes[at]
        if len(odd):
            others = np.repeat(uncut, np.diff(offsets))
            others[begins] = False
            counts[others] = 0
        take = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.frombuffer(b"".join(f or b"" for f in found), dtype=np.uint32)[take], np.add.reduceat(counts, begins)

    def ids(self, text: str) -> bytes:
        first, *others = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.word.__getitem__, others))
        except TypeError:  # white space before a space
            return self.whole(text)


class LowerWords(Words):
    """For word_bpe_49k.json: lower case, white space dropped, a mark at the end of a word."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _word(self, word: str) -> bytes:
        if not self._plain(word) or "İ" in word:
            return self.whole(word)
        lowered = word.lower()
        if lowered.isalpha():
            return self.piece[lowered]
        if lowered[-1] in ",." and lowered[:-1].isalpha():
            return self.piece[lowered[:-1]] + self.piece[lowered[-1]]
        return b"".join([self.piece[m] for m in self.pattern.findall(lowered)])

    def ids(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self.whole(text)
        return b"".join(map(self.word.__getitem__, text.split()))


KINDS = {"byte_bpe_50k.json": ByteWords, "word_bpe_49k.json": LowerWords}
MADE: dict[str, Words] = {}


def words(path: str) -> Words:
    """The task's tokenizer; a worker keeps it from task to task."""
    if path not in MADE:
        MADE[path] = KINDS[path.rsplit("/", 1)[-1]](path)
    return MADE[path]
