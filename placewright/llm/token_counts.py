"""Token counts of texts for a byte-pair model with byte fallback, by merging over a heap and a linked list.

The symbols of a word are linked in order, and the pairs that the vocabulary can join lie in a heap by rank and place. The
best pair is popped again and again; a merge unlinks its right symbol and pushes the pairs that the new symbol makes with its
neighbours. The count is the number of symbols less the number of merges. Ids are never looked up.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from placewright.llm.common import Memo, text_rows

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LIMIT = 4096


class Counter:
    """Counts tokens with the pieces and scores of a model whose normaliser only turns spaces into ``SPACE`` and sets one first.

    No piece has another character before a ``SPACE``, so no merge crosses the start of a word and words are counted one by one.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {
            model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        }
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("the model has pieces that go on over the start of a word")
        order = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in pieces.items()}
        self.word = Memo(lambda word: self.merged(SPACE + word) if word else None, 600_000)

    def merged(self, text: str) -> int:
        """Tokens of a text in which spaces are ``SPACE`` already."""
        ranks, end = self.ranks, len(text)
        symbol: list[str] = list(text)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        heap = [(rank, i, pair) for i in range(end - 1) if (rank := ranks.get(pair := text[i:i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            if right >= end or not symbol[left] or symbol[left] + symbol[right] != pair:
                continue  # one of the two has been merged since
            symbol[left], symbol[right] = pair, ""
            following = after[left] = after[right]
            merges += 1
            if following < end:
                before[following] = left
                if (rank := ranks.get(joined := pair + symbol[following])) is not None:
                    heapq.heappush(heap, (rank, left, joined))
            if (previous := before[left]) >= 0 and (rank := ranks.get(joined := symbol[previous] + pair)) is not None:
                heapq.heappush(heap, (rank, previous, joined))
        # A character that no piece has was never merged; it falls back to its bytes.
        return end - merges + sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in ranks)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if SPACE not in text:
            try:
                return sum(map(self.word.__getitem__, text.split(" ")))
            except TypeError:  # spaces in a row, at the start or at the end
                pass
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self.merged(run) for run in re.findall(f"{SPACE}+[^{SPACE}]*", marked))


COUNTERS: dict[str, Counter] = {}


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text: UTF-8 bytes, tokens, and whether these exceed ``limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and ids stay as they are; other columns are not read. One
    pass over the table, without a shuffle; memory is a bounded memo of words and the text at hand.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in COUNTERS:
            COUNTERS[path] = Counter(path)
        counter = COUNTERS[path]
        for ids, texts in text_rows(batches):
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
