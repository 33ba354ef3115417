"""Counting, encoding, token files and packing, each against the tokenizer libraries."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from placewright.llm import byte_bpe, ids, packing, token_counts, token_files
from tests.llm.cases import by_id, documents, empty, prose


def odd_texts() -> list[str]:
    chance = random.Random(3)
    signs = "abCD \n\té日🙂,.0'st%É½²́ \x1c▁"
    return ["".join(chance.choice(signs) for _ in range(200)) for _ in range(150)] + ["", " ", "  ", " lead", "trail ", "\n\n x", "a" * 5000, "<s>x</s>", "İSTANBUL ΣΑΣ"]


def tiktoken_encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    counter = token_counts.Counter(public_tokenizers.path(token_counts.MODEL))
    for text in [*odd_texts(), prose(1)]:
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_token_counts_of_a_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    docs = documents(spark)
    got = token_counts.token_counts(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_transducer_equals_the_library():
    library, own = tiktoken_encoding(), byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for text in [*odd_texts(), prose(2)]:
        found = own.encode(text)
        assert found.tolist() == library.encode_ordinary(text), repr(text)
        assert "".join(own.decode(found)) == text


def test_transducer_forgets_states_and_goes_on():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    small, library = byte_bpe.Transducer(ranks, states=20), tiktoken_encoding()
    for word in [*prose(3).split(), "x" * 900 + "yz" * 300]:
        assert list(small.encode(word.encode())) == library._encode_single_piece(word.encode())


def test_streaming_decoder_holds_split_characters_back():
    tokens = {i: bytes([i]) for i in range(256)}
    decoder = byte_bpe.StreamingDecoder(tokens)
    data = "aé日🙂z".encode()
    parts = [decoder.feed(np.array([b])) for b in data]
    assert "".join(parts) + decoder.finish() == "aé日🙂z"
    assert parts[1] == "" and parts[2] == "é"
    assert decoder.feed(np.array([0xE6, 0x97])) == "" and decoder.finish() == "�"


def test_round_trip_of_a_table(spark):
    library, docs = tiktoken_encoding(), documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in byte_bpe.round_trip(docs).collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = by_id(byte_bpe.decode(byte_bpe.encode(docs)))
    assert {k: r.text for k, r in back.items()} == texts
    assert byte_bpe.round_trip(empty(spark)).count() == 0


@pytest.mark.parametrize("name", list(ids.KINDS))
def test_ids_by_word_equal_the_library(name):
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), ids.words(public_tokenizers.path(name))
    for text in [*odd_texts(), prose(4), "x<|endoftext|> y", "it's IT'S <|startoftext|>a", "ﬁ Ⅷ ²"]:
        assert list(array("I", own.ids(text))) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_a_batch_equal_the_library():
    import random

    import pyarrow as pa

    library, own = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), ids.ByteWords(public_tokenizers.path(token_files.VOCABULARY))
    pick = random.Random(3)
    signs = ["a", "the", "Ab's", "it's", "  ", " ", "\n", "\t", "\u00a0", "\x1c", "é", "日本", "🙂", "123", ".,", "<|endoftext|>", "\u3000", "\x85"]
    texts = [*odd_texts(), prose(4), "", " ", "a", " a", "a ", "a  b", "x\n y", *("".join(pick.choice(signs) + pick.choice(["", " "]) for _ in range(pick.randrange(30))) for _ in range(600))]
    for part in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([""]), pa.array(["one"])):
        found, lengths = own.batch(part)
        want = [library.encode(t, add_special_tokens=False).ids for t in part.to_pylist()]
        assert lengths.tolist() == [len(w) for w in want]
        assert found.tolist() == [i for w in want for i in w]


def test_token_files_of_a_table(spark):
    library, docs = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), documents(spark)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = [], 0
    for key, text in rows:
        found = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(found), zlib.crc32(np.array(found, dtype="<u4").tobytes())))
        start += len(found)
    got = [tuple(r) for r in token_files.token_files(docs).orderBy("start").collect()]
    assert got == want
    assert token_files.token_files(empty(spark)).count() == 0


def test_token_files_keep_null_ids_first(spark):
    docs = spark.createDataFrame([(None, "b"), (-5, "a"), (None, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in token_files.token_files(docs).orderBy("start").collect()] == [(None, 0), (None, 2), (-5, 4)]


def check_packing(sequences, lengths):
    held = {}
    for sequence in sequences:
        total = sum(p[2] for p in sequence)
        assert 0 < total <= 4096 and total & (total - 1) == 0
        for doc, start, length in sequence:
            assert length > 0
            held.setdefault(doc, []).append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(held.get(doc, [])):
            assert start == at
            at += n
        assert at == length


def test_packing_holds_each_token_once_without_padding():
    chance = random.Random(5)
    for trial in range(40):
        lengths = [chance.choice((0, 1, 2, 511, 512, 513, 4096, 4097, 9000, chance.randint(1, 3000))) for _ in range(chance.randint(0, 60))]
        check_packing(packing.pack(lengths), lengths)


def test_step_groups_are_balanced():
    chance = random.Random(6)
    sizes = [chance.choice((512, 1024, 2048, 4096)) for _ in range(500)]
    totals = {}
    for size, group in zip(sizes, packing.step_groups(sizes), strict=True):
        totals[group] = totals.get(group, 0) + size
    assert max(totals.values()) - min(totals.values()) <= 512


@pytest.mark.parametrize("pool", [50, 4_000_000])
def test_packed_table(spark, pool):
    library, docs = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.packed(docs, pool_tokens=pool).collect()
    covered = {}
    for r in rows:
        found = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(found)
        assert r.ids_crc32 == zlib.crc32(np.array(found[r.start:r.start + r.length], dtype="<u4").tobytes())
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert all(n == (2 if k == 12 else 1) * len([*library.encode(texts[k], add_special_tokens=False).ids, 2]) for k, n in covered.items())
    for number in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == number), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.packed(empty(spark)).count() == 0
