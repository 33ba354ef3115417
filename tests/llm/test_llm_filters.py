"""Quality rules and classifier, line dedup and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import fingerprints, line_dedup, quality_classifier, quality_rules
from tests.llm.cases import by_id, documents, edited, empty, prose

BLANK = " \t\n\x0b\x0c\r"


def counted(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeats = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeats)


def test_base_counts(spark):
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, prose(1) + "\n" + prose(1), "l\nl\n \nl m\nl", "# a*b |\n# a*b |", "a b c d e f a b c d e g a b c d e", "日 本   x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measured(rows).collect():
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == counted(r.text or ""), repr(r.text)


def test_rules_reject_what_stands_out_in_its_group(spark):
    docs = [(i, prose(i), "en", "a") for i in range(80)]
    docs += [(100, "%%% ".join(prose(100).split(" ")), "en", "a"), (101, prose(101).upper(), "en", "a"), (102, "too short", "en", "a"), (103, prose(103), None, None)]
    docs += [(200 + i, "%%% ".join(prose(200 + i).split(" ")), "en", "symbols") for i in range(60)]
    found = by_id(quality_rules.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")))
    kept = {k for k, r in found.items() if r._kept}
    assert kept == {*range(80), 103, *range(200, 260)}  # a source full of symbols is measured by itself


def test_rules_keep_rows_as_they_were(spark):
    docs = documents(spark)
    out = quality_rules.kept(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 12, 12]
    assert quality_rules.judged(empty(spark)).count() == 0


def labelled(n: int):
    good = [(i, prose(i, 60)) for i in range(n)]
    bad = [(n + i, " ".join(w + "!!" for w in prose(n + i, 60).upper().split())) for i in range(n)]
    return [*good, *bad], [(i, 1, 0) for i in range(n)] + [(n + i, 0, 0) for i in range(n)]


def test_classifier_learns_from_what_is_not_held_out(spark):
    rows, labels = labelled(60)
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (900, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    found = by_id(quality_classifier.classified(docs, marks))
    assert len(found) == 122
    for key, r in found.items():
        assert r.held_out == (zlib.crc32(str(key).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [(r.predicted, key < 60) for key, r in found.items() if r.held_out and key < 500]
    assert sum(p == w for p, w in tested) >= 0.95 * len(tested)
    assert found[500].score == found[501].score


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_classifier_without_both_labels(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r.score for r in quality_classifier.classified(documents(spark), marks).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality_classifier.classified(empty(spark), marks).count() == 0


def test_long_words_and_repeated_scoring():
    model = quality_classifier.trained([(prose(1), 1), (prose(2).upper(), 0)], epochs=2)
    scorer = quality_classifier.Scorer(*model, limit=50)
    first = scorer.score(prose(7))
    assert scorer.score("x" * 20_000 + " y") <= 1 and scorer.score(prose(7)) == pytest.approx(first)


def without_lines(rows: list[tuple]) -> list[tuple]:
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(docs[key(x)]) >= 3 and max(docs[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_shared_lines(spark):
    import random

    chance = random.Random(2)
    common = [f"a line that many documents do share {k}" for k in range(12)]
    rows = []
    for i in range(400):
        lines = [chance.choice(common) if chance.random() < 0.6 else f"own line number {i} with {chance.random()}" for _ in range(chance.randint(0, 14))]
        rows.append((i, "\n".join(x.upper() + " \t" if chance.random() < 0.2 else x for x in lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "short\n" + common[0] + "\n" + common[0]), (17, rows[17][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for parts in ("2", "37"):  # with more partitions, runs of equal hashes go on over many of them
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = line_dedup.without_shared_lines(docs).select("doc_id", "_n_lines", "_n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(tuple(r) for r in out) == without_lines(rows)


def test_shared_lines_keep_other_columns(spark):
    docs = documents(spark)
    out = line_dedup.without_shared_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"] and out.count() == docs.count()
    assert by_id(out)[7].text is None
    assert line_dedup.without_shared_lines(empty(spark)).count() == 0


def test_compared_fingerprints(spark):
    docs = documents(spark)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    own, want = fingerprints.Fingerprints(), []
    mark = lambda t: own.of(own.terms(t))
    for (key, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        moved = len(text) // 4
        changed = text[:len(text) - moved] + following[:moved]
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark(text), mark(changed),
                     fingerprints.likeness(mark(text), mark(changed)), fingerprints.likeness(mark(text), mark(following))))
    assert sorted(tuple(r) for r in fingerprints.compared(docs).collect()) == sorted(want)
    assert fingerprints.compared(empty(spark)).count() == 0
    one = fingerprints.compared(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_within_finds_all_near_fingerprints(spark):
    chance = random.Random(8)
    base = [chance.getrandbits(128) for _ in range(20)]
    marks = [(i, f"{base[i % 20] ^ sum(1 << b for b in chance.sample(range(128), chance.randint(0, 6))):032x}") for i in range(200)] + [(500, None)]
    rows = spark.createDataFrame(marks, "doc_id long, fingerprint string")
    got = {(r.query, r.doc_id, r.bits) for r in fingerprints.within(rows.where("doc_id % 7 = 0"), rows, 3).collect()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(q, d, bits(a, b)) for q, a in marks[:-1] for d, b in marks[:-1] if q % 7 == 0 and bits(a, b) <= 3}


def test_within_cuts_a_block_that_most_share(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART", 16)
    chance = random.Random(8)
    marks = [(i, f"{0xABCD0123:08x}" + f"{chance.getrandbits(96):024x}") for i in range(300)]  # one block is the same in all
    marks += [(1000 + i, f"{int(m, 16) ^ (1 << i % 96) ^ (2 << i % 90):032x}") for i, m in marks]
    rows = spark.createDataFrame(marks, "doc_id long, fingerprint string")
    got = [(r.query, r.doc_id, r.bits) for r in fingerprints.within(rows.where("doc_id % 7 = 0"), rows, 3).collect()]
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert sorted(got) == sorted((q, d, far(a, b)) for q, a in marks if q % 7 == 0 for d, b in marks if far(a, b) <= 3)


def test_the_vote_written_out():
    """Each bit has the majority of the terms' bits, a term of three occurrences has three votes, and a tie is a zero."""
    own = fingerprints.Fingerprints()
    for text in (prose(3, 80), "a b c d e f g " * 9, "one two", "x y z w v u"):
        terms = [int(t) for t in own.terms(text)]
        votes = [0] * fingerprints.BITS
        for t in terms:
            second = int(fingerprints.mixed(np.array([t], dtype=np.uint64) ^ fingerprints.MIX[1])[0])
            for bit in range(fingerprints.BITS):
                votes[bit] += 1 if (t | second << 64) >> bit & 1 else -1
        value = sum(1 << bit for bit, v in enumerate(votes) if v > 0)
        assert own.of(own.terms(text)) == value.to_bytes(fingerprints.BITS // 8, "little").hex()
        assert len(terms) == max(1, len(text.split()) - 4)


def test_near_texts_have_near_fingerprints(spark):
    text = prose(1, 400)
    docs = spark.createDataFrame([(1, text), (2, text), (3, edited(text, 1, 3)), (4, prose(2, 400)), (5, None)], "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert found[1] == found[2] and found[5] == "0" * 32
    assert fingerprints.likeness(found[1], found[3]) > 0.8 > 0.65 > fingerprints.likeness(found[1], found[4])


def test_shape_reads_the_whole_word():
    assert quality_classifier.shape("语" * 70 + "Ab9") == "/" + "语" * 70 + "Xx9"
    assert quality_classifier.shape("a" * 64 + "B7") == "/xX9"
