"""DartMinHash and near-duplicate classes against brute force, web archives, and the pipeline."""

import hashlib
import io
import math
import re
import zipfile

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from placewright.llm import dart_minhash, shingles, warc_zip
from placewright.llm.fingerprints import Fingerprints
from tests.llm.cases import CLASHING, by_id, documents, edited, empty, prose


def weighted_similarity(a: dict, b: dict) -> float:
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("scale", [0.3, 1.0, 7.5])
def test_signatures_estimate_weighted_similarity(scale):
    chance = np.random.default_rng(4)
    for shared in (0, 40, 90, 100):
        a = {int(k): float(w) for k, w in zip(range(100), chance.exponential(scale, 100), strict=True)}
        b = {k: (w if k < shared else chance.exponential(scale)) for k, w in a.items()}
        b = {(k if k < shared else k + 1000): w for k, w in b.items()}
        signs = []
        for s in (a, b):
            keys = dart_minhash.mixed(np.array(list(s), dtype=np.uint64))
            signs.append(dart_minhash.signature(keys, np.array(list(s.values())), 2000))
        assert (signs[0] == signs[1]).mean() == pytest.approx(weighted_similarity(a, b), abs=0.05)


def test_signature_of_nothing_and_of_one():
    assert len(dart_minhash.signature(np.zeros(0, dtype=np.uint64))) == 0
    assert len(dart_minhash.signature(np.array([5], dtype=np.uint64), size=64)) == 64


def brute_classes(rows: list[tuple], least: float = 0.8) -> dict:
    own = Fingerprints()
    sets = {doc: set(own.terms(text or "").tolist()) for doc, text in rows}
    root = {doc: doc for doc in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (union == 0 or len(sets[a] & sets[b]) / union >= least):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {doc: find(doc) for doc in sets}


def copies() -> list[tuple]:
    rows = [(i, prose(i, 150)) for i in range(40)]
    rows += [(100 + i, edited(prose(i % 8, 150), i, 1 + i % 3)) for i in range(60)]
    rows += [(200 + i, prose(3, 150)) for i in range(30)]
    passage = prose(77, 60)
    rows += [(300 + i, passage + " " + prose(300 + i, 90)) for i in range(25)]
    return rows + [(400, None), (401, ""), (402, "one two"), (403, "one two"), (404, "one three")]


@pytest.mark.parametrize("parts", ["4", "41"])
def test_classes_equal_brute_force(spark, parts):
    rows = copies()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = by_id(dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k: r.class_id for k, r in found.items()} == brute_classes(rows)
    assert all(r.kept == (k == r.class_id) for k, r in found.items())


def quick_classes(rows: list[tuple], least: float = 0.8) -> dict:
    """``brute_classes`` for many long texts: all pairs by one product of matrices."""
    own = Fingerprints()
    sets = [np.unique(own.terms(text)) for _, text in rows]
    known = np.unique(np.concatenate(sets))
    has = np.stack([np.isin(known, s, assume_unique=True) for s in sets]).astype(np.float32)
    common, size = has @ has.T, has.sum(axis=1)
    alike = common >= least * (size[:, None] + size[None, :] - common)
    docs, root = np.array([doc for doc, _ in rows]), np.array([doc for doc, _ in rows])
    while not np.array_equal(root, now := np.where(alike, root[None, :], root[:, None]).min(axis=1)):
        root = now
    return dict(zip(docs.tolist(), root.tolist(), strict=True))


@pytest.mark.parametrize("parts", ["4", "41"])
def test_classes_of_loose_variants_equal_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 16, raising=False)
    original, rows = prose(5, 300), []
    for i in range(500):  # mostly 0.5 to 0.79 alike, and each with a closer copy
        loose = edited(original, i, 4 + i % 9)
        rows += [(i, loose), (1000 + i * 7919 % 500, edited(loose, 5000 + i, 4 + i % 4))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = by_id(dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k: r.class_id for k, r in found.items()} == quick_classes(rows)


def test_documents_with_many_partners_are_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "PART", 8)
    text = prose(1, 100)
    rows = [(i, edited(text, i, 1 + i % 5)) for i in range(100)] + [(1000, text), (-1, text)]
    pairs = spark.createDataFrame([(i, 1000) for i in range(100)] + [(-1, i) for i in range(100)], "a long, b long")
    counts = [pairs.groupBy(c).agg((F.count("*") / 8 + 0.99).cast("int").alias(f"parts_{c}")) for c in "ab"]
    asked = dart_minhash.asked_of(pairs, *counts).collect()
    assert sum(len(r.to) for r in asked) == 200 and max(len(r.to) for r in asked) < 30
    found = dart_minhash.verified(pairs, spark.createDataFrame(rows, "doc long, text string"), 5, False, 0.8).collect()
    sets = {doc: dart_minhash.shingle_set(t, weighted=False) for doc, t in rows}
    alike = sorted((r.a, r.b) for r in pairs.collect() if dart_minhash.similarity(sets[r.a], sets[r.b]) >= 0.8)
    assert sorted((r.a, r.b) for r in found) == alike and 0 < len(alike) < 200


def counted(text: str) -> dict:
    words = text.split()
    found: dict = {}
    for i in range(max(1, len(words) - 4)):
        found[tuple(words[i:i + 5])] = found.get(tuple(words[i:i + 5]), 0) + 1
    return found


def test_repeated_passages_weigh_as_often_as_they_occur(spark):
    """Two texts of the same shingles are alike or not by how often a passage is repeated; and a plain copy of either is its own."""
    passage, rows = prose(1, 60).replace("\n", " "), []
    for i in range(12):
        text = " ".join([prose(50 + i // 4, 40).replace("\n", " ")] + [passage] * (1 + 3 * (i % 4)))
        rows += [(i, text), (100 + i, edited(text, i, 1))]
    sets = {doc: counted(text) for doc, text in rows}
    root = {doc: doc for doc in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if weighted_similarity(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    found = by_id(dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r.class_id for k, r in found.items()} == root and 3 < len(set(root.values())) < 24


def test_word_hashes_follow_the_words():
    texts = ["", " \t\n", "a", "a b", " a  b\r\n", "ab", "a\x1cb", "日本 語", "x" * 31, "x" * 32, "x" * 33 + " " + "x" * 500, "x" * 500 + "y", "é e\u0301"]
    known = {}
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        hashes = shingles.word_hashes(text).tolist()
        assert len(hashes) == len(words)
        for word, h in zip(words, hashes, strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert len(shingles.shingles("a b c", 5)) == 1 and len(shingles.shingles("a b c d e f", 5)) == 2


def test_sets_together_equal_sets_one_by_one():
    chance = np.random.default_rng(2)
    sets = [(np.unique(chance.integers(0, 60, 40)).astype(np.uint64), None) for _ in range(20)]
    sets = [(s, chance.integers(1, 5, len(s)).astype(float)) for s, _ in sets]
    together = shingles.Together(sets)
    for x in range(19):
        assert together.similarities(x, x + 1) == pytest.approx([dart_minhash.similarity(sets[x], s) for s in sets[x + 1:]])


def test_no_row_for_each_pair_of_a_group(spark, monkeypatch):
    """Loose variants, hardly any two of them alike: what is compared a second time grows with the group, not with its pairs."""
    made = {}
    plain = dart_minhash.stage
    monkeypatch.setattr(dart_minhash, "stage", lambda df, name: made.setdefault((name, len(made)), plain(df, name)))
    original = prose(5, 300)
    rows = [(i, edited(original, i, 9)) for i in range(400)]
    found = by_id(dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r.class_id for k, r in found.items()} == quick_classes(rows)
    most = {name: df.count() for (name, _), df in made.items() if name in ("by-signatures", "shingle-sets", "further-links")}
    assert most["by-signatures"] <= 400 * dart_minhash.BANDS and most["shingle-sets"] <= 400 and most["further-links"] < 400 * dart_minhash.BANDS


def test_estimates_lose_fewer_pairs_than_bands():
    size, alike = dart_minhash.BANDS * dart_minhash.ROWS, dart_minhash.SIMILARITY
    agree = alike + (1 - alike) / 256  # eight bits of a coordinate
    least = math.ceil(size * (dart_minhash.TOO_LOW * 255 + 1) / 256)
    lost = sum(math.comb(size, n) * agree**n * (1 - agree) ** (size - n) for n in range(least))
    assert lost < 0.1 * (1 - alike**dart_minhash.ROWS) ** dart_minhash.BANDS


def test_one_of_each_keeps_rows_as_they_were(spark):
    docs = documents(spark)
    out = dart_minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 5, 7, 9, 10, 11, 12]
    assert dart_minhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (299, 300)]
    found = {r.doc: r.root for r in dart_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 61)}, **{100 + i: 100 for i in range(1, 30)}, 300: 299}


def pages(spark):
    long = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/", long), (3, "http://b/?q=1 2", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (7, "u\r\nv", None), (8, "", ""), (3, "again", long), (None, "n", long)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c.split()[0]: F.lit("clash") for c in (CLASHING + ", payload string, digest string").split(", ")}).repartition(3), rows


def test_archives_round_trip(spark):
    table, rows = pages(spark)
    found = warc_zip.archived(table, payload=True).collect()
    assert len(found) == len(rows)
    for key, url, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and key not in (3, None)
        match = [r for r in found if r.page_id == key and r.url == (url and url.replace("\r", "%0D").replace("\n", "%0A"))]
        assert match and all(
            (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
            and r.payload == (None if revisit else data) for r in match)
    assert warc_zip.archived(table.where("false")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    out = io.BytesIO()
    writer = warc_zip.ZipWriter(out, zip64)
    writer.member("a/ü.bin", [b"12", b"345"])
    writer.member("b", [])
    writer.close()
    data = out.getvalue()
    members = warc_zip.central_directory(io.BytesIO(data), len(data))
    assert [(m.name, m.size) for m in members] == [("a/ü.bin", 5), ("b", 0)]
    at = warc_zip.data_start(io.BytesIO(data), members[0])
    assert data[at:at + 5] == b"12345"
    with zipfile.ZipFile(io.BytesIO(data)) as other:
        assert other.read("a/ü.bin") == b"12345" and other.testzip() is None


def test_zip_with_comment_and_compressed_member():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        made.writestr("x", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        made.comment = b"a PK\x05\x06"
    data = out.getvalue()
    (member,) = warc_zip.central_directory(io.BytesIO(data), len(data))
    with pytest.raises(ValueError, match="not stored"):
        warc_zip.data_start(io.BytesIO(data), member)
    with pytest.raises(ValueError, match="no ZIP"):
        warc_zip.central_directory(io.BytesIO(b"PK"), 2)


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, prose(i, 150), "en", "a", 0) for i in range(60)] + [(60 + i, prose(i, 150), "en", "a", 0) for i in range(10)]
    rows += [(100 + i, "%%% ".join(prose(100 + i, 100).split(" ")), "en", "a", 0) for i in range(12)] + [(200, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(60))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, docs.where("false"), str(tmp_path))
        assert nothing.columns == docs.columns and nothing.count() == 0, name


def plain_lines(rows: dict) -> dict:
    """Texts without the lines that three documents or more have, but for the largest id's."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    owners: dict = {}
    for doc, text in rows.items():
        for line in (text or "").split("\n"):
            owners.setdefault(key(line), set()).add(doc)
    lost = lambda doc, k: len(k) >= 20 and len(owners[k]) >= 3 and doc != max(owners[k])
    return {doc: "\n".join(line for line in (text or "").split("\n") if not lost(doc, key(line))) for doc, text in rows.items()}


def test_pipeline_equals_plain_python(spark, tmp_path, monkeypatch):
    """Shared lines, exact and near copies, a long text and clashing columns through all stages; each is held against its own input."""
    rows = {i: prose(i, 150) for i in range(60)}
    rows |= {60 + i: prose(i, 150) for i in range(5)} | {70 + i: edited(prose(20 + i, 150), i, 1 + i % 2) for i in range(10)}
    footer = "This Footer stands below every second document"
    for i in range(30, 50, 2):
        rows[i] += "\n" + ("  " + footer.upper() + "\t" if i % 4 else footer)
    rows[90] = prose(90, 20_000)
    bad = {100 + i: "%%% ".join(prose(100 + i, 100).split(" ")) for i in range(12)}
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in (rows | bad).items()], names)
    docs.withColumns({c.split()[0]: F.lit("clash") for c in CLASHING.split(", ")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda *_: f"{tmp_path}/stages")

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {name: {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stages/{name}").collect()} for name, _ in corpus_pipeline.STAGES[:-1]}
    assert set(texts["quality_classifier"]) == set(rows) and all(texts["quality_classifier"][k] == t for k, t in rows.items())
    left = texts["line_dedup"]
    assert left == plain_lines(rows) and sum(left[k] != t for k, t in rows.items()) == 9
    assert all(r.n_chars == len(r.text) and r.key == "clash" for r in spark.read.parquet(f"{tmp_path}/stages/line_dedup").collect())
    root = brute_classes(list(left.items()))
    assert texts["near_dedup"] == {k: left[k] for k in root if root[k] == k} and len(texts["near_dedup"]) == 61
    whole: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == whole.get(r.doc_id, 0)
        whole[r.doc_id] = r.start + r.length
    model = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert whole == {k: len(model.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts["near_dedup"].items()}
