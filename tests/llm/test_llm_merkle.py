"""The manifest against a plain recursion."""

import zlib
from collections import defaultdict
from hashlib import sha256

from tests.llm.cases import documents, empty

from placewright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def written(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def tree(nodes):
    """The root, and for each leaf the steps (left, right) up to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, n in enumerate(at):
            run = nodes[n // 3 * 3:n // 3 * 3 + 3]
            steps[leaf].append(("".join(run[:n % 3]), "".join(run[n % 3 + 1:])))
            at[leaf] = n // 3
        nodes = [h("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], steps


def brute(rows):
    leaf = lambda r, text: h("".join(map(written, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (_, _, own, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + up
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            found = leaf(r, r["text"].replace("\n", "")) if hit and r["text"] is not None else own
            for a, b in path:
                found = h(a + found + b)
            out.append((r["doc_id"], own, trees[s][0], root, h("".join(a + b for a, b in path)), found, found == root))
    return sorted(out, key=str)


def compared(df):
    got = sorted(map(tuple, merkle.manifest(df).collect()), key=str)
    assert got == brute([r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    return got


def test_odd_rows(spark):
    got = compared(documents(spark))
    assert len(got) == documents(spark).count()
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_single(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    assert merkle.manifest(empty(spark)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    (row,) = compared(spark.createDataFrame([(4, "a", None, None, 1)], SCHEMA))
    assert row[1] == row[2] == row[3] and row[4] == h("")


def test_sources_of_every_small_size_null_and_empty_ones(spark):
    rows = [(1000 * n + i, f"text {i}\nof {n}", "en", None if n == 3 else "" if n == 4 else f"sé{n}", None) for n in range(1, 12) for i in range(n)]
    rows += [(None, "x\ny", "en", "sé2", 1), (None, "x\ny", "en", "sé2", 1), (1000, "x", "en", "sé1", 1), (1000, "x", "en", "sé1", 1)]
    compared(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_a_source_of_many_blocks_and_many_sources(spark):
    rows = [(i, f"text\n{i}", "en", "hot", i) for i in range(2300)] + [(10_000 + i, "t\n", None, f"s{i}", 0) for i in range(800)]
    got = compared(spark.createDataFrame(rows, SCHEMA).repartition(5))
    noticed = [r for r in got if not r[-1]]
    assert {r[0] for r in noticed} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 2 == 0}


def test_sweeps_follow_the_labels():
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 100):
        leaves = [h(str(k)) for k in range(n)]
        levels = merkle.height(n)
        up = merkle.swept_up(leaves, levels)
        root, steps = tree(leaves)
        assert up[-1] == root
        assert merkle.swept_down(up, n, levels, "") == [";".join(f"{a}|{b}" for a, b in s) for s in steps]
