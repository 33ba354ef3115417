"""Embedding near-duplicates and hard negatives against brute force."""

import math

import numpy as np
import pytest

from placewright.llm import cover_tree, embedding_dedup, stars
from placewright.llm.embedding_dedup import Tile, linked, product, units

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vec string, n_links string, score string, id string, x string"


def frame(spark, rows, kind="float"):
    """(vec_id, vector, label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA.replace("array<float>", f"array<{kind}>")).repartition(3)


def clustered(seed: int, groups: int, each: int, dim: int = 24, spread: float = 0.12):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(groups, dim))
    out = [c / np.linalg.norm(c) + chance.normal(size=dim) * spread * chance.uniform(0.2, 1.6) for c in centres for _ in range(each)]
    return [[float(np.float32(v)) for v in x] for x in out]


def usable(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(v, dim):
    return np.array([*v, *[0.0] * (dim - len(v))])


def brute_links(rows, least=0.9):
    dim = max(len(v or []) for _, v, _ in rows)
    fit = [(i, padded(v, dim)) for i, v, _ in rows if usable(v) and any(v)]
    ids = sorted({-(1 << 63) if i is None else i for i, _, _ in rows})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n_links = []
    for k, (i, x) in enumerate(fit):
        n = 0
        for m, (j, y) in enumerate(fit):
            if k != m and (x @ y) / math.sqrt((x @ x) * (y @ y)) >= least:
                n += 1
                a, b = sorted((find(-(1 << 63) if i is None else i), find(-(1 << 63) if j is None else j)))
                parent[b] = a
        n_links.append((i, n))
    n_links += [(i, 0) for i, v, _ in rows if not (usable(v) and any(v))]
    real = lambda i: None if i == -(1 << 63) else i
    return sorted([(i, n, real(find(-(1 << 63) if i is None else i))) for i, n in n_links], key=str)


def links_of(df, **more):
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, **more).collect()], key=str)


def odd_rows():
    """Copies, near copies, null and odd vectors, a vector of other lengths, a repeated row, a row without an id."""
    rows = [(i, v, i % 10) for i, v in enumerate(clustered(1, 25, 8))]
    rows += [(1000 + i, rows[3][1], 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [math.nan] + [1.0] * 23, 1), (2003, [None] + [1.0] * 23, 1), (2004, [], 1), (2005, [math.inf, 1.0], 2)]
    rows += [(2006, [1.0, 2.0], 3), (2007, [10.0, 20.0, 0.0], 3), (2008, [1e-30, 2e-30], 4), rows[5], (None, rows[7][1], 2), (-4, rows[9][1], None)]
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = odd_rows()
    repeated = rows.index(rows[5], 6)
    apart = rows[:repeated] + rows[repeated + 1:]
    assert links_of(frame(spark, apart)) == brute_links(apart)
    assert links_of(frame(spark, apart, "double"), tile=17) == brute_links(apart)


def test_a_repeated_row_is_linked_with_itself(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    assert links_of(frame(spark, rows)) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    kept = {r.vec_id: r.kept for r in embedding_dedup.near_vectors(frame(spark, [*rows, (3, [2.0, 0.0], 0)])).collect()}
    assert kept == {1: True, 2: True, 3: False}


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(frame(spark, [])).collect() == []
    assert links_of(frame(spark, [(1, None, 0), (2, None, 0)])) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        embedding_dedup.near_vectors(frame(spark, []), least=0.0)


def test_far_tiles_never_meet(spark):
    rows = [(i, v, 0) for i, v in enumerate(clustered(3, 12, 40, spread=0.02))]
    seen = {}
    plain = embedding_dedup.facing

    def counted(tiles, count, least):
        out = plain(tiles, count, least)
        seen["met"], seen["tiles"] = out.count(), tiles.count()
        return out

    embedding_dedup.facing = counted
    try:
        got = links_of(frame(spark, rows), tile=40)
    finally:
        embedding_dedup.facing = plain
    assert got == brute_links(rows)
    assert seen["met"] < seen["tiles"] * (seen["tiles"] + 1) // 4


def tile(x, copies=None):
    x, fine = units(np.asarray(x, dtype=np.float64), np.ones(len(x), dtype=bool))
    assert fine.all()
    return Tile({"vec": np.arange(len(x)), "copies": np.ones(len(x), dtype=np.int64) if copies is None else copies, "unit": x})


@pytest.mark.parametrize("dim", [2, 64, 2500])
def test_products_of_codes_are_exact_and_bounds_hold(dim):
    chance = np.random.default_rng(dim)
    own = tile(chance.normal(size=(60, dim)) ** 3)
    codes = own.codes.astype(np.int64)
    assert (product(own.codes, own.codes) == codes @ codes.T).all()
    true = own.unit @ own.unit.T
    rough = (codes @ codes.T) * own.scale[:, None] * own.scale[None, :]
    bound = own.length[:, None] * own.error[None, :] + own.error[:, None] * (own.length + own.error)[None, :]
    assert (np.abs(true - rough) <= bound + 1e-12).all()


def test_only_pairs_near_the_threshold_are_worked_out_again():
    own = tile(clustered(5, 30, 20, dim=64, spread=0.05))
    asked = []

    class Counted:
        def __init__(self, rows):
            self.rows = rows

        def __getitem__(self, key):
            asked.append(len(key))
            return self.rows[key]

    true = np.argwhere(np.triu(own.unit @ own.unit.T >= 0.9, 1))
    own.unit = Counted(own.unit)
    found = np.concatenate([np.stack(p, axis=1) for p in linked(own, own, 0.9, 64)])
    assert sorted(map(tuple, found.tolist())) == sorted(map(tuple, true.tolist()))
    assert 0 < sum(asked) / 2 < len(true) / 2


def test_components_of_chains_stars_and_rings(spark, monkeypatch):
    monkeypatch.setattr(stars, "PART", 8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(90)] + [(900 + i, 900 + (i + 1) % 7) for i in range(7)] + [(5, 5), (550, 900), (100, 101)]
    got = {r.id: r.root for r in stars.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 500 for i in [*range(501, 591), *range(900, 907)]}
    assert got == want
    assert stars.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_negatives(rows):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    dim = max((len(v) for _, v in kept.values()), default=1)
    whole = {i: (label, [math.floor(256 * x) for x in [*v, *[0.0] * (dim - len(v))]]) for i, (label, v) in kept.items()}
    out = []
    for i, (label, x) in whole.items():
        if i % 100:
            continue
        score = {j: sum(a * b for a, b in zip(x, y, strict=True)) for j, (_, y) in whole.items() if j != i}
        ranked = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in ranked if whole[j][0] == label][:5]:
            fit = [j for j in ranked if whole[j][0] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(i, p, k + 1, j, score[p], score[j]) for k, j in enumerate(fit)]
    return sorted(out)


def negatives_of(df, **more):
    return sorted(map(tuple, cover_tree.hard_negatives(df, **more).collect()))


def labelled(seed: int, n: int, scale: float = 1.0, dim: int = 6):
    chance = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in chance.normal(size=dim) * scale], int(chance.integers(0, 10))) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = labelled(2, 1500)
    assert negatives_of(frame(spark, rows)) == brute_negatives(rows)
    assert negatives_of(frame(spark, rows), group=100, block=4) == brute_negatives(rows)


def test_negatives_of_odd_rows_and_ties(spark):
    rows = labelled(4, 400, 0.01) + [(1000 + i, [0.5] * 6, i % 3) for i in range(60)] + [(100, [0.5] * 6, 9), (100, [0.25] * 6, 0)]
    rows += [(2000, None, 1), (2100, [math.nan] + [1.0] * 5, 1), (2200, [None] + [1.0] * 5, 1), (2300, [1.0] * 6, None), (None, [1.0] * 6, 1), (2400, [], 1), (2500, [1.0], 2), (-100, [-1.0] * 6, 3)]
    assert negatives_of(frame(spark, rows)) == brute_negatives(rows)
    assert negatives_of(frame(spark, [])) == []


@pytest.mark.parametrize("scale", [3e4, 1e6])
def test_scores_beyond_exact_doubles(spark, scale):
    rows = labelled(6, 350, scale)
    assert negatives_of(frame(spark, rows)) == brute_negatives(rows)


def test_a_tree_covers_its_points_within_its_radii():
    chance = np.random.default_rng(8)
    x = np.floor(256 * np.concatenate([chance.normal(size=(20, 1, 5)) + 0.05 * chance.normal(size=(20, 40, 5))]).reshape(-1, 5))
    tree = cover_tree.Tree(x)
    assert sorted(tree.order) == list(range(len(x)))
    assert len(tree.nodes) > 10

    def below(node):
        _, _, first, children, begin, own = tree.nodes[node]
        return tree.order[begin:begin + own] + [p for c in range(first, first + children) for p in below(c)]

    for node, (centre, radius, *_rest) in enumerate(tree.nodes):
        assert np.linalg.norm(x[below(node)] - x[centre], axis=1).max() <= radius


def test_windows_leave_most_points_of_clustered_candidates_unseen():
    chance = np.random.default_rng(9)
    centres = chance.normal(size=(40, 16))
    x = np.floor(256 * (centres / np.linalg.norm(centres, axis=1)[:, None])[:, None, :] + 2 * chance.normal(size=(40, 50, 16))).reshape(-1, 16)
    forest = cover_tree.Forest(cover_tree.planted(np.arange(len(x)), np.arange(len(x)) % 2, x))
    seen = []
    search = cover_tree.Search(np.array([0]), np.array([0]), x[[0]], np.array([[-(1 << 62)]]), np.array([[1 << 62]]), True, 5)
    plain = search.verify
    search.verify = lambda forest, points, who: (seen.append(len(points)), plain(forest, points, who))
    search.descend(forest)
    assert sum(seen) < len(x) / 2
    score = x @ x[0]
    assert search.id.tolist() == sorted((i for i in range(2, len(x), 2)), key=lambda i: (-score[i], i))[:5]
