"""Most similar vectors against brute force, with copies, ties, unusable vectors and empty tables."""

import numpy as np
import pytest
from codeloom.llm import neighbors as nb

SCHEMA = "id string, embedding array<float>, vec string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in rows], SCHEMA)


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], np.float64)
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    out = set()
    for a in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda b: (-round(s[a, b], 7), ids[b]))[:k]
        out |= {tuple(sorted((ids[a], ids[b]))) for b in order if s[a, b] >= least}
    return out


def clusters(n, dim, seed, spread=0.25, per=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // per), dim))
    return [(f"v{i:05d}", centres[i % len(centres)] + spread * rng.normal(size=dim)) for i in range(n)]


def test_recall_and_exact_scores(spark):
    rows = clusters(3_000, 64, 1)
    p = nb.Params(list_size=64)
    got = nb.similar_pairs(table(spark, rows), p).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    want = brute(rows, p.k, p.least)
    assert len(pairs & want) / len(want) >= 0.97
    assert all(r.id_a < r.id_b and r.sim >= p.least for r in got) and len(got) == len(pairs)


def test_copies_ties_and_unusable(spark):
    one = np.eye(8)[0]
    rows = [(f"c{i:02d}", one * (i + 1 if i % 2 else 1)) for i in range(20)] + [("near", one + 0.1 * np.eye(8)[1]), ("far", np.eye(8)[2])]
    bad = [("null", None), ("short", [1.0, 2.0]), ("zero", np.zeros(8)), ("nan", [float("nan")] * 8), ("inf", [float("inf")] + [0.0] * 7), ("hole", [1.0] + [None] * 7)]
    p = nb.Params(dim=8, k=3, least=0.9)
    got = {(r.id_a, r.id_b) for r in nb.similar_pairs(table(spark, rows + bad), p).collect()}
    assert got == brute(rows, 3, 0.9)
    assert ("c00", "c19") in got and ("c00", "near") in got and not any("far" in x for x in got)


def test_empty_and_single(spark):
    assert nb.similar_pairs(table(spark, []), nb.Params(dim=8)).count() == 0
    assert nb.similar_pairs(table(spark, [("a", np.ones(8)), ("b", None)]), nb.Params(dim=8)).count() == 0


def test_lists_in_blocks(spark):
    rows = clusters(400, 16, 5, per=100)
    a, b = nb.Params(dim=16, least=0.5, list_size=400), nb.Params(dim=16, least=0.5, list_size=400, block=37)
    x = {tuple(r) for r in nb.similar_pairs(table(spark, rows), a).select("id_a", "id_b").collect()}
    y = {tuple(r) for r in nb.similar_pairs(table(spark, rows), b).select("id_a", "id_b").collect()}
    assert x == y == brute(rows, 5, 0.5)


def test_full_lists_are_cut_into_parts_and_divided(spark):
    """Three lists for 3,000 vectors, a third of them close together: parts of 300 rows at most twice, with lists of their own."""
    rows = clusters(2_000, 64, 7) + [(f"h{i:05d}", v) for i, (_, v) in enumerate(clusters(1_000, 64, 8, per=1_000))]
    p = nb.Params(max_lists=3, part_rows=300, divide=128)
    got = {(r.id_a, r.id_b) for r in nb.similar_pairs(table(spark, rows), p).collect()}
    want = brute(rows, p.k, p.least)
    assert len(got & want) / len(want) >= 0.95
    whole = {(r.id_a, r.id_b) for r in nb.similar_pairs(table(spark, rows), nb.Params(max_lists=3, part_rows=300, divide=10**9, probes=3)).collect()}
    assert len(whole & want) / len(want) >= 0.99  # all members of a list meet all its questions


def test_cells():
    parts = np.array([[1, 3], [1, 4]])
    to, member, r = np.array([0, 1, 1, 1]), np.array([True, True, True, False]), np.array([5, 7, 8, 9])
    at, part, mine, asks = nb.cells(to, member, r, parts)
    got = sorted(zip(at.tolist(), part.tolist(), mine.tolist(), asks.tolist()))
    assert got[0] == (0, 0, True, True)
    for i in (1, 2):
        assert sum(m for k, _, m, _ in got if k == i) == 4 and sum(q for k, _, _, q in got if k == i) == 3
    assert [(m, q) for k, _, m, q in got if k == 3] == [(False, True)] * 3
    meet = lambda i, j: {c for k, c, m, _ in got if k == i and m} & {c for k, c, _, q in got if k == j and q}
    assert all(len(meet(i, j)) == 1 for i in (1, 2) for j in (1, 2, 3))


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2_000])
def test_graph_search_finds_the_nearest(n):
    rng = np.random.default_rng(n)
    c = rng.normal(size=(n, 32)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = rng.normal(size=(200, 32)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, sim = nb.search(nb.build_graph(c, 16, 3), q, 3)
    best = np.argmax(q @ c.T, axis=1)
    assert (ids[:, 0] == best).mean() >= 0.85
    assert np.all(np.diff(np.where(sim < -8, -8, sim), axis=1) <= 1e-6)


def test_centroids_are_balanced():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(4_000, 16)) * 0.01 + np.eye(16)[0], rng.normal(size=(2_000, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, sizes = nb.fit_centroids(x, 60, 1)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    assert 40 <= len(c) <= 240 and size.max() <= 6 * len(x) / 60
    assert nb.fit_centroids(np.tile(x[:1], (500, 1)), 60, 1)[1].sum() == 500 and sizes.sum() == len(x)


def test_vectors_beyond_the_sample(spark):
    """A sample of 1 in 20 of clusters of three: most clusters are in no sample, and their pairs are found all the same."""
    rows = clusters(2_000, 64, 9, spread=0.2, per=3)
    want = brute(rows, 5, 0.88)
    got = {(r.id_a, r.id_b) for r in nb.similar_pairs(table(spark, rows), nb.Params(sample_rows=100, list_size=8)).collect()}
    assert len(got & want) / len(want) >= 0.99


def test_lists_are_fitted_to_all_vectors_by_cells(spark):
    """Cells of about 100 rows; a cell that is too full is dealt out."""
    rows = clusters(1_500, 64, 10, spread=0.2, per=3) + [(f"h{i:05d}", v) for i, (_, v) in enumerate(clusters(500, 64, 8, per=500))]
    p = nb.Params(sample_rows=200, cell_rows=100)
    m = np.array([v for _, v in rows], np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    units = spark.createDataFrame([(i, bytearray(x.tobytes())) for (i, _), x in zip(rows, m)], "id string, vec binary")
    c, sizes = nb.fit_lists(units, len(rows), p)
    assert sizes.sum() == len(rows) and len(c) == len(sizes) >= 20
    assert np.array_equal(c, nb.fit_lists(units.repartition(3), len(rows), p)[0])


def test_search_of_centroids_in_knots():
    """400 knots of 40 centroids each: the nearest neighbours of a centroid are all in its knot, and the search finds other knots all the same."""
    rng = np.random.default_rng(4)
    knots = rng.normal(size=(400, 64))
    c = (np.repeat(knots, 40, axis=0) + 0.3 * rng.normal(size=(16_000, 64))).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = (knots + 0.5 * rng.normal(size=(400, 64))).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = nb.search(nb.build_graph(c, 32, 3), q, 6)
    assert (ids[:, 0] == np.argmax(q @ c.T, axis=1)).mean() >= 0.98
