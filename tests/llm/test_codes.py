"""Vector codes against all distances taken."""

import hashlib
import math

import numpy as np
import pytest

from lexstrata.llm import codes

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    v = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((v[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = v[at[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    at, d = nearest()
    error = d.sum(axis=1)
    totals = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in row), e, totals[label], digest) for (i, _, label), row, e in zip(kept, at.tolist(), error.tolist()))


def _rows(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(int(i), (centres[i % 9] * (i % 2 + 1) + rng.normal(size=dim) * rng.choice([0, 0.01, 0.3])).tolist(), None if i % 5 == 0 else int(i % 3))
            for i in rng.permutation(n)]
    return rows


@pytest.mark.parametrize("seed,n,dim,parts", [(1, 700, 32, 3), (2, 40, 16, 2), (3, 300, 64, 5)])
def test_codes_against_all_distances(spark, seed, n, dim, parts):
    rows = _rows(seed, n, dim)
    got = codes.code_report(spark.createDataFrame(rows, VECTORS).repartition(parts))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("leaf", [1, 16])
@pytest.mark.parametrize("width", [1, 4, 9])
def test_tree_walk_equals_all_distances(leaf, width):
    rng = np.random.default_rng(width)
    for n, k, reach in ((1, 1, 5), (3, 64, 2), (500, 64, 3), (3000, 33, 400), (2000, 64, 1)):
        points, entries = rng.integers(-reach, reach + 1, (n, width)), rng.integers(-reach, reach + 1, (k, width))
        labels, counts, sums = codes.nearest_entries(points, entries, leaf)
        want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (labels == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def test_whole_nodes_are_assigned():
    """Parts in far clusters never meet the leaves."""
    rng = np.random.default_rng(8)
    centres = np.arange(8)[:, None] * np.array([[10_000, 0]])
    points = np.repeat(centres, 400, axis=0) + rng.integers(-5, 6, (3200, 2))
    seen = []
    whole, codes._leaves = codes._leaves, lambda *a: seen.append(a)
    try:
        labels, counts, _ = codes.nearest_entries(points, centres)
    finally:
        codes._leaves = whole
    assert not seen and (counts == 400).all() and (labels == np.repeat(np.arange(8), 400)).all()


def test_odd_vectors(spark):
    rows = _rows(6, 90, 16)
    odd = rows + [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, None), (1003, [float("inf")] + [0.0] * 15, 2),
                  (1004, [], 1), rows[0], rows[0], (rows[0][0], rows[1][1], 7)]
    df = spark.createDataFrame(odd, VECTORS).selectExpr("*", "'clash' as id", "'clash' as v", "'clash' as error", "'clash' as codes", "'clash' as slot")
    assert sorted(tuple(r) for r in codes.code_report(df).collect()) == plain(odd)
    other = spark.createDataFrame(rows + [(2000, [1.0] * 32, 1), (2001, [1.0] * 17, 1), (2002, [1e30] * 16, 1)], VECTORS)
    assert sorted(tuple(r) for r in codes.code_report(other).collect()) == plain(rows)
    assert codes.code_report(spark.createDataFrame([], VECTORS)).count() == 0
