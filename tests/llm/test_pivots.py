"""Embedding near-duplicates against all pairs, and the index's own recall."""

import numpy as np
import pytest

from tidemark.llm.pivots import far_apart, list_keys, near_vectors, pivot_counts

SCHEMA = "vec_id long, embedding array<float>, label int, node long, unit string"


def clouds(seed, n, d=32):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        centre = r.normal(size=d)
        for _ in range(r.integers(1, 12)):
            rows.append(centre + r.normal(size=d) * r.choice([0, 0.02, 0.2, 0.33]))
    return np.array(rows, np.float32)


def brute(ids, vectors, least=0.9):
    x = vectors.astype(float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return {int(i): (int(near[k].sum()), int(ids[root[k]]), bool(root[k] == k)) for k, i in enumerate(ids)}


def test_like_brute_force(spark):
    x = clouds(1, 120)
    x = np.concatenate([x, x[:5], x[:3]])
    ids = np.arange(len(x)) * 2 + 3
    frame = spark.createDataFrame([(int(i), [float(a) for a in v], 1, 0, "") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    assert got == brute(ids, x)


def test_large_group_in_blocks(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=16) + r.normal(size=(400, 16)) * 0.25).astype(np.float32)
    ids = np.arange(400)
    frame = spark.createDataFrame([(int(i), [float(a) for a in v], None, None, None) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in near_vectors(frame).collect()}
    assert got == brute(ids, x)


def test_index_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.95 that are alone, so nothing but the index can find them."""
    r = np.random.default_rng(4)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = r.normal(size=a.shape)
    z -= (z * a).sum(axis=1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = r.uniform(0.901, 0.95, size=(400, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * z])
    frame = spark.createDataFrame([(i, [float(v) for v in row], 0, 0, "") for i, row in enumerate(x)], SCHEMA)
    got = {q.vec_id: q.component_id for q in near_vectors(frame).collect()}
    found = sum(got[i + 400] == i for i in range(400))
    assert found >= 0.95 * 400


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, 0, ""), (2, [2.0, 0.1], 0, 0, ""), (3, None, 0, 0, ""), (4, [], 0, 0, ""), (5, [0.0, 0.0], 0, 0, ""), (6, [nan, 1.0], 0, 0, ""),
        (7, [inf, 1.0], 0, 0, ""), (8, [None, 1.0], 0, 0, ""), (9, [1.0, 0.0, 0.0], 0, 0, ""), (None, [1.0, 0.0], 0, 0, ""), (2, [2.0, 0.1], 0, 0, ""), (10, [3e38, 0.0], 0, 0, ""),
    ]
    got = sorted(((q.vec_id, q.n_links, q.component_id, q.kept) for q in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), (None, 0, None, False), *alone], key=str)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [q.n_links for q in near_vectors(spark.createDataFrame(rows[:1], SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("n", [10**4, 10**6, 10**7, 10**8])
def test_index_recall_does_not_fall_with_the_number_of_vectors(n):
    """Lone pairs of cosine 0.90 share a list, with the pivots of ``n`` vectors."""
    r = np.random.default_rng(6)

    def unit(x):
        return x / np.linalg.norm(x, axis=1)[:, None]

    count, sets = pivot_counts(n)
    pivots = [far_apart(unit(r.normal(size=(4096, 64))), count) for _ in range(sets)]
    a = unit(r.normal(size=(1000, 64)))
    z = r.normal(size=a.shape)
    z = unit(z - (z * a).sum(axis=1)[:, None] * a)
    size = np.full(len(a), 64)
    x, y = (list_keys(v, size, pivots) for v in (a, 0.9 * a + np.sqrt(1 - 0.81) * z))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) >= 0.98
