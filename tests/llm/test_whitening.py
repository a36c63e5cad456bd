"""Whitening against numpy over the whole table, and the merge against one pass."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.whitening import OFFSET, Model, Summary, whiten

SCHEMA = "vec_id long, embedding array<double>, n long, x binary, node long"


def frame_of(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, None, 2) for i, v in rows], SCHEMA).repartition(parts)


def usable(rows, width):
    return [(i, [math.floor(64 * c) + OFFSET for c in v] + [OFFSET] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(spark, rows, width, parts=5):
    got = {}
    for r in whiten(frame_of(spark, rows, parts)).collect():
        got.setdefault(r.vec_id, []).append(r)
    kept = usable(rows, width)
    assert sorted(got) == sorted({i for i, _ in kept}) and sum(map(len, got.values())) == len(kept) * min(16, width)
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    values, vectors = values[order], vectors[:, order]
    trace = (centred**2).sum() / n
    signs = None
    for i, x in kept:
        own = sorted(got[i], key=lambda r: r.component)[: min(16, width)]
        assert {r.n for r in own} == {n} and {r.deviation for r in own} == {sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))}
        assert np.allclose([r.explained for r in own], values / trace, rtol=1e-9) and max(r.identity_error for r in own) < 1e-8
        want = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)
        have = np.array([r.whitened for r in own])
        if signs is None and np.abs(want).min() > 0.05:
            signs = np.sign(want * have)
        if signs is not None:
            assert np.allclose(have, signs * want, atol=1e-7)
    assert signs is not None


def test_like_numpy(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 20)) @ r.normal(size=(20, 20)) / 8 + 3
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(1000 + k, v[0].tolist()) for k in range(150)]  # copies count once for the fit
    rows += [(2000, None), (2001, [None] * 20), (2002, [math.inf] * 20), (2003, [0.0] * 12)]
    check(spark, rows, 20)
    check(spark, rows, 20, parts=1)


def test_fewer_dimensions_than_components(spark):
    r = np.random.default_rng(4)
    check(spark, [(k, x.tolist()) for k, x in enumerate(r.normal(size=(50, 3)))], 3)


def test_far_from_zero(spark):
    """A spread of 1 about a hundred million: no digit is lost."""
    r = np.random.default_rng(5)
    check(spark, [(k, (x + 1e8).tolist()) for k, x in enumerate(r.normal(size=(120, 4)))], 4)


def test_odd_tables(spark):
    assert whiten(frame_of(spark, [])).count() == 0 and whiten(frame_of(spark, [(1, None)])).count() == 0 and whiten(frame_of(spark, [(1, [])])).count() == 0
    one = whiten(frame_of(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    line = whiten(frame_of(spark, [(k, [float(k), float(k), 5.0]) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line)
    # A deviation beyond a long is null; a vector beyond any exact product is dropped.
    huge = whiten(frame_of(spark, [(1, [1e7]), (2, [-1e7]), (3, [1e200])])).collect()
    assert [(r.vec_id, r.deviation) for r in sorted(huge)] == [(1, (2 * 640000000) ** 2), (2, (2 * 640000000) ** 2)]
    far = whiten(frame_of(spark, [(k, [k * 3e7]) for k in range(-1, 2)])).collect()
    assert {r.vec_id: r.deviation for r in far} == {-1: None, 0: 0, 1: None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-1000, 1000), min_size=3, max_size=3), min_size=2, max_size=40), st.integers(0, 5), st.integers(0, 1 << 40))
def test_merges_like_one_pass(rows, seed, offset):
    x = np.array(rows, np.int64) + offset
    parts = [Summary.of(p) for p in np.array_split(x, 1 + seed) if len(p)]
    while len(parts) > 1:
        parts = [parts[0].merged(parts[-1]), *parts[1:-1]]
    whole = Summary.of(x)
    assert parts[0].n == whole.n and parts[0].total == whole.total
    centred = (x - offset).astype(float) - (x - offset).astype(float).mean(axis=0)
    assert np.allclose(parts[0].scatter, centred.T @ centred, rtol=1e-9, atol=1e-3)
    assert Model(whole, 3).deviations(x) == [sum((len(x) * int(c) - t) ** 2 for c, t in zip(r, whole.total, strict=True)) for r in x]
