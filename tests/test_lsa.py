"""The space of each source against a plain decomposition, and the dense search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark.operators.lsa as module
import tidemark.operators.retrieval as retrieval
from tidemark.operators.lsa import lsa
from tidemark.operators.retrieval import nearest


def matrix(n, m, seed, rank=None):
    r = np.random.default_rng(seed)
    a = (r.random((n, m)) * (r.random((n, m)) < 0.3)) if rank is None else r.random((n, rank)) @ r.random((rank, m))
    a[:, 0] += 0.1
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def table(spark, sources):
    return spark.createDataFrame([(s, f"c{i}", f"t{j}", float(a[i, j]), 1.0 + int(j)) for s, a in sources.items() for i, j in zip(*np.nonzero(a))], "source string, chunk_id string, term string, w double, idf double")


@pytest.mark.parametrize("held", [3, 1 << 14])
def test_like_a_plain_decomposition(spark, monkeypatch, held):
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "ENTRIES", 40)
    sources = {"docs": matrix(30, 50, 1), "blog": matrix(7, 20, 2), "forum": matrix(40, 60, 3, rank=5)}
    rows = lsa(table(spark, sources).repartition(5), dims=24).collect()
    for source, a in sources.items():
        values, u = np.linalg.eigh(a @ a.T)
        order = np.argsort(-values)[:24]
        order = order[values[order] > 1e-9]
        s, u = np.sqrt(values[order]), u[:, order]
        x = u * np.sqrt(s)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        v = (a.T @ u) / s * np.sqrt(s)
        own = {r.key: np.array(r.vector) for r in rows if r.source == source and r.kind == "chunk"}
        space = {r.key: np.array(r.vector) for r in rows if r.source == source and r.kind == "term"}
        got_x, got_v = np.array([own[f"c{i}"] for i in range(len(a))]), np.array([space[f"t{j}"] for j in range(a.shape[1])])
        assert len(own) == len(a) and got_x.shape[1] == len(s)
        # Signs of directions are free, so products are compared.
        assert np.allclose(got_x @ got_x.T, x @ x.T, atol=1e-6) and np.allclose(got_x @ got_v.T, x @ v.T, atol=1e-6)
        assert {r.idf for r in rows if r.key == "t3" and r.kind == "term"} == {4.0}


def test_strongest_directions_of_a_large_source(spark):
    """More chunks and terms than the sketch is wide: nearly all of what the best space would hold."""
    a = matrix(300, 200, 5, rank=8) + 0.02 * matrix(300, 200, 6)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = lsa(table(spark, {"docs": a}), dims=8, width=24).collect()
    x = np.array([r.vector for r in sorted((r for r in rows if r.kind == "chunk"), key=lambda r: int(r.key[1:]))])
    q, _ = np.linalg.qr(x)
    best = (np.linalg.svd(a, compute_uv=False)[:8] ** 2).sum()
    assert ((q.T @ a) ** 2).sum() > 0.98 * best


def test_nearest_like_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.integers(-3, 4, (200, 5)).astype(float)
    q = r.integers(-3, 4, (12, 5)).astype(float)
    chunks = spark.createDataFrame([("ab"[i % 2], f"c{i}", i // 3, v.tolist()) for i, v in enumerate(x)], "source string, chunk_id string, doc_pos long, x array<double>").repartition(6)
    asked = spark.createDataFrame([(f"q{k // 2}", k % 2, s, v.tolist()) for k, v in enumerate(q) for s in "abz"], "qid string, qi int, source string, q array<double>")
    want = {}
    for k, v in enumerate(q):
        for s in "ab":
            near = sorted((-float(x[i] @ v), i // 3, f"c{i}") for i in range(200) if "ab"[i % 2] == s and x[i] @ v > 1e-6)[:7]
            want |= {(f"q{k // 2}", k % 2, s, c): n + 1 for n, (_, _, c) in enumerate(near)}
    for size in (1 << 20, 300):
        monkeypatch.setattr(retrieval, "QUESTION_BYTES", size)
        assert {(h.qid, h.qi, h.source, h.chunk_id): h["rank"] for h in nearest(asked, chunks, 7).collect()} == want
    assert nearest(asked.limit(0), chunks, 7).count() == 0 and nearest(asked, chunks.where(F.lit(False)), 7).count() == 0
