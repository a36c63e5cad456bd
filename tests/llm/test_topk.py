"""Top-k search against all inner products, one by one."""

import math

import numpy as np
import pytest

import tidemark.llm.topk as module
from tidemark.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, score string, class string, list int"


def brute(rows, k=20, every=20):
    """The definition in whole Python numbers; rows are (id, vector) with distinct ids."""
    x = {}
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x[i] = [math.floor(64 * c) for c in v]
    out = {}
    for q in x:
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(x[q], v, strict=False)), i) for i, v in x.items() if i != q)[:k]
            if hits:
                out[q] = [(i, -s) for s, i in hits]
    return out


def answers(frame, **options):
    out = {}
    for r in top_k(frame, **options).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(hits) == list(range(1, len(hits) + 1)) for hits in out.values())
    return {q: [hits[n] for n in sorted(hits)] for q, hits in out.items()}


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_like_all_products(spark, monkeypatch, lists):
    """Blocks of a few rows, many ties, copies and near copies, scores of both signs, ids below zero."""
    monkeypatch.setattr(module, "ROWS", 60)
    monkeypatch.setattr(module, "QUERIES", 7)
    monkeypatch.setattr(module, "AT_ONCE", 4)
    r = np.random.default_rng(lists)
    base = r.normal(size=(12, 9)) / 3
    rows = []
    for i in range(400):
        v = base[r.integers(12)] + (r.normal(size=9) / 20 if i % 3 else 0)
        rows.append((i * 5 - 300, (np.round(v, 1) if i % 2 else v).tolist()))
    rows += [(5000 + i, base[0].tolist()) for i in range(60)]
    rows += [(9000, None), (9020, [1.0, None] * 4 + [0.0]), (9040, [math.nan] * 9), (9060, [math.inf] * 9), (9080, [0.0] * 9), (None, [1.0] * 9)]
    assert answers(frame_of(spark, rows), lists=lists) == brute(rows)


def test_floor_of_floats(spark):
    """Components are floats; 64 times their value as a double is floored, below zero too."""
    rows = [(i * 20, [float(np.float32(v)) for v in (-0.015625 * i, 0.1 * i, -1e-9)]) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(frame) == brute(rows)


def test_large_numbers(spark):
    """Products beyond 2^24 and 2^53 are exact; vectors whose products need not fit a long take no part."""
    r = np.random.default_rng(8)
    for scale in (1e3, 1e6, 5e6):
        rows = [(i * 10, (r.normal(size=5) * scale).tolist()) for i in range(60)]
        assert answers(frame_of(spark, [*rows, (7, [1e300] * 5), (40001, [1e8] * 5)])) == brute(rows)


def test_odd_tables(spark):
    assert answers(frame_of(spark, [])) == {} and answers(frame_of(spark, [(0, [1.0, 2.0])])) == {}
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5]), (40, []), (60, [-1.0, -1.0])]
    assert answers(frame_of(spark, few)) == brute(few)
    assert answers(frame_of(spark, [(0, []), (20, [])])) == {0: [(20, 0)], 20: [(0, 0)]}
    # Of rows that repeat an id one counts.
    twice = answers(frame_of(spark, [(0, [1.0]), (0, [1.0]), (3, [2.0]), (3, [2.0])]))
    assert twice == {0: [(3, 64 * 128)]}


def test_cutoffs_spare_entries(spark):
    """Of vectors without structure the lists send far fewer entries than there are pairs."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=32) / 6).tolist()) for i in range(3000)]
    sent = []
    real = module.seen

    def counted(entries, lists):
        sent.append(entries.count())
        return real(entries, lists)

    module.seen = counted
    try:
        got = answers(frame_of(spark, rows))
    finally:
        module.seen = real
    assert got == brute(rows) and sent[1] < 0.15 * 150 * 3000 * 2
