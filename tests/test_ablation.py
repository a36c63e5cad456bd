"""Ablations in one run for each index against engine runs one by one, and the bootstrap against plain Python."""

import hashlib
import math
import os

import pytest

from tidemark.config import EngineConfig
from tidemark.operators.evaluation import bootstrap_interval, bootstrap_samples, summary
from tidemark.plans.engine import Engine, ablations, variant_scores
from tidemark.sources.corpus import read_corpus, read_gold

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
ASKED = {
    "bm25_only": {"index.dense.enabled": False, "rerank.enabled": False, "retrieval.query_analysis.expand_queries": False},
    "expansion": {"rerank.enabled": False},
    "rerank": {"rerank.mmr.enabled": False, "rerank.caps.max_per_source": 99, "rerank.caps.max_per_document": 99},
    "default": {},
    "reranker_only": {"rerank.alpha": 1.0},
}


@pytest.fixture(scope="module")
def corpus(spark):
    return read_corpus(spark, f"{HERE}/docs", f"{HERE}/threads.json", f"{HERE}/articles.json")


@pytest.fixture(scope="module")
def gold(spark):
    return read_gold(spark, f"{HERE}/gold.yaml")


def test_variants_like_single_runs(spark, corpus, gold):
    engine = Engine.build(corpus)
    variants = {name: EngineConfig().variant(o) for name, o in ASKED.items()}
    scores = variant_scores(engine.index, variants, gold)
    rows = {r.variant: r for r in summary(scores, "variant").collect()}
    assert set(rows) == set(ASKED)
    # One that is not reranked and has one arm, and one that is with another blend; a run alone takes as long as all of them together.
    for name in ("bm25_only", "reranker_only"):
        config = variants[name]
        one = Engine(engine.index, config).evaluate(gold)[1].first().asDict()
        assert one == {c: rows[name][c] for c in one}, name


def test_all_named_variants(spark, corpus, gold):
    """The relations between configurations that hold on these fixtures: two arms and one find the same pool or more, reranking does not lose to fusion alone, and only reranked answers are not refused."""
    rows = {r.variant: r for r in ablations(spark, corpus, gold).collect()}
    assert len(rows) == 9 and all(r.questions == 4 and r.ndcg10_low <= r.ndcg10_high for r in rows.values())
    assert rows["hybrid"].recall20_pool >= max(rows["bm25_only"].recall20_pool, rows["dense_only"].recall20_pool) - 1e-9
    assert rows["expansion"].recall20_pool >= rows["headers"].recall20_pool
    assert rows["rerank"].ndcg10 >= rows["expansion"].ndcg10 and rows["default"].ndcg10 >= 0.5
    assert rows["default"].source_recall >= rows["expansion"].source_recall
    assert rows["default"].conflict_detected >= rows["expansion"].conflict_detected and rows["default"].refusal_correct == 1.0
    assert rows["rerank"].mrr == pytest.approx(rows["default"].mrr, abs=0.25)


def plain_means(values, samples, seed):
    table = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    out = []
    for s in range(samples):
        n, total = 0, 0.0
        for key, v in values:
            if v is None:
                continue
            u = int(hashlib.md5(f"{seed}:{s}:{key}".encode()).hexdigest()[:12], 16) / 2**48
            w = sum(u >= p for p in table)
            n, total = n + w, total + w * v
        if n:
            out.append((s, total / n))
    return out


def test_bootstrap(spark):
    values = [(f"q{i}", (i * 37 % 101) / 101) for i in range(60)] + [("none", None)]
    frame = spark.createDataFrame(values, "qid string, m double").repartition(5)
    got = {r["sample"]: r["mean"] for r in bootstrap_samples(frame, "m", 200, 7).collect()}
    want = dict(plain_means(values, 200, 7))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    one = bootstrap_interval(frame, "m", 200, 7).first()
    means = sorted(want.values())
    assert (round(one.low, 9), round(one.high, 9)) == (round(means[5], 9), round(means[195], 9)) and one.low < one["mean"] < one.high
    # The spread is that of a bootstrap: about the standard error of the mean.
    v = [x for _, x in values if x is not None]
    error = math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v)) / len(v)
    assert 2.8 * error < one.high - one.low < 5.2 * error
    assert bootstrap_interval(frame.where("m < 0"), "m", 10).count() == 0
    by = bootstrap_interval(frame.selectExpr("qid", "m", "qid > 'q3' as g"), "m", 50, 7, ("g",))
    assert by.count() == 2
