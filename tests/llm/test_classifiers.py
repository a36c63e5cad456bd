"""Toxicity and quality: segment search against all segments, the chain against enumeration, held-out accuracy."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.crf import Chain, marginals, viterbi
from tidemark.llm.quality import fit, quality
from tidemark.llm.toxicity import DRIFT, LEAST_TEXTS, PRIOR, STEMS, WHOLE, Forms, ToxicModel, Z, scorer_of, segments, toxicity, train, without_toxic


def all_maximal(scores):
    """Maximal segments by definition: the best segment of a stretch (the shortest of equals), then the same left and right of it."""

    def parts(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return parts(a, i) + [(i, j, best[0])] + parts(j, b)

    return parts(0, len(scores))


def test_segments_are_the_maximal_ones():
    r = random.Random(0)
    for _ in range(300):
        n = r.randint(1, 25)
        at = sorted(r.sample(range(n), r.randint(0, n)))
        score = [r.choice([0.7, 1.3, 2.9, -0.4]) + r.random() / 100 for _ in at]
        full = [-0.5] * n
        for i, s in zip(at, score, strict=True):
            full[i] = s
        got = segments(np.array(at, int), np.array(score), 0.5)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in all_maximal(full)]
        assert np.allclose([s for *_, s in got], [s for *_, s in all_maximal(full)])


def test_chain_against_enumeration():
    r = np.random.default_rng(1)
    chain = Chain(np.zeros((1, 3)), r.normal(size=(3, 3)), r.normal(size=3))
    emit = r.normal(size=(2, 4, 3))
    length = np.array([4, 2])
    p, _, total = marginals(emit, length, chain)
    paths = viterbi(emit, length, chain)
    for k, n in enumerate(length):
        score = {y: chain.first[y[0]] + sum(emit[k, i, y[i]] for i in range(n)) + sum(chain.steps[a, b] for a, b in zip(y, y[1:])) for y in itertools.product(range(3), repeat=int(n))}  # noqa: B905
        z = np.log(sum(np.exp(s) for s in score.values()))
        assert np.isclose(total[k], z) and tuple(paths[k, :n]) == max(score, key=score.get)
        for i in range(n):
            assert np.allclose(p[k, i], [sum(np.exp(s - z) for y, s in score.items() if y[i] == c) for c in range(3)])


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic, bad = int(r.random() < 0.2), int(r.random() < 0.25)
        lines = [" ".join(r.choice(words) for _ in range(r.randint(8, 20))).capitalize() + "." for _ in range(r.randint(1, 6))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                k = r.randrange(len(lines))
                lines[k] += f" zorg{r.choice('abcdefgh')}{r.choice('xyz')} vile"
        if bad:
            lines = [lines[0], *[" ".join(f"{w}$$$" for w in x.split()) if r.random() < 0.5 else " ".join([x.split()[0]] * 15) for x in lines]]
        docs.append((i, "\n".join(lines), "en", 1.0))
        labels.append((i, 1 - bad, toxic, "x"))
    docs += [(9001, None, None, 0.0), (9002, "", None, 0.0), (9003, " \n \n", None, 0.0), (None, "plain words", None, 0.0), (9004, "word " * 50000, None, 0.0), (9004, "twice", None, 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("operator", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out(corpus, operator, label):
    docs, labels = corpus
    got = operator(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    seen = {r.doc_id: r for r in rows}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if seen[i].held_out]
    assert len(held) > 150
    assert np.mean([seen[i].predicted == truth[i] for i in held]) > 0.95
    again = {r.doc_id: r.score for r in operator(docs.repartition(5).withColumn("lang", F.lit("zz")), labels).collect()}
    assert all(abs(again[i] - seen[i].score) < 1e-6 for i in truth)


def test_untrainable_and_empty(corpus):
    docs, labels = corpus
    assert {r.predicted for r in toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).count() == 0 and quality(docs.limit(0), labels).count() == 0


def test_rejection(corpus):
    docs, labels = corpus
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in gone), key=str)


def test_copies_of_a_one_word_text():
    """A word repeats only one of its own text, so neighbours do not change a score."""
    word = Forms().of(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))[0][0]
    score = scorer_of(ToxicModel(word, np.array([5.0]), 1.0, 0.5, np.array([-3.0, 1.0, 1.0, 0.0])))()
    texts = ["vile", "vile", "", "vile", "so vile", "vile vile", "clean"]
    together = [p for _, _, (_, s, _) in score(pa.array(texts)) for p in s]
    alone = [float(next(iter(score(pa.array([t]))))[2][1][0]) for t in texts]
    assert np.allclose(together, alone) and together[0] == together[1] == together[3] > together[6]


def test_segments_take_linear_time():
    """200,000 hits that stay apart, and as many that join."""
    began = time.perf_counter()
    apart = segments(np.arange(0, 2_000_000, 10), np.full(200_000, 2.0), 0.5)
    joined = segments(np.arange(0, 400_000, 2), np.full(200_000, 2.0), 0.5)
    falling = segments(np.arange(0, 2_000_000, 10), np.linspace(4, 1, 200_000), 0.5)
    assert (len(apart), len(joined), len(falling)) == (200_000, 1, 200_000) and time.perf_counter() - began < 5


def plain_forms(text):
    words = re.findall("[a-z]+", text.lower())
    return [{w} | {w[:n] + "*" for n in STEMS if len(w) > n} if i == 0 or words[i - 1] != w else set() for i, w in enumerate(words)]


def test_model_and_scores_against_plain_python(corpus):
    """Copies count once, whatever the partitions; scores are those of all maximal segments of the model's words."""
    docs, labels = corpus
    texts = [(r.doc_id, r.text) for r in docs.where("doc_id < 300").collect()]
    label = {r.doc_id: r.toxic for r in labels.collect()}
    copies = [(10_000 + i, next(t for d, t in texts if label[d]), 1) for i in range(40)]
    docs = docs.select("doc_id", "text").where("doc_id < 300").unionByName(docs.sparkSession.createDataFrame([c[:2] for c in copies], "doc_id long, text string"))
    labels = labels.select("doc_id", "toxic").unionByName(docs.sparkSession.createDataFrame([(c[0], 1) for c in copies], "doc_id long, toxic int"))
    model = train(docs, labels)
    again = train(docs.repartition(5), labels.repartition(3))
    assert all((a == b).all() for a, b in ((model.form, again.form), (model.score, again.score), (model.weights, again.weights))) and (model.lam, model.k) == (again.lam, again.k)
    every = [(d, t, label[d]) for d, t in texts] + copies
    own = [(t, y) for d, t, y in every if zlib.crc32(str(d).encode()) % 3 != 1]
    same = Counter(own)
    counts, totals, held = [Counter(), Counter()], [0.0, 0.0], Counter()
    for (t, y), n in same.items():
        # The weights of n copies add up to 1, but for their rounding to parts of WHOLE.
        w = n * max(1, round(WHOLE / n)) / WHOLE
        forms = plain_forms(t)
        totals[y] += w * len(forms)
        seen = Counter(f for fs in forms for f in fs)
        for f, k in seen.items():
            counts[y][f] += w * k
            held[f] += w * y
    scores = {}
    for f in held:
        prior = PRIOR * (counts[0][f] + counts[1][f]) / sum(totals) + 0.5
        y, x = counts[1][f] + prior, counts[0][f] + prior
        odds, spread = np.log(y / (totals[1] + PRIOR - y)) - np.log(x / (totals[0] + PRIOR - x)), np.sqrt(1 / y + 1 / x)
        if held[f] >= LEAST_TEXTS and odds / spread >= Z and odds - spread > 3 * DRIFT:
            scores[f] = odds - spread
    assert np.allclose(sorted(scores.values()), sorted(model.score), rtol=1e-9) and len(scores) > 3
    got = {r.doc_id: r.score for r in toxicity(docs, labels, model=model).collect()}
    for d, t, _ in every[:120]:
        forms = plain_forms(t)
        steps = [max([scores[f] for f in fs if f in scores], default=0.0) - DRIFT for fs in forms]
        found = [s for *_, s in all_maximal(steps)]
        base = np.log(max(1.0, model.k * len(forms)))
        x = [1.0, np.log1p(sum(max(0.0, model.lam * s - base) for s in found)), np.log1p(max([0.0, *(model.lam * s for s in found)])), np.log1p(len(forms)) / 10]
        assert np.isclose(got[d], 1 / (1 + np.exp(-(model.weights @ x))), atol=1e-9)


def plain_line(line, words, repeated):
    """The features of a line by their definitions; sizes in bytes."""
    raw = line.encode()
    count = lambda ok: sum(1 for c in raw if ok(c))
    upper, lower, digit = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122), count(lambda c: 48 <= c <= 57)
    odd = count(lambda c: c < 128 and not chr(c).isalnum() and chr(c) not in " \t\n\v\f\r.,;:'\"-()?")
    again = sum(a.lower() == b.lower() for a, b in zip(words, words[1:]))  # noqa: B905
    n, size = len(words), len(raw)
    return [
        np.log1p(size) / 5, upper / max(1, upper + lower), digit / size, odd / size, line.count("!") / n, line.count("|") / n, len({w.lower() for w in words}) / n, again / n,
        min(size / n, 30) / 10, float(line[-1] in ".!?:;\"')"), float(repeated), float(words[0][0].isascii() and words[0][0].isupper()), np.log1p(n) / 5, float(n < 3),
    ]


def test_quality_against_plain_python(corpus):
    """Marginals by enumeration of all labels of a text's lines, weighted by length."""
    docs, labels = corpus
    model = fit(docs, labels)
    odd = [(70_001, "Same line here\nSame line here\n\n  \nDer Überfluss, ja! | x |\nA A a 12 %%"), (70_002, "x")]
    some = docs.select("doc_id", "text").where("doc_id < 60").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in quality(some, labels, model=model).collect()}
    for d, text in ((r.doc_id, r.text) for r in some.collect()):
        white = " \t\v\f\r"
        lines = [x for x in text.split("\n") if x.strip(white)]
        alike = Counter(x.lower() for x in lines)
        f = np.array([plain_line(x, re.findall(f"[^{white}]+", x), alike[x.lower()] > 1) for x in lines])
        z = (f.astype(np.float32).astype(float) - model.mean) / model.scale
        edge = np.zeros((1, z.shape[1]))
        emit = np.c_[np.ones(len(z)), z, np.r_[edge, z[:-1]], np.r_[z[1:], edge]] @ model.chain.features
        good, total = np.zeros(len(lines)), 0.0
        for y in itertools.product((0, 1), repeat=len(lines)):
            p = np.exp(model.chain.first[y[0]] + sum(emit[i, v] for i, v in enumerate(y)) + sum(model.chain.steps[a, b] for a, b in zip(y, y[1:])))  # noqa: B905
            total += p
            good += p * (np.array(y) == 0)
        size = np.array([len(x.encode()) for x in lines])
        share = np.clip((good / total * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
        want = 1 / (1 + np.exp(-(model.weights @ [1.0, np.log(share / (1 - share)) / 3, 0.0])))
        assert np.isclose(got[d], want, atol=1e-5), d


def test_quality_learns_from_whole_texts_whatever_the_partitions(corpus):
    docs, labels = corpus
    long = docs.sparkSession.createDataFrame([(80_000 + i, "\n".join(["A plain line of words here."] * 200 + ["$$$ %%% ### $$$"] * 150)) for i in range(3)], "doc_id long, text string")
    docs, labels = docs.select("doc_id", "text").unionByName(long), labels.select("doc_id", "quality").unionByName(long.select("doc_id", F.lit(0).alias("quality")))
    one, two = fit(docs, labels), fit(docs.repartition(7), labels.repartition(2))
    assert (one.chain.features == two.chain.features).all() and (one.weights == two.weights).all()
    few = fit(docs, labels, most_lines=500)
    assert few is not None and not np.allclose(few.mean, one.mean)
    rows = {r.doc_id: r.score for r in quality(docs.where("doc_id is not null"), labels, model=one).collect()}
    again = {r.doc_id: r.score for r in quality(docs.where("doc_id is not null").repartition(9), labels, model=one).collect()}
    assert max(abs(rows[d] - again[d]) for d in rows if d != 9004) < 1e-9
