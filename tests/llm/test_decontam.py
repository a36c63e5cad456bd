"""Greedy string tiling against a plain search for longest matches."""

import random
import tracemalloc

import numpy as np
import pytest

import tidemark.llm.decontam as module
from tidemark.llm.decontam import benchmark_overlaps, decontaminate

SCHEMA = "doc_id long, text string, item_id long, coverage double"


def plain_tiles(item, text, least):
    """Words of the item in tiles: the longest unmarked match again and again, found by trying all places."""
    used_item, used_text, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_item and j + n not in used_text:
                    n += 1
                if n >= least and (n, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (n, i, j)
        n, i, j = best
        if not n:
            return covered
        used_item |= set(range(i, i + n))
        used_text |= set(range(j, j + n))
        covered += n


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_like_plain_tiling(spark, monkeypatch, pairs):
    monkeypatch.setattr(module, "PAIRS", pairs)
    r = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([2, 4, 5, 9, 20, 30])))) for k in range(12)]
    docs = []
    for d in range(25):
        parts = []
        for _ in range(r.randint(0, 3)):
            parts.append(" ".join(r.choice(words) for _ in range(r.randint(0, 12))))
            w = r.choice(items)[1].split()
            cut = r.randint(0, len(w))
            parts.append(" ".join(w[cut:] + w[:cut]) if r.random() < 0.5 else " ".join(w))
        docs.append((d, " ".join(parts).title() if r.random() < 0.3 else "\n".join(parts), 0, 0.0))
    got = {(x.doc_id, x.item_id): (x.item_words, x.covered_words) for x in benchmark_overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            a, b = item.lower().split(), text.lower().split()
            covered = plain_tiles(a, b, min(5, len(a)))
            if covered >= 0.8 * len(a):
                want[d, i] = (len(a), covered)
    assert got == want and len(want) > 5


def test_reordered_passage_and_odd_rows(spark):
    words = [f"q{k}" for k in range(30)]
    item = " ".join(words)
    swapped = " ".join(words[15:] + ["x"] + words[:15])
    docs = [(1, swapped, 0, 0.0), (2, " ".join(words[:20]), 0, 0.0), (3, None, 0, 0.0), (4, "", 0, 0.0), (None, item, 0, 0.0), (5, "pad " * 40000 + item.upper(), 0, 0.0), (1, swapped, 0, 0.0)]
    frame = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(7, item, "a"), (8, None, "b"), (9, "", "c"), (None, "q0 q1", "d")], "item_id long, text string, doc_id string")
    got = sorted(((x.doc_id, x.item_id, x.covered_words, x.coverage) for x in benchmark_overlaps(frame, bench).collect()), key=str)
    short = [(i, None, 2, 1.0) for i in (1, 1, 2, None, 5)]
    assert got == sorted([(1, 7, 30, 1.0), (1, 7, 30, 1.0), (None, 7, 30, 1.0), (5, 7, 30, 1.0), *short], key=str)
    long_only = bench.where("item_id = 7")
    assert sorted((x.doc_id for x in decontaminate(frame, long_only).collect()), key=str) == sorted([2, 3, 4, None], key=str)
    assert benchmark_overlaps(frame, bench.limit(0)).count() == 0 and benchmark_overlaps(frame.limit(0), bench).count() == 0


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "BENCHMARK_BYTES", 200)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(8))) for k in range(12)]
    docs = [(k, f"pad {items[k][1]} pad", 0, 0.0) for k in range(12)]
    got = {(x.doc_id, x.item_id) for x in benchmark_overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(12)}


def test_hashes_are_stable():
    from tidemark.llm.arrays import gram_hashes

    word = np.arange(20, dtype=np.uint64)
    assert (gram_hashes(word, 5)[3:] == gram_hashes(word[3:], 5)).all()


@pytest.mark.parametrize("alphabet", [1, 2, 3])
def test_words_that_repeat(alphabet):
    """Texts and items of few words have many equal windows; tiles are still those of the plain search."""
    r = random.Random(alphabet)
    for least, n, m in ((5, 12, 30), (5, 23, 40), (2, 9, 25)):
        item, text = ([r.randrange(alphabet) for _ in range(k)] for k in (n, m))
        index = module.SeedIndex([(0, " ".join(f"v{x}" for x in item))], least)
        word = module.SeedIndex([(0, " ".join(f"v{x}" for x in text))], least).words[0]
        got = sum(c for _, _, c in module.overlaps_of(index, word))
        assert got == plain_tiles(item, text, least)


def test_memory_of_words_that_repeat():
    """60,000 times a word against 400 times: 24 million pairs of equal windows."""
    index = module.SeedIndex([(0, "same " * 400)], 5)
    word = np.repeat(index.words[0][:1], 60_000)
    tracemalloc.start()
    assert list(module.overlaps_of(index, word)) == [(0, 400, 400)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
