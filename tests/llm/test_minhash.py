"""Near-duplicates against sets compared pair by pair."""

import random
import re

import pytest
from pyspark.sql import types as T

from tidemark.llm.graph import connected_components
from tidemark.llm.minhash import near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, node long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, groups, copies, near, words):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, words))]
        texts = [" ".join(base)] * r.randint(1, copies)
        for _ in range(r.randint(0, near)):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            texts.append(" \t".join(edited).upper() if r.random() < 0.2 else " ".join(edited))
        for t in texts:
            rows.append((n * 3 + 1, t, n, "x"))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = corpus(seed, 40, 4, 6, 120)
    rows += [(9001, None, 0, ""), (9002, "", 0, ""), (9003, " \t\n", 0, ""), (9004, "one two", 0, ""), (9005, "One  two", 0, ""), (9006, "one two three", 0, ""), (9007, "word " * 30000, 0, ""), (9008, "word " * 29000, 0, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_one_large_group_of_near_copies_in_blocks(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(420):
        edited = list(base)
        for _ in range(r.randint(0, 4)):
            edited[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(edited), 0, ""))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text, 0, ""), (4, text, 0, ""), (4, text, 0, ""), (7, text, 0, ""), (None, None, 0, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 6, None, False), (None, 0, None, False), (4, 6, 4, True), (4, 6, 4, True), (7, 6, 4, False)], key=str)
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "component"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, None, None]
    several = [(9, f"{text} {k}", k, "x") for k in range(6)]
    once = [one_of_each(spark.createDataFrame(several[k:] + several[:k], SCHEMA).repartition(k + 1)).collect() for k in range(3)]
    assert once[0] == once[1] == once[2] and len(once[0]) == 1 and tuple(once[0][0]) in several
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    r.shuffle(edges)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    none = connected_components(spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
    assert none.count() == 0
