"""Quota selection, MMR and chunk folds against plain Python on random input."""

import random

from pyspark.sql import functions as F

from tidemark.functions.pytext import estimate_tokens
from tidemark.operators.chunking import heading_sections, merge_small, semantic_windows, sliding_windows, split_long
from tidemark.operators.rerank import mmr_order, quota_pick


def quota(rows, k, per_source, per_doc):
    chosen, passed = [], []
    for i, (s, d) in enumerate(rows):
        fits = len(chosen) < k and sum(rows[j][0] == s for j in chosen) < per_source and sum(rows[j][1] == d for j in chosen) < per_doc
        (chosen if fits else passed).append(i)
    return (chosen + passed)[:k]


def test_quota(spark):
    r = random.Random(1)
    groups = [[(r.choice("abc"), r.choice("uvwxyz")) for _ in range(r.randint(0, 20))] for _ in range(60)]
    frame = spark.createDataFrame([(g, [{"source": s, "doc": d} for s, d in rows]) for g, rows in enumerate(groups)], "g int, items array<struct<source: string, doc: string>>")
    got = {x.g: x.p for x in frame.select("g", quota_pick(F.col("items"), 8, 5, 3).alias("p")).collect()}
    assert got == {g: quota(rows, 8, 5, 3) for g, rows in enumerate(groups)}


def mmr(items, k, weight):
    chosen = [0] if items else []
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while items and len(chosen) < min(k, len(items)):
        left = [i for i in range(len(items)) if i not in chosen]
        value = {i: round(weight * items[i][0] - (1 - weight) * max(alike(set(items[i][1]), set(items[j][1])) for j in chosen), 12) for i in left}
        chosen.append(max(left, key=lambda i: (value[i], -i)))
    return chosen


def test_mmr(spark):
    r = random.Random(2)
    groups = [sorted(((round(r.random(), 3), [r.choice("abcdefgh") for _ in range(r.randint(0, 6))]) for _ in range(r.randint(0, 8))), key=lambda x: -x[0]) for _ in range(25)]
    frame = spark.createDataFrame([(g, [{"final_score": s, "display_tokens": t} for s, t in rows]) for g, rows in enumerate(groups)], "g int, items array<struct<final_score: double, display_tokens: array<string>>>")
    got = {x.g: x.p for x in frame.select("g", mmr_order(F.col("items"), 8, 0.7).alias("p")).collect()}
    assert got == {g: mmr(rows, 8, 0.7) for g, rows in enumerate(groups)}


def test_heading_sections():
    body = "intro\n# Page\nlead\n## A\ntext a\n### B\n```\n# no heading\n```\n## C\n\n## D ##\nlast"
    got = [(s["level"], s["title"], s["path"], "\n".join(s["lines"]).strip()) for s in heading_sections(body)]
    assert got == [(1, "", [], "intro"), (1, "", [], "lead"), (2, "A", ["A"], "text a"), (3, "B", ["A", "B"], "```\n# no heading\n```"), (2, "D", ["D"], "last")]


def test_merging_and_splitting():
    section = lambda title, words: {"level": 2, "title": title, "path": [title], "lines": ["w " * words]}
    kept = merge_small([section("a", 150), section("b", 10), section("c", 700), section("d", 5)], 120, 800)
    assert [s["title"] for s in kept] == ["a", "c"] and "## b" in kept[0]["lines"] and "## d" in kept[1]["lines"]
    paragraphs = ["Word number one. " * 40, "```\n" + "code line\n\n" * 50 + "```", "Last one here. " * 30]
    pieces = split_long("\n\n".join(paragraphs), 200, 1)
    assert len(pieces) == 3 and pieces[1].startswith("Word number one.") and pieces[1].endswith("```")


def test_windows():
    parts = [f"S{i} " + "word " * 40 for i in range(40)]
    windows = sliding_windows(parts, 700, 0.15)
    assert all(sum(map(estimate_tokens, w)) <= 700 for w in windows)
    assert windows[1][0] == windows[0][-1] and windows[0][0] == parts[0] and windows[-1][-1] == parts[-1]
    cut = semantic_windows(["a b c", "a b c", "x y z", "x y z"] * 3, 10, 25, lambda s: set(s.split()))
    assert [s for w in cut for s in w] == ["a b c", "a b c", "x y z", "x y z"] * 3 and len(cut) > 1


def test_mmr_reads_whole_texts(spark):
    """Three texts with the same first words: a copy of the best goes behind one that ends otherwise."""
    start = ["kiwi", *(f"alpha{i}" for i in range(220))]
    texts = [start, start, [*start, *(f"gamma{i}" for i in range(700))]]
    frame = spark.createDataFrame([(0, [{"final_score": 1.0 - i / 100, "display_tokens": t} for i, t in enumerate(texts)])], "g int, items array<struct<final_score: double, display_tokens: array<string>>>")
    assert frame.select(mmr_order(F.col("items"), 8, 0.7).alias("p")).first().p == [0, 2, 1]
