"""Mixing: quotas against one-by-one apportionment, targets against water-filling in fractions."""

from fractions import Fraction

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tidemark.llm.mixing as module
from tidemark.llm.mixing import PRIME, block_choice, chosen_words, global_rank, mix, mixed, sainte_lague, source_quotas

SCHEMA = "doc_id long, text string, source string, size int, key string, target double, shard int"


def one_by_one(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=12), st.integers(0, 90))
def test_highest_quotients(weights, seats):
    assert sainte_lague(np.array(weights), seats).tolist() == one_by_one(weights, seats)


def test_source_quotas_with_and_without_ties(spark):
    for weights, seats in (([53, 24, 23], 7), ([10, 10, 10, 10], 6), ([1] * 9, 4), ([1000, 1, 1], 11), ([5, 3], 0)):
        rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "rank long, target double")
        got = {r.rank: r.quota for r in source_quotas(rows, seats, float(sum(weights)), len(weights)).collect()}
        assert [got[i] for i in range(len(weights))] == one_by_one(weights, seats)


def targets(sizes):
    weight = {k: Fraction(1 + i % 3) for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k or "")))}
    total, fixed = sum(sizes.values()), set()
    while True:
        level = Fraction(total - sum(3 * sizes[k] for k in fixed), 1) / sum(weight[k] for k in sizes if k not in fixed)
        over = {k for k in sizes if k not in fixed and level * weight[k] > 3 * sizes[k]}
        if not over:
            return {k: Fraction(3 * sizes[k]) if k in fixed else level * weight[k] for k in sizes}
        fixed |= over


def test_mix(spark):
    r = np.random.default_rng(0)
    rows, sizes = [], {}
    for source, count in (("a", 300), ("b", 40), ("B", 3), (None, 50), ("é", 20), ("", 5)):
        for _ in range(count):
            n = int(r.integers(0, 400))
            rows.append((len(rows), " ".join(["w"] * n) or None, source, 1, "", 0.0, 0))
            sizes[source] = sizes.get(source, 0) + n
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in mix(frame).collect()}
    assert len(got) == len(rows)
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, text, source, *_ in rows:
        x = got[i]
        assert x.size == len((text or "").split()) and x.source_size == sizes[source]
        assert abs(x.target - float(want[source])) < 1e-6 * max(1, float(want[source]))
        assert 0 <= x.taken <= 3 * x.size
        taken[source] += x.taken
    for source, n in taken.items():
        assert abs(n - want[source]) <= 64
    again = {x.doc_id: x.taken for x in mix(frame.repartition(7)).collect()}
    assert again == {i: x.taken for i, x in got.items()}
    kept = mixed(frame)
    assert kept.columns == ["doc_id", "text", "source", "key", "shard", "size", "source_size", "target", "taken"]
    assert {x.doc_id: x.taken for x in kept.collect()} == {i: x.taken for i, x in got.items() if x.taken}


def test_odd_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b", None, 0, "", 0.0, 0), (None, "a b", None, 0, "", 0.0, 0), (1, None, "x", 0, "", 0.0, 0), (1, "", "x", 0, "", 0.0, 0), (2, "w " * 50000, "y", 0, "", 0.0, 0)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(x.size for x in got) == 50004
    silent = mix(spark.createDataFrame([(1, None, "x", 0, "", 0.0, 0)], SCHEMA)).collect()
    assert [(x.size, x.source_size, x.target, x.taken) for x in silent] == [(0, 0, 0.0, 0)]


def test_no_shard_has_a_whole_source(spark, monkeypatch):
    """Empty texts are in no shard; null ids, repeated ids and copies are spread over the shards, and copies over the tasks that number them."""
    monkeypatch.setattr(module, "SHARD_TOKENS", 1 << 8)
    monkeypatch.setattr(module, "EQUAL_ROWS", 64)
    parts = [spark.range(4000).selectExpr("id as doc_id", "'' as text"), spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('w', id) as text"), spark.range(4000).selectExpr("7 as doc_id", "'w' as text")]
    frame = parts[0].union(parts[1]).union(parts[2]).withColumn("source", F.lit("s"))
    seen = {}

    def quotas(shards, real=module.shard_quotas):
        seen["shards"] = [r.shard_size for r in shards.collect()]
        return real(shards)

    monkeypatch.setattr(module, "shard_quotas", quotas)
    got = mix(frame).collect()
    assert len(got) == 12000 and sum(r.taken for r in got) == 8000 and {r.taken for r in got if not r.size} == {0}
    assert len(seen["shards"]) > 25 and max(seen["shards"]) < 450
    sized = frame.selectExpr("source as key", "doc_id as id", "size(split(text, ' ')) * int(text <> '') as size", "xxhash64(text) as tag")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = module.numbered(sized.where("id = 7")).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == 4000 and max(r["count"] for r in tasks) < 3000
    assert sorted(r.copy for r in module.numbered(sized.where("id = 7")).collect()) == list(range(4000))
    again = sorted((r.taken, r.size, str(r.doc_id)) for r in mix(frame.repartition(9)).collect())
    assert again == sorted((r.taken, r.size, str(r.doc_id)) for r in got)


def test_clashing_columns(spark):
    rows = [(i, "w " * 50, "ab"[i % 2], 1, 2, 3, 4) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, mixed int, mix int, `_mix` int, taken int")
    kept = mixed(frame)
    assert kept.columns == ["doc_id", "text", "source", "mixed", "mix", "_mix", "size", "source_size", "target", "taken"]
    assert all((r.mixed, r.mix, r._mix) == (1, 2, 3) and r.taken <= 150 for r in kept.collect())


def test_groups_of_shards_and_seeded_blocks(spark, monkeypatch):
    """Many small shards in groups: sources still meet their targets, and blocks are not the first of an order."""
    monkeypatch.setattr(module, "SHARD_TOKENS", 640)
    monkeypatch.setattr(module, "GROUP_SHARDS", 4)
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 60))), "abc"[i % 3 if i % 3 else i % 2], 1, "", 0.0, 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mix(frame).collect()
    sizes = {}
    for x, (_, text, source, *_) in zip(sorted(got), rows, strict=True):
        sizes[source] = sizes.get(source, 0) + len(text.split())
        assert 0 <= x.taken <= 3 * x.size
    want = targets(sizes)
    for source, target in want.items():
        taken = sum(x.taken for x in got if rows[x.doc_id][2] == source)
        assert abs(taken - target) <= 64
    other = {x.doc_id: x.taken for x in mix(frame, seed=99).collect()}
    assert other != {x.doc_id: x.taken for x in got}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 300), min_size=1, max_size=30), st.integers(0, 40), st.integers(0, 1000))
def test_chosen_words_against_marking_each_word(spark, sizes, blocks, seed):
    shard = spark.createDataFrame([("k", 0, sum(sizes), blocks)], "key string, shard long, shard_size long, blocks long")
    choice = block_choice(shard, 16, seed)
    c = choice.first()
    total, starts = sum(sizes), np.cumsum([0, *sizes])
    place = [(n * c.a + c.c) % PRIME for n in range(-(-total // 16))]
    marked = [place[w // 16] < c["limit"] or place[w // 16] == c["limit"] and w % 16 < c.cut for w in range(total)]
    rows = spark.createDataFrame([(i, int(b), n) for i, (b, n) in enumerate(zip(starts, sizes, strict=False))], "i long, before long, size long").crossJoin(choice)
    got = {x.i: x.n for x in rows.select("i", chosen_words(F.col("before"), F.col("size"), 16).alias("n")).collect()}
    assert got == {i: sum(marked[a : a + n]) for i, (a, n) in enumerate(zip(starts, sizes, strict=False))}
    assert c.passes * total + sum(marked) == min(16 * blocks, 3 * total)


def test_global_rank(spark):
    rows = spark.range(500).selectExpr("cast(id as string) as name").repartition(6)
    got = {x["name"]: x["rank"] for x in global_rank(rows, "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(map(str, range(500))))}
