"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .graph import free_name

BLOCK_TOKENS = 64
#: Equal rows that a task numbers; more go to several tasks.
EQUAL_ROWS = 4096
#: Tokens of a shard, and the shards of a group; a source's blocks go to its groups first, then to their shards.
SHARD_TOKENS, GROUP_SHARDS = 1 << 17, 4096
#: A prime: block numbers are put in a seeded order by a * number + c modulo it.
PRIME = (1 << 31) - 1
WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3


def global_rank(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) in the order of the columns; no task sorts all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = settle(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row for each partition, so this window is small.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return ranged.join(before, "_part").withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_id", "_part", "_at", "_before")


def water_level(sources: DataFrame, total: int) -> float:
    """The level at which targets of min(REPEATS * size, level * weight) share out ``total``; each pass stops the sources that are above."""
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > REPEATS * F.col("source_size")
        fixed, open_ = sources.agg(F.sum(F.when(over, REPEATS * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not open_:
            return level
        new = (total - fixed) / open_
        if new <= level:
            return level
        level = new


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); of equal quotients the earlier wins."""
    weights = np.asarray(weights, float)
    won = np.zeros(len(weights), np.int64)
    if seats <= 0 or weights.sum() <= 0:
        return won
    won = np.floor(weights * (seats / weights.sum()) + 0.5).astype(np.int64)
    missing = int(seats - won.sum())
    if missing > 0:
        heap = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, won, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heap[0]
            won[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * won[i] + 1), i))
    elif missing < 0:
        heap = [(w / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, won, strict=True)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heap[0]
            won[-i] -= 1
            heapq.heapreplace(heap, (weights[-i] / (2 * won[-i] - 1) if won[-i] else np.inf, i))
    return won


def source_quotas(sources: DataFrame, seats: int, total: float, count: int) -> DataFrame:
    """Adds ``quota``: ``seats`` blocks by highest quotients of ``target``.

    The quotas are round(target / divisor) for a divisor that makes them add up; each
    job tries 15 divisors at once, so sources never come to the driver. If equal
    quotients leave no such divisor, the first ones in rank order win.
    """
    if seats <= 0 or total <= 0:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    quota = lambda d: F.floor(F.col("target") / F.lit(float(d)) + 0.5)
    low = total / (seats + count)
    high = total / (seats - count) if seats > count else 2.0 * float(sources.agg(F.max("target")).first()[0]) + 1
    while True:
        tries = [x for x in np.linspace(low, high, 17)[1:-1] if low < x < high]
        if not tries:
            break
        sums = sources.agg(*[F.sum(quota(d)).alias(f"s{i}") for i, d in enumerate(tries)]).first()
        if seats in sums:
            return sources.withColumn("quota", quota(tries[list(sums).index(seats)]))
        k = sum(s > seats for s in sums)
        low, high = ([low, *tries][k], [*tries, high][k])
    short = seats - (sources.agg(F.sum(quota(high))).first()[0] or 0)
    winners = sources.where(quota(low) > quota(high)).orderBy("rank").limit(int(short)).select("rank", F.lit(1).alias("extra"))
    return sources.join(winners, "rank", "left").withColumn("quota", quota(high) + F.coalesce("extra", F.lit(0))).drop("extra")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """(key, shard, shard_size, blocks): a source's ``quota`` blocks over its groups of shards, then over each group's shards, by highest quotients of their sizes. A task holds a row for each group of a source, or for each shard of a group."""

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        return group.assign(blocks=sainte_lague(group["size"].to_numpy(), int(group["quota"].iloc[0])))[["key", "part", "size", "blocks"]]

    schema = "key string, part long, size long, blocks long"
    shards = shards.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = shards.groupBy("key", F.col("group").alias("part")).agg(F.sum("shard_size").alias("size"), F.first("quota").alias("quota"))
    groups = groups.groupBy("key").applyInPandas(deal, schema).select("key", F.col("part").alias("group"), F.col("blocks").alias("quota"))
    own = shards.drop("quota").join(groups, ["key", "group"]).select("key", "group", F.col("shard").alias("part"), F.col("shard_size").alias("size"), "quota")
    return own.groupBy("key", "group").applyInPandas(deal, schema).select("key", F.col("part").alias("shard"), F.col("size").alias("shard_size"), "blocks")


def block_choice(shards: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds what each shard's blocks are chosen by: ``passes`` over all of it, and of the rest the blocks whose number times a plus c modulo PRIME is under ``limit``, with ``cut`` words of the one at it."""
    wanted = F.least(F.col("blocks") * block, REPEATS * F.col("shard_size"))
    length = F.greatest(F.col("shard_size"), F.lit(1))
    rows = shards.withColumn("passes", F.floor(wanted / length)).withColumn("rest", wanted - F.col("passes") * length)
    rows = rows.withColumn("a", F.pmod(F.xxhash64("key", "shard", F.lit(seed + 2)), F.lit(PRIME - 1)) + 1).withColumn("c", F.pmod(F.xxhash64("key", "shard", F.lit(seed + 3)), F.lit(PRIME)))
    rows = rows.select("key", "shard", "shard_size", "passes", "rest", "a", "c")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits, cuts = [], []
            for r in batch.select(["shard_size", "rest", "a", "c"]).to_pylist():
                number = np.arange(-(-r["shard_size"] // block))
                place = (number * r["a"] + r["c"]) % PRIME
                order = np.argsort(place)
                words = np.minimum(block, r["shard_size"] - number * block)[order].cumsum()
                k = int(np.searchsorted(words, r["rest"])) if r["rest"] else 0
                limits.append(int(place[order[k]]) if r["rest"] else -1)
                cuts.append(r["rest"] - int(words[k - 1] if k else 0))
            names = ["key", "shard", "shard_size", "passes", "a", "c"]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(limits, pa.int64()), pa.array(cuts, pa.int64())], [*names, "limit", "cut"])

    return rows.mapInArrow(choose, "key string, shard long, shard_size long, passes long, a long, c long, limit long, cut long")


def chosen_words(before: Column, size: Column, block: int) -> Column:
    """How many of a row's words, which stand after ``before`` others in its shard, lie in the blocks chosen by limit and cut."""
    end = before + size

    def words(number: Column) -> Column:
        place = F.pmod(number * F.col("a") + F.col("c"), F.lit(PRIME))
        stop = number * block + F.when(place < F.col("limit"), block).when(place == F.col("limit"), F.col("cut")).otherwise(0)
        return F.greatest(F.lit(0), F.least(end, stop) - F.greatest(before, number * block))

    numbers = F.sequence(F.floor(before / block), F.floor((end - 1) / block))
    return F.when((size == 0) | (F.col("limit") < 0), F.lit(0).cast("long")).otherwise(F.aggregate(numbers, F.lit(0).cast("long"), lambda total, n: total + words(n)))


def numbered(sized: DataFrame) -> DataFrame:
    """The rows that have words, equal ones (key, id, tag, size) numbered by ``copy`` (0, 1, ...). Equal rows are counted first, so no task meets them all."""
    groups = sized.where("size > 0").groupBy("key", "id", "tag", "size").agg(F.count("*").alias("n"))
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS))))
    # The rows of a part are made where the part is dealt to.
    first = F.col("part") * EQUAL_ROWS
    copy = F.explode(F.sequence(first, F.least(F.col("n"), first + EQUAL_ROWS) - 1)).alias("copy")
    return groups.repartition("key", "id", "tag", "part").select("key", "id", "tag", "size", copy)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target and taken.

    size is the text's number of words (null text: 0). Sources in code point order, null
    last, weigh 1, 2, 3, repeating, and share all sizes; a target stops at three times
    its source's size and the rest is shared anew. Blocks of ``block`` words go to the
    sources by highest quotients, each source's to its shards likewise. A shard's rows
    stand in an order given by a hash of the id and the seed and are cut into blocks; the
    blocks taken are chosen by the seed, all of them over and over where the quota is
    larger than the shard, at most three times. taken counts a row's words in them.
    Reruns agree. Texts are counted whole, however long. Rows are dealt to shards by a
    hash of id, text and number among equal rows, so neither null nor repeated ids, nor
    copies, come together; rows without words take part in no shard. Repeated rows each
    count; equal ones may swap. Null ids are kept. No rows give no rows. Other columns
    are ignored.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("a"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tag"),
    )
    sized = settle(sized)
    sources = global_rank(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "key")
    parts = F.array(*[F.lit(w) for w in weights])
    sources = settle(sources.withColumn("weight", parts[(F.col("rank") % len(weights)).cast("int")].cast("double")))
    total, count = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    level = water_level(sources, total) if total else 0.0
    sources = sources.withColumn("target", F.least(REPEATS * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")))
    sources = settle(source_quotas(settle(sources), round(total / block), float(total), count))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_TOKENS))
    named = sources.select("key", "source_size", "target", "quota")
    identity = ("id", "tag", "copy")
    dealt = numbered(sized).join(named, "key")
    dealt = settle(dealt.withColumn("turn", F.xxhash64(*identity, F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64(*identity, F.lit(seed + 1)), n_shards).cast("long")))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    placed = dealt.drop("quota").join(block_choice(shard_quotas(shards), block, seed), ["key", "shard"])
    order = Window.partitionBy("key", "shard").orderBy("turn", *identity, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    taken = F.col("passes") * F.col("size") + chosen_words(F.col("before"), F.col("size"), block)
    silent = sized.where("size = 0").join(named, "key").withColumn("taken", F.lit(0).cast("long"))
    out = ("size", "source_size", "target", "taken")
    return placed.withColumn("taken", taken.cast("long")).select(F.col("id").alias(id_col), *out).unionByName(silent.select(F.col("id").alias(id_col), *out))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with size, source_size, target and taken, in place of columns of those names. Rows with equal ids have the same numbers, those of the one with the most taken; columns of any other names stay."""
    found = mix(docs, id_col, text_col, source_col, **options)
    key, numbers = free_name(docs, "mixed"), free_name(docs, "mix")
    found = found.where("taken > 0").groupBy(F.col(id_col).alias(key)).agg(F.max(F.struct("taken", "size", "source_size", "target")).alias(numbers))
    rows = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(key)))
    names = [f"`{c}`" for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return rows.select(*names, *[f"{numbers}.{c}" for c in ("size", "source_size", "target", "taken")])
