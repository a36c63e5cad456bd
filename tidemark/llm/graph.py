"""Connected components and bounded work groups as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, settle


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores in front while a column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round gives every node a random priority, joins it to the first of itself and
    its neighbours, and that one to its first, and contracts the graph to those; so a
    share of the nodes goes in each round whatever the graph's shape, and a star needs
    two. Nothing but whether edges are left comes to the driver.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.table(edges.select("a", "b").where("a <> b").distinct())
        steps: list[DataFrame] = []
        while not edges.isEmpty():
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
            seed = F.lit(len(steps))
            turn = lambda c, seed=seed: F.struct(F.xxhash64(c, seed).alias("turn"), F.col(c).alias("to"))
            first = scratch.table(both.groupBy("node").agg(F.min(turn("other")).alias("other")).select("node", F.least(turn("node"), F.col("other"))["to"].alias("root")))
            jump = first.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = scratch.table(first.join(jump, "root").select("node", F.col("further").alias("root")))
            steps.append(step)
            left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            edges = scratch.table(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if not steps:
            return settle(edges.select(F.col("a").alias("node"), F.col("b").alias("component")))
        # Compose the steps from the last to the first.
        roots = steps[-1]
        for step in reversed(steps[:-1]):
            later = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = scratch.table(step.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        least = scratch.table(roots.groupBy("root").agg(F.min("node").alias("component")))
        return settle(roots.join(least, "root").select("node", "component"))


def hub_groups(keys: DataFrame) -> DataFrame:
    """(hub, node): for each bucket of ``keys`` (node, key) with several rows, its smallest node with each of its nodes, once.

    Any two nodes with a common key have a common hub; nodes with many common keys meet
    under few hubs, so their pairs are not listed for each key.
    """
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return settle(keys.join(hubs, "key").select("hub", "node").distinct())


def with_group(rows: DataFrame, group: str, **totals: Column) -> DataFrame:
    """Adds aggregates of the row's group. They are written first, so both sides of the join are plain shuffles and a hot group's can be split."""
    known = settle(rows.groupBy(group).agg(*[c.alias(name) for name, c in totals.items()]))
    return rows.join(known, group)


def in_blocks(rows: DataFrame, group: str, member: str, blocks: Column) -> DataFrame:
    """Deal the rows of each group out to pairs of blocks, so no task needs a whole group.

    ``blocks`` is the number of blocks of the row's group. A row of block i goes to the
    pairs (i, j) and (j, i), with i <= j, so two rows of a group meet in exactly one pair
    when their blocks differ, and in (i, i) when they are the same. Adds block, low and high.
    """
    own = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks.cast("int")).withColumn("block", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_blocks", "_other")


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Apply ``work`` to the rows of each key, streaming over sorted partitions.

    Like applyInArrow, without its cost for each group; groups must be bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            seen = list(zip(*columns, strict=True))
            start = 0
            for i, key in enumerate(seen):
                if key == now:
                    continue
                if now is not None:
                    kept.append(batch.slice(start, i - start))
                    if (out := work(pa.Table.from_batches(kept))) is not None:
                        yield out
                kept, now, start = [], key, i
            kept.append(batch.slice(start))
        if kept and (out := work(pa.Table.from_batches(kept))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)
