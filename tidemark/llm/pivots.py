"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), nearest first. The
inverted lists hold, for every ``shared`` pivots of a vector's first ``prefix``, the
vectors that have them: two vectors meet in a list exactly when they share that many.
More pivots keep the lists short as the table grows, but make it rarer that near vectors
share some, so there are several independent sets of pivots, and more of them with more
pivots; the lists of all sets are united. A lone pair at cosine 0.90 is found with a
chance of about 0.99 for any number of vectors (64 dimensions, simulated to 100 million).
Members of a list are compared by cosine in double precision; linked ones make
components, and inside a component (all links lie in one) every pair is compared, so
the numbers of links are exact for each component that the index has joined up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .graph import by_group, connected_components, hub_groups, in_blocks, with_group
from .minhash import forest

PREFIX, SHARED = 8, 3
#: A set's pivots come from this many rows at most; their number follows the cube root of the number of vectors within these bounds.
SAMPLE, FEWEST, MOST = 4096, 128, 4096
BLOCK_ROWS = 128


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, vector, dim): the vectors as bytes of doubles or, where the column holds floats, of floats; null where a vector is null, zero, or has a null or non-finite component."""
    kind = number_type(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().cast(pa.float64(), safe=False)
            value = flat.to_numpy(zero_copy_only=False)
            value = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, value)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            found: list[bytes | None] = []
            at = 0
            for n in size:
                v = value[at : at + n]
                at += n
                found.append((v + 0.0).astype(kind).tobytes() if n and 0 < np.abs(v).max() < np.inf else None)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), pa.array(size, pa.int32())], ["node", "vector", "dim"])

    source = vectors.select(F.col(id_col).cast("long").alias("node"), F.col(vector_col).alias("vector"))
    return source.mapInArrow(run, "node long, vector binary, dim int")


def number_type(vectors: DataFrame, vector_col: str) -> str:
    return "f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "f8"


def unit_rows(vectors: list[bytes], kind: str, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as doubles, padded with zeros or cut to one width; their own lengths)."""
    own = [np.frombuffer(v, kind).astype(float) for v in vectors]
    size = np.array([len(v) for v in own])
    x = np.zeros((len(own), width or size.max()))
    for i, v in enumerate(own):
        v = v / np.abs(v).max()
        v = v[: x.shape[1]] / np.sqrt(v @ v)
        x[i, : len(v)] = v
    return x, size


def pivot_counts(n: int, prefix: int = PREFIX, shared: int = SHARED) -> tuple[int, int]:
    """(pivots of a set, sets) for ``n`` vectors."""
    keys_each = len(list(combinations(range(prefix), shared)))
    count = int(np.clip(np.ceil((48 * n * keys_each) ** (1 / 3)), FEWEST, MOST))
    return count, int(np.ceil(np.log2(count) / 5))


def choose_pivots(classes: DataFrame, count: int, sets: int, kind: str) -> list[np.ndarray]:
    """Sets of ``count`` pivots, each from rows of its own, of a bounded sample in the order of a hash of the id."""
    rows = classes.orderBy(F.xxhash64("node"), "tag_a", "tag_b").limit(SAMPLE * sets).select("vector").collect()
    width = max(len(r.vector) for r in rows) // np.dtype(kind).itemsize
    return [far_apart(unit_rows([r.vector for r in rows[s::sets]], kind, width)[0], count) for s in range(min(sets, len(rows)))]


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit vectors of ``sample`` far from each other (greedy k-centre)."""
    nearest = np.full(len(sample), -2.0)
    chosen = [0]
    while True:
        np.maximum(nearest, sample @ sample[chosen[-1]], out=nearest)
        if len(chosen) >= count or nearest.min() > 1 - 1e-9:
            return sample[chosen]
        chosen.append(int(nearest.argmin()))


def list_keys(x: np.ndarray, size: np.ndarray, pivots: list[np.ndarray], prefix: int = PREFIX, shared: int = SHARED) -> np.ndarray:
    """The lists of each unit vector: in each set, one for every ``shared`` of the ``prefix`` pivots that are nearest to it."""
    keys, first = [], 0
    for own in pivots:
        long, few = min(prefix, len(own)), min(shared, prefix, len(own))
        picks = np.array(list(combinations(range(long), few)))
        order = np.argpartition(-(x @ own.T), long - 1, axis=1)[:, :long] + first
        order.sort(axis=1)
        key = size.astype(np.int64)[:, None].repeat(len(picks), 1) & 0x7FFF
        for c in range(few):
            key = (key << 16) | order[:, picks[:, c]]
        keys.append(key)
        first += len(own)
    return np.concatenate(keys, axis=1)


def pivot_keys(classes: DataFrame, pivots: list[np.ndarray], prefix: int, shared: int, kind: str) -> DataFrame:
    """(node, key): a row for each of the vector's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                key = list_keys(*unit_rows(part.column(1).to_pylist(), kind, pivots[0].shape[1]), pivots, prefix, shared)
                yield pa.record_batch([pa.array(part.column(0).to_numpy().repeat(key.shape[1])), pa.array(key.ravel())], ["node", "key"])

    return classes.select("node", "vector").mapInArrow(run, "node long, key long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id and kept.

    Vectors are linked when their cosine is at least ``least``; n_links counts the other
    rows linked directly, component_id is the smallest id reachable. Vectors that are
    null, empty, zero or hold a null or non-finite component have no link, and neither
    do vectors of different lengths. Repeated ids are one node of the graph, though each
    row counts as a vector. A null id has no link, a null component and kept = false.
    Other columns are ignored.
    """
    named = units(vectors, id_col, vector_col).withColumn("tag_a", F.xxhash64("vector")).withColumn("tag_b", F.xxhash64("vector", F.lit(1)))
    rows = settle(named)
    usable = rows.where("vector is not null and node is not null")
    kind = number_type(vectors, vector_col)
    classes = settle(usable.groupBy("tag_a", "tag_b").agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    n = classes.count()
    links = None
    if n > 1:
        pivots = choose_pivots(classes, *pivot_counts(n, prefix, shared), kind)
        links = connected_components(linked_pairs(classes, pivots, least, prefix, shared, kind))
    known = degrees(classes, links, least, kind) if links is not None else classes.select("tag_a", "tag_b", "node", "copies", F.col("node").alias("root"), (F.col("copies") - 1).alias("n_links"))
    found = rows.select("node", *[F.when(F.col("node").isNotNull() & F.col("vector").isNotNull(), F.col(t)).alias(t) for t in ("tag_a", "tag_b")])
    found = found.join(known.where("n_links > 0").select("tag_a", "tag_b", "root", "n_links"), ["tag_a", "tag_b"], "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("root", "node"))
    return found.select(F.col("node").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"))


def linked_pairs(classes: DataFrame, pivots: list[np.ndarray], least: float, prefix: int, shared: int, kind: str) -> DataFrame:
    """(a, b): a forest of the linked pairs that share enough pivots."""
    under = hub_groups(pivot_keys(classes, pivots, prefix, shared, kind))
    members = with_group(under, "hub", n=F.count("*")).join(classes.select("node", "vector"), "node")
    members = in_blocks(members, "hub", "node", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")

    def work(group: pa.Table) -> pa.RecordBatch | None:
        return forest(group["node"].to_numpy(), linked(group, least, kind))

    return by_group(members, ["hub", "low", "high"], work, "a long, b long")


def linked(group: pa.Table, least: float, kind: str) -> np.ndarray:
    """Which rows are linked; in a pair of different blocks, only rows of one with rows of the other."""
    x, size = unit_rows(group["vector"].to_pylist(), kind)
    near = (x @ x.T >= least) & (size[:, None] == size[None, :])
    if group["low"][0].as_py() != group["high"][0].as_py():
        block = group["block"].to_numpy()
        near &= block[:, None] != block[None, :]
    return near


def degrees(classes: DataFrame, links: DataFrame, least: float, kind: str) -> DataFrame:
    """Each class with its root and number of links."""
    members = settle(classes.join(links.select("node", F.col("component").alias("root")), "node"))
    rows = in_blocks(with_group(members, "root", n=F.count("*")), "root", "tag_a", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")

    def work(group: pa.Table) -> pa.RecordBatch | None:
        near = linked(group, least, kind)
        np.fill_diagonal(near, False)
        others = near @ group["copies"].to_numpy()
        return pa.record_batch([group["tag_a"].combine_chunks(), group["tag_b"].combine_chunks(), pa.array(others)], ["tag_a", "tag_b", "others"])

    others = by_group(rows, ["root", "low", "high"], work, "tag_a long, tag_b long, others long").groupBy("tag_a", "tag_b").agg(F.sum("others").alias("others"))
    known = classes.drop("vector").join(links.select("node", F.col("component").alias("root")), "node", "left").join(others, ["tag_a", "tag_b"], "left")
    return known.select("tag_a", "tag_b", "node", "copies", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
