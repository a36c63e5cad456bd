"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature has ``symbols`` b-bit MinHash values of its word shingles. Two
signatures differ in d symbols; for texts of similarity s the mean of d is
symbols * (1 - s). With the signature split into ``chunks``, two signatures within
``2 * chunks - 1`` differing symbols have a chunk with at most one (pigeonhole), so
every chunk is indexed once for each symbol that may be wrong, with that symbol left
out: such a pair meets in one of symbols keys, for certain. At the default (28 symbols
of 16 bits, 7 chunks, distance 13) a pair at similarity 0.85 has a larger distance
with a chance of 1e-5. At 0.80 that chance is 4e-4; the pipeline, which links from there,
takes 40 symbols in 10 chunks (distance 19), where it is 2e-5.

Texts with equal sets are one node from the start. Bucket members are compared by
signature, those within the distance are joined to candidate groups, and these are
confirmed on full sets, every pair of a group, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle, stored
from .arrays import Shingler, components_of, mix, odd_numbers, set_print, text_slices
from .graph import by_group, connected_components, free_name, hub_groups, in_blocks, with_group

SYMBOLS, CHUNKS = 28, 7
#: Rows of a group that meet another block's rows in one task; a task holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 128, 16 << 20


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """(node, n_shingles, print_a, print_b, signature) of each row; empty sets have no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, by = Shingler(words), odd_numbers(symbols, 47)[:, None]
        for batch in batches:
            for row, end, data, ends in text_slices(batch.column(1)):
                n, a, b, signs = [], [], [], []
                for hashes in shingler.sets(data, ends):
                    n.append(len(hashes))
                    if not len(hashes):
                        a.append(None), b.append(None), signs.append(None)
                        continue
                    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(hashes), 4096):
                        np.minimum(low, (hashes[None, at : at + 4096] * by).min(axis=1), out=low)
                    signs.append((mix(low) >> np.uint64(48)).astype(np.int32))
                    x, y = set_print(hashes)
                    a.append(x), b.append(y)
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signs, pa.list_(pa.int32()))], ["node", "n_shingles", "print_a", "print_b", "signature"])

    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "node long, n_shingles long, print_a long, print_b long, signature array<int>")


def chunk_keys(signature: Column, symbols: int = SYMBOLS, chunks: int = CHUNKS) -> Column:
    """One key for each chunk and each of its symbols left out."""
    size, keys = symbols // chunks, []
    for c in range(chunks):
        for out in range(size):
            key = F.lit(c * size + out).cast("long")
            for i in range(size):
                if i != out:
                    key = F.shiftleft(key, 16).bitwiseOR(signature[c * size + i].cast("long"))
            keys.append(key)
    return F.array(*keys)


def candidate_edges(nodes: DataFrame, symbols: int = SYMBOLS, chunks: int = CHUNKS) -> DataFrame:
    """(a, b): a forest of the pairs of (node, signature) within the distance that pigeonhole covers.

    The members of a bucket go under its smallest node, its hub. Nodes with a common hub
    are compared in blocks; only edges that join something new leave a task.
    """
    most = 2 * chunks - 1
    keys = nodes.select("node", F.explode(chunk_keys(F.col("signature"), symbols, chunks)).alias("key"))
    under = hub_groups(keys)
    rows = with_group(under, "hub", n=F.count("*")).join(nodes.select("node", "signature"), "node")
    rows = in_blocks(rows, "hub", "node", F.ceil(F.col("n") / (2 * BLOCK_ROWS))).drop("n")

    def work(group: pa.Table) -> pa.RecordBatch | None:
        node = group["node"].to_numpy()
        sign = group["signature"].combine_chunks().flatten().to_numpy().reshape(len(node), symbols)
        differ = np.zeros((len(node), len(node)), np.uint8)
        for i in range(symbols):
            differ += sign[:, i, None] != sign[None, :, i]
        near = differ <= most
        if group["low"][0].as_py() != group["high"][0].as_py():
            block = group["block"].to_numpy()
            near &= block[:, None] != block[None, :]
        return forest(node, near)

    return by_group(rows, ["hub", "low", "high"], work, "a long, b long")


def forest(node: np.ndarray, adjacent: np.ndarray) -> pa.RecordBatch | None:
    """Each node with the first of its component, without those alone."""
    first = components_of(adjacent)
    joined = np.flatnonzero(first != np.arange(len(node)))
    if not len(joined):
        return None
    return pa.record_batch([pa.array(node[first[joined]]), pa.array(node[joined])], ["a", "b"])


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of membership matrices of ``width`` hashes."""
    sizes = np.array([len(s) for s in sets])
    value, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    new = np.r_[True, value[1:] != value[:-1]]
    index = np.cumsum(new) - 1
    shared = (np.bincount(index) > 1)[index]
    of, index = of[shared], index[shared]
    both = np.zeros((len(sets), len(sets)))
    if not len(of):
        return both
    index = np.cumsum(np.r_[True, index[1:] != index[:-1]]) - 1
    for at in range(0, index[-1] + 1, width):
        a, b = np.searchsorted(index, [at, at + width])
        member = np.zeros((len(sets), min(width, index[-1] + 1 - at)), np.float32)
        member[of[a:b], index[a:b] - at] = 1
        both += member @ member.T
    return both


def confirmed_edges(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, similar: int) -> DataFrame:
    """(a, b): a forest of the pairs in each candidate group (node, component, n_shingles) with Jaccard >= similar / 100 on full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for row, end, data, ends in text_slices(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(row, end - row)
                found = [h.tobytes() for h in shingler.sets(data, ends)]
                yield pa.record_batch([part.column("node"), part.column("component"), part.column("blocks"), pa.array(found, pa.binary())], ["node", "component", "blocks", "hashes"])

    def work(group: pa.Table) -> pa.RecordBatch | None:
        node = group["node"].to_numpy()
        own = [np.frombuffer(h, np.uint64) for h in group["hashes"].to_pylist()]
        size = np.array([len(h) for h in own], float)
        both = overlaps(own)
        linked = 100 * both >= similar * (size[:, None] + size[None, :] - both)
        if group["low"][0].as_py() != group["high"][0].as_py():
            block = group["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        return forest(node, linked)

    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES))
    wanted = with_group(groups, "component", n=F.count("*"), shingles=F.sum("n_shingles")).select("node", "component", blocks.cast("int").alias("blocks"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    rows = wanted.join(texts, "node").mapInArrow(sets, "node long, component long, blocks int, hashes binary")
    rows = in_blocks(rows, "component", "node", F.col("blocks")).drop("blocks")
    return by_group(rows, ["component", "low", "high"], work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: int = 85, symbols: int = SYMBOLS, chunks: int = CHUNKS) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and kept.

    Texts are linked when 100 * |A & B| >= similar * |A | B| for their sets of
    ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle); confirmed
    on full sets. component_id is the smallest id reachable over links. Texts that are
    null, empty or white space have an empty set and stay alone. Repeated ids are one
    document with several texts. A null id is linked with nothing and gets a null
    component and kept = false. Other columns are ignored.
    """
    signed = settle(signatures(docs, id_col, text_col, words, symbols))
    usable = signed.where("n_shingles > 0 and node is not null")
    classes = settle(usable.groupBy("print_a", "print_b").agg(F.min(F.struct("node", "n_shingles", "signature")).alias("rep"), F.count("*").alias("copies")).select("print_a", "print_b", "copies", "rep.*"))
    edges = candidate_edges(classes.select("node", "signature"), symbols, chunks)
    groups = connected_components(edges)
    groups = groups.join(classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    links = confirmed_edges(docs, settle(groups), id_col, text_col, words, similar)
    roots = connected_components(links).select("node", F.col("component").alias("root"))
    known = classes.join(roots, "node", "left").select("print_a", "print_b", F.coalesce("root", "node").alias("root"), "copies", "node").where("copies > 1 or root <> node")
    found = signed.drop("signature").join(known.select("print_a", "print_b", "root"), ["print_a", "print_b"], "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("root", "node"))
    return found.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id; of rows that repeat an id the one with the smallest hash of its columns stays, rows with a null id all stay.

    Only ids that go or repeat are joined to the texts, so the texts are not shuffled while those are few.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    mark, gone, rows, row = (free_name(docs, n) for n in ("marked", "gone", "rows", "row"))
    marks = found.groupBy(F.col(id_col).alias(mark)).agg(F.max(F.when(F.col("kept"), 0).otherwise(1)).alias(gone), F.count("*").alias(rows))
    marks = stored(marks.where(f"{gone} = 1 or {rows} > 1"))
    names = [f"`{c}`" for c in docs.columns]
    rest = docs.join(marks, F.col(f"`{id_col}`") == F.col(mark), "left").where(f"{gone} is null or {gone} = 0")
    if marks.where(f"{rows} > 1").isEmpty():
        return rest.select(*names)
    once = rest.where(f"{rows} is null").select(*names)
    whole = F.struct(*names)
    repeated = rest.where(f"{rows} > 1").groupBy(mark).agg(F.min_by(whole, F.sha1(F.to_json(whole))).alias(row))
    return once.unionByName(repeated.select(f"{row}.*"))
