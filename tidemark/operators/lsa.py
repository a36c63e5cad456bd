"""Latent semantic space of every source (IDX-6 to IDX-8) by a randomised decomposition over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Matrix entries and rows of sums that a task holds at a time.
ENTRIES, HELD = 1 << 15, 1 << 15
SUMS = "source string, key string, v binary"


def lsa(weights: DataFrame, dims: int = 256, width: int | None = None) -> DataFrame:
    """(source, kind, key, vector, idf): the term-space projections that both sides share.

    kind ``term``: sqrt(s) * v_term, so the sum over a question's weights is its
    coordinate; kind ``chunk``: u_chunk * sqrt(s), unit length (idf null).

    Every chunk's sum of random sign vectors of its terms spans the space: exactly, where
    a source has at most ``width`` (``dims`` and a quarter, 64 more at least) chunks or terms, else its strongest
    directions. Made orthonormal by its Gram matrix, that is a basis; the matrix is the
    basis times a row for each term, and the decomposition of those rows' Gram matrix
    gives the singular values. Chunks and terms stay tables; only sums for each task and
    term are shuffled, and the driver holds width * width numbers for each source.
    """
    width = width or dims + max(64, dims // 4)
    entry = F.struct("term", F.xxhash64("term").alias("h"), "w")
    rows = weights.groupBy("source", "chunk_id").agg(F.collect_list(entry).alias("e"))
    rows = rows.select("source", "chunk_id", F.col("e.term").alias("terms"), F.col("e.h").alias("h"), F.col("e.w").alias("w"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                h, w, cut = flat(part, 3), flat(part, 4), offsets(part)
                some, back = np.unique(h, return_inverse=True)
                y = np.add.reduceat(signs(some, width)[back] * w[:, None], cut[:-1], axis=0)
                yield pa.record_batch([*part.columns[:3], part.column(4), packed(y)], ["source", "chunk_id", "terms", "w", "v"])

    drawn = settle(rows.mapInArrow(sketch, "source string, chunk_id string, terms array<string>, w array<double>, v binary"))
    turns = {}
    for source, g in grams(drawn).items():
        values, u = np.linalg.eigh(g)
        keep = values > 1e-11 * values.max()
        turns[source] = u[:, keep] / np.sqrt(values[keep])
    basis = settle(turned(drawn, turns, ["source", "chunk_id", "terms", "w"]))

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums()
        for batch in batches:
            for part in bounded(batch):
                terms = part.column(2).flatten().dictionary_encode()
                names, at, w, cut = terms.dictionary.to_pylist(), terms.indices.to_numpy(), flat(part, 3), offsets(part)
                sources = part.column(0).to_pylist()
                for source in set(sources):
                    own = np.array([s == source for s in sources])
                    x = unpacked(part.column(4).filter(pa.array(own)))
                    number = np.cumsum(own) - 1
                    of = np.repeat(np.arange(len(own)), np.diff(cut))
                    on = own[of]
                    order = np.argsort(at[on], kind="stable")
                    term = at[on][order]
                    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
                    sums = np.add.reduceat(x[number[of[on]][order]] * w[on][order][:, None], first, axis=0)
                    held.add(source, [names[t] for t in term[first]], sums)
                yield from held.over(HELD)
        yield from held.over(0)

    terms = settle(added(basis.mapInArrow(by_term, SUMS)))
    own, shared = {}, {}
    for source, g in grams(terms).items():
        values, u = np.linalg.eigh(g)
        order = np.argsort(-values)[:dims]
        order = order[values[order] > 1e-9 * max(1.0, values.max())]
        u = u[:, order]
        u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])  # reruns agree in sign
        root = np.sqrt(np.sqrt(values[order]))
        own[source], shared[source] = u * root, u / root
    chunks = turned(basis, own, ["source", "chunk_id"], unit=True).select("source", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "v", F.lit(None).cast("double").alias("idf"))
    idf = weights.groupBy("source", F.col("term").alias("key")).agg(F.max("idf").alias("idf"))
    spread = turned(terms, shared, ["source", "key"]).join(idf, ["source", "key"]).select("source", F.lit("term").alias("kind"), "key", "v", "idf")
    return arrays(chunks.unionByName(spread))


def signs(h: np.ndarray, width: int) -> np.ndarray:
    """Random signs of each hash."""
    found = np.empty((len(h), -(-width // 64) * 64))
    for i in range(found.shape[1] // 64):
        x = h.astype(np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        found[:, i * 64 : i * 64 + 64] = np.unpackbits(x[:, None].view(np.uint8), axis=1)
    return 2 * found[:, :width] - 1


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ENTRIES matrix entries."""
    cut = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy())]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(cut, cut[row] + ENTRIES, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def flat(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy()


def offsets(batch: pa.RecordBatch) -> np.ndarray:
    return np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy())]


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v) for v in column.to_pylist()])


class Sums:
    """Sums of vectors by source and key, in one growing matrix for each source."""

    def __init__(self):
        self.rows: dict[str, dict[str, int]] = {}
        self.sums: dict[str, np.ndarray] = {}

    def add(self, source: str, keys: list[str], x: np.ndarray) -> None:
        """Add a vector for each key; keys are distinct."""
        rows = self.rows.setdefault(source, {})
        at = np.array([rows.setdefault(key, len(rows)) for key in keys])
        sums = self.sums.get(source)
        if sums is None or len(rows) > len(sums):
            grown = np.zeros((max(64, 2 * len(rows)), x.shape[1]))
            if sums is not None:
                grown[: len(sums)] = sums
            self.sums[source] = sums = grown
        sums[at] += x

    def over(self, most: int) -> Iterator[pa.RecordBatch]:
        """What is held, when it is more than ``most`` rows."""
        if sum(map(len, self.rows.values())) > most:
            for source, rows in self.rows.items():
                yield pa.record_batch([pa.array([source] * len(rows)), pa.array(list(rows)), packed(self.sums[source][: len(rows)])], ["source", "key", "v"])
            self.rows, self.sums = {}, {}


def added(rows: DataFrame) -> DataFrame:
    """The sums of (source, key, v) over all tasks; a task holds one batch of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Sums(), None
        for batch in batches:
            sources = batch.column(0).to_pylist()
            at = 0
            while at < len(sources):
                end = min(at + 1024, len(sources))
                while sources[end - 1] != sources[at]:
                    end -= 1  # rows are sorted, and vectors of one source have one length
                keys, x = batch.column(1).slice(at, end - at).to_pylist(), unpacked(batch.column(2).slice(at, end - at))
                first = np.array([i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]])
                # Keys stand together, so all but one that goes on from the rows before are new.
                if (sources[at], keys[0]) != last:
                    yield from held.over(HELD)
                held.add(sources[at], [keys[i] for i in first], np.add.reduceat(x, first, axis=0))
                last = sources[at], keys[-1]
                at = end
        yield from held.over(0)

    return rows.repartition("source", "key").sortWithinPartitions("source", "key").mapInArrow(run, SUMS)


def grams(rows: DataFrame) -> dict[str, np.ndarray]:
    """The Gram matrix of each source's vectors: summed up by task, then by source; a matrix for each source comes to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            sources = batch.column(0).to_pylist()
            for source in set(sources):
                x = unpacked(batch.column(1).filter(pa.array([s == source for s in sources])))
                found[source] = found.get(source, 0) + x.T @ x
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array([g.tobytes() for g in found.values()], pa.large_binary())], ["source", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for source, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[source] = found.get(source, 0) + np.frombuffer(g)
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array([g.tobytes() for g in found.values()], pa.large_binary())], ["source", "v"])

    sums = rows.select("source", "v").mapInArrow(part, "source string, v binary").repartition("source").mapInArrow(total, "source string, v binary").collect()
    return {r.source: np.frombuffer(r.v).reshape(int(np.sqrt(len(r.v) // 8)), -1) for r in sums}


def turned(rows: DataFrame, turns: dict[str, np.ndarray], keep: list[str], unit: bool = False) -> DataFrame:
    """``rows`` with their vectors times their source's matrix, of unit length if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sources = np.array(part.column(0).to_pylist(), object)
                out = np.empty(len(sources), object)
                x = part.column(len(keep))
                for source in set(sources.tolist()):
                    own = np.flatnonzero(sources == source)
                    y = unpacked(x.take(pa.array(own))) @ turns[source]
                    if unit:
                        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                    for i, v in zip(own, y, strict=True):
                        out[i] = v.tobytes()
                yield pa.record_batch([*part.columns[:-1], pa.array(out.tolist(), pa.binary())], part.schema.names)

    rows = rows.select(*keep, "v")
    return rows.mapInArrow(run, rows.schema)


def arrays(rows: DataFrame) -> DataFrame:
    """(source, kind, key, vector, idf) with the vectors as arrays of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([np.frombuffer(v) for v in batch.column(3).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:3], vectors, batch.column(4)], ["source", "kind", "key", "vector", "idf"])

    return rows.mapInArrow(run, "source string, kind string, key string, vector array<double>, idf double")

