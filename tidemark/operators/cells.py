"""Dense search by cells (RET-2): exact, by the triangle inequality.

Vectors lie in cells, each with a centre and a radius; no vector of a cell is nearer to a
question than the centre is, less the radius. The cells nearest to a question that
hold k chunks give its k-th best score so far, and of the others only those that can
reach it are visited. Large cells are dealt to several tasks, and so are the questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import packed

#: Centres of a source come from a sample of this many chunks at most, and there are no more than the last number.
SAMPLE, MOST_CELLS = 4096, 1024
#: Chunks and questions of a task.
ROWS = 4096
SLACK = 1e-7
ASK = ("qid", "qi", "source")


@dataclass(frozen=True)
class Cells:
    """Chunks (source, chunk_id, doc_pos, x, cell, part), cells (source, cell, radius, long, n, parts) and, on the driver, the bounded centres of each source."""

    chunks: DataFrame
    cells: DataFrame
    centres: dict[str, np.ndarray]


def build_cells(chunks: DataFrame) -> Cells:
    """Cells of chunk vectors (source, chunk_id, doc_pos, x): about the root of their number for each source, by centres far from each other in a sample."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    sample = chunks.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE).join(counts, "source").where(F.col("at") <= F.lit(8) * F.sqrt("n") + 8)
    drawn: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for row in sample.select("source", "x", "n").collect():
        drawn.setdefault(row.source, []).append(row.x)
        sizes[row.source] = row.n
    centres = {s: far_apart(np.array(x, float), int(min(MOST_CELLS, np.ceil(np.sqrt(sizes[s]))))) for s, x in drawn.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = np.array(batch.column(0).to_pylist(), object)
            cell, far, long = np.zeros(len(sources), np.int32), np.zeros(len(sources)), np.zeros(len(sources))
            for source in set(sources.tolist()):
                own = np.flatnonzero(sources == source)
                x = np.array(batch.column(3).take(pa.array(own)).to_pylist(), float)
                near = squares(x, centres[source])
                cell[own] = near.argmin(axis=1)
                # Computed from the difference: the short form is not exact to the last digits.
                far[own], long[own] = np.linalg.norm(x - centres[source][cell[own]], axis=1), np.linalg.norm(x, axis=1)
            yield pa.record_batch([*batch.columns[:4], pa.array(cell), pa.array(far), pa.array(long)], ["source", "chunk_id", "doc_pos", "x", "cell", "far", "long"])

    placed = packed(chunks.select("source", "chunk_id", "doc_pos", "x").mapInArrow(assign, "source string, chunk_id string, doc_pos long, x array<double>, cell int, far double, long double"))
    cells = packed(placed.groupBy("source", "cell").agg(F.max("far").alias("radius"), F.max("long").alias("long"), F.count("*").alias("n"), F.ceil(F.count("*") / ROWS).cast("int").alias("parts")))
    dealt = placed.drop("far", "long").join(cells.select("source", "cell", "parts"), ["source", "cell"])
    return Cells(dealt.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts"), cells, centres)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each the farthest from those before it."""
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < count:
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if nearest.max() <= 1e-12:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def cell_bounds(asked: DataFrame, cells: Cells) -> DataFrame:
    """(qid, qi, source, cell, bound): no chunk of the cell has a larger product with the question's vector.

    q x = q c + q (x - c) <= q c + |q| r, and, as |q - x| >= |q - c| - r, also
    q x <= (|q|^2 + max |x|^2 - max(0, |q - c| - r)^2) / 2.
    """
    radius: dict[str, np.ndarray] = {s: np.zeros(len(c)) for s, c in cells.centres.items()}
    long: dict[str, np.ndarray] = {s: np.zeros(len(c)) for s, c in cells.centres.items()}
    for row in cells.cells.select("source", "cell", "radius", "long").collect():  # at most MOST_CELLS a source
        radius[row.source][row.cell], long[row.source][row.cell] = row.radius, row.long
    centres = cells.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sources = np.array(part.column(2).to_pylist(), object)
                for source in set(sources.tolist()) & set(centres):
                    own = np.flatnonzero(sources == source)
                    q, c, r = np.array(part.column(3).take(pa.array(own)).to_pylist(), float), centres[source], radius[source]
                    gap = np.maximum(0.0, np.sqrt(np.maximum(0.0, squares(q, c))) - r - SLACK)
                    length = (q * q).sum(axis=1)[:, None]
                    bound = np.minimum(q @ c.T + np.sqrt(length) * r, (length + long[source] ** 2 - gap * gap) / 2)
                    take = pa.array(own.repeat(len(c)))
                    yield pa.record_batch([*(part.column(i).take(take) for i in range(3)), pa.array(np.tile(np.arange(len(c), dtype=np.int32), len(own))), pa.array(bound.ravel())], ["qid", "qi", "source", "cell", "bound"])

    return asked.select(*ASK, "q").mapInArrow(run, "qid string, qi int, source string, cell int, bound double")


def visited(asked: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): the scores of chunks among which are each question's ``k`` best and their equals, and (qid, qi, source, cell, n) of the cells visited for them."""
    asked = asked.select(F.col("qid").cast("string").alias("qid"), "qi", "source", "q")
    bounds = packed(cell_bounds(asked, cells).join(cells.cells.select("source", "cell", "n", "parts"), ["source", "cell"]))
    order = Window.partitionBy(*ASK).orderBy(F.desc("bound"), "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = packed(bounds.withColumn("first", before < k))
    first = packed(scored(asked, bounds.where("first"), cells, k))
    best = first.withColumn("at", F.row_number().over(Window.partitionBy(*ASK).orderBy(F.desc("score")))).where(F.col("at") <= k)
    floors = best.groupBy(*ASK).agg(F.min("score").alias("floor"), F.count("*").alias("found")).where(F.col("found") == k).drop("found")
    more = bounds.where("not first").join(floors, list(ASK), "left").where(F.col("bound") >= F.coalesce(F.col("floor") - SLACK, F.lit(0.0)))
    more = packed(more)
    visits = bounds.where("first").select(*ASK, "cell", "n").unionByName(more.select(*ASK, "cell", "n"))
    return first.unionByName(scored(asked, more, cells, k)), visits


def scored(asked: DataFrame, visits: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(qid, qi, source, chunk_id, doc_pos, score) over 1e-6: of each part of a cell visited, its ``k`` best and their equals."""
    keys = ["source", "cell", "part", "batch"]
    total = visits.groupBy("source", "cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("batches"))
    going = visits.join(total, ["source", "cell"]).withColumn("batch", F.pmod(F.xxhash64("qid", "qi"), F.col("batches")).cast("int"))
    going = going.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(asked, list(ASK)).select(*keys, "qid", "qi", "q")
    held = cells.chunks.join(total, ["source", "cell"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).select(*keys, "chunk_id", "doc_pos", "x")

    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "qi", "source", "chunk_id", "doc_pos", "score"]
        out = []
        if left.num_rows and right.num_rows:
            x = np.array(right["x"].to_pylist(), float)
            for at in range(0, left.num_rows, 256):
                some = left.slice(at, 256)
                score = np.array(some["q"].to_pylist(), float) @ x.T
                near = np.round(score, 9)
                hit = score > 1e-6
                if x.shape[0] > k:
                    hit &= near >= np.partition(near, x.shape[0] - k, axis=1)[:, x.shape[0] - k, None]
                i, j = np.nonzero(hit)
                source = pa.array([left["source"][0].as_py()] * len(i), pa.string())
                out.append(pa.table([some["qid"].take(pa.array(i)), some["qi"].take(pa.array(i)), source, right["chunk_id"].take(pa.array(j)), right["doc_pos"].take(pa.array(j)), pa.array(score[i, j])], names))
        schema = pa.schema([("qid", pa.string()), ("qi", pa.int32()), ("source", pa.string()), ("chunk_id", pa.string()), ("doc_pos", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return going.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(products, "qid string, qi int, source string, chunk_id string, doc_pos long, score double")
