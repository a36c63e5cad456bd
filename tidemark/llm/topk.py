"""Exact top-k search by the three-phase uniform threshold.

A vector's dimensions are cut into ``LISTS`` lists. A list scores a query by the inner
product over its own dimensions, and a candidate's score is the sum of its local scores,
so this is the search for the best sums over lists that lie on different machines:

1. Every list sends each query's k best local scores. Those candidates are scored
   exactly, and the k-th best score is the cutoff t: the answer has no lower score.
2. The cutoff goes to all lists, and each sends its entries of t / LISTS or more. A
   candidate in none of them has a sum below t, so the candidates are complete.
3. An absent entry is below t / LISTS, which bounds a candidate's sum from above. Those
   whose bound reaches the k-th best known sum are resolved: the lists that have not
   named them are asked for exactly those local scores.

Local scores may be negative; nothing above needs them not to be. Equal vectors are one
candidate and one query, named by their smallest id: of k + 1 best rows at most k + 1
vectors are needed, and of each vector the k + 1 smallest ids. All numbers are integers.

Lists hold rows and queries in blocks, and a task holds one block of rows of one list;
the queries stream past it. Nothing comes to the driver but the numbers of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .lattice import matrix, whole_vectors

LISTS = 2
#: Vectors of a block of rows and of a block of queries.
ROWS, QUERIES = 8192, 16384
#: Queries that meet a block of rows at once.
AT_ONCE = 256
KEYS = ("list", "query_block", "row_block")
#: Kinds of a group's entries, in the order in which they come.
ROW, QUERY, REQUEST = 0, 1, 2
SENT = "query long, id long, list int, local long"


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query, all if there are fewer.

    Components become floor(64 * c). Queries are the rows whose id is divisible by
    ``every``; candidates are all rows with another id; the score is the integer inner
    product, ties go to the smaller id. Vectors that are null, hold null or non-finite
    components, or whose squared length reaches 2^62 take no part, neither do null ids.
    A shorter vector counts as filled up with zeros, an empty one has score 0 with all.
    Of rows that repeat an id one counts, that with the smallest vector as bytes. No
    rows, or one, give no rows. Other columns are ignored.
    """
    found = whole_vectors(vectors, id_col, vector_col).where("x is not null and node is not null")
    rows = settle(found.groupBy("node").agg(F.min("x").alias("x")))
    classes = settle(rows.groupBy("x").agg(F.min("node").alias("id"), F.count(F.when(F.col("node") % every == 0, 1)).alias("asks")))
    n, asked, width = classes.agg(F.count("*"), F.count(F.when(F.col("asks") > 0, 1)), F.coalesce(F.max(F.octet_length("x")), F.lit(0))).first()
    members = rows.join(classes.select("x", "id"), "x").select(F.col("id").alias("class"), "node")
    best = best_sums(classes.select("id", "x"), classes.where("asks > 0").select("id", "x"), n, asked, width // 8, k + 1, lists)
    return rows_of(best, members, k, every, id_col)


def best_sums(candidates: DataFrame, queries: DataFrame, n: int, asked: int, width: int, k: int, lists: int = LISTS) -> DataFrame:
    """(query, id, score): the ``k`` best of ``n`` candidates (id, x) for each of the ``asked`` queries (id, x), ties to the smaller id."""
    lists = max(1, min(lists, width))
    store = Lists(candidates, n, asked, width, lists)
    by_local = Window.partitionBy("query", "list").orderBy(F.desc("local"), "id")
    first = store.answer(queries, best_local(k)).withColumn("at", F.row_number().over(by_local)).where(F.col("at") <= k).drop("at")
    cutoffs = kth(store.resolved(queries, settle(seen(first, lists))), k, "cutoff")
    queries = settle(queries.join(cutoffs, F.col("id") == F.col("query"), "left").select("id", "x", "cutoff"))
    named = settle(seen(store.answer(queries, sufficient(lists)), lists))
    reached = kth(named.where(F.size("missing") == 0).select("query", "id", F.col("known").alias("score")), k, "reached")
    limits = queries.select(F.col("id").alias("query"), "cutoff").join(reached, "query", "left")
    bound = F.col("known") + F.size("missing") * F.floor((F.col("cutoff") - 1) / lists)
    # Without a cutoff there are fewer candidates than k, and the lists have sent all of them.
    left = named.join(limits, "query").where(F.col("cutoff").isNull() | (bound >= F.greatest("cutoff", "reached")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = store.resolved(queries, settle(left.select("query", "id", "known", "missing")))
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def seen(entries: DataFrame, lists: int) -> DataFrame:
    """(query, id, known, missing): the sum of a candidate's entries, and the lists that have sent none."""
    got = entries.groupBy("query", "id").agg(F.sum("local").alias("known"), F.bit_or(F.expr("shiftleft(1L, list)")).alias("named"))
    return got.select("query", "id", "known", F.expr(f"filter(sequence(0, {lists - 1}), i -> (shiftright(named, i) & 1) = 0)").alias("missing"))


def kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """(query, name): the k-th best score of each query that has as many."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = scores.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    return best.groupBy("query").agg(F.min("score").alias(name), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


class Lists:
    """The lists of the candidates: blocks of rows, each with its own dimensions only."""

    def __init__(self, candidates: DataFrame, n: int, asked: int, width: int, lists: int):
        cuts = [width * i // lists for i in range(lists + 1)]
        self.widths = [b - a for a, b in pairwise(cuts)]
        self.slices = F.array(*[F.substring("x", 8 * a + 1, 8 * (b - a)) for a, b in pairwise(cuts)])
        self.blocks = {"row_block": max(1, -(-n // ROWS)), "query_block": max(1, -(-asked // QUERIES))}
        self.rows = self.dealt(candidates.withColumn("cutoff", F.lit(None).cast("long")), ROW, "row_block", "query_block")

    def block(self, of: str, name: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.blocks[name])).cast("int").alias(name)

    def dealt(self, vectors: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        """A vector's part in each list goes to its own block's groups with every block of the other side."""
        cut = vectors.select("id", "cutoff", self.block("id", own), F.posexplode(self.slices).alias("list", "part"))
        every = F.explode(F.sequence(F.lit(0), F.lit(self.blocks[other] - 1)))
        return cut.withColumn(other, every).select(*KEYS, F.lit(kind).alias("kind"), "id", F.lit(None).cast("long").alias("query"), "cutoff", "part")

    def answer(self, queries: DataFrame, work: Callable, requests: DataFrame | None = None) -> DataFrame:
        """What the lists send to ``queries`` (id, x), or to ``requests`` (query, id, list) alone."""
        if "cutoff" not in queries.columns:
            queries = queries.withColumn("cutoff", F.lit(None).cast("long"))
        parts = self.rows.unionByName(self.dealt(queries, QUERY, "query_block", "row_block"))
        if requests is not None:
            none = F.lit(None)
            at = requests.select("list", self.block("query", "query_block"), self.block("id", "row_block"), F.lit(REQUEST).alias("kind"), "id", "query", none.cast("long").alias("cutoff"), none.cast("binary").alias("part"))
            parts = parts.unionByName(at)
        return parts.repartition(*KEYS).sortWithinPartitions(*KEYS, "kind").mapInArrow(at_list(work, self.widths), SENT)

    def resolved(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query, id, score) of ``pairs`` (query, id, known, missing): the missing lists are asked."""
        wanted = pairs.select("query", "id", F.explode("missing").alias("list"))
        rest = self.answer(queries, asked_for, wanted).groupBy("query", "id").agg(F.sum("local").alias("rest"))
        return pairs.join(rest, ["query", "id"], "left").select("query", "id", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("score"))


class Block:
    """Ids, in order, with their whole numbers and cutoffs."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(batches)
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.x = matrix(table["part"].to_pylist(), width)[order]
        self.cutoff = [table["cutoff"][int(i)].as_py() for i in order] if table["cutoff"].null_count < len(ids) else [None] * len(ids)
        self.length = float(np.sqrt((self.x.astype(float) ** 2).sum(axis=1).max())) if len(ids) else 0.0

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def at_list(work: Callable, widths: list[int]) -> Callable:
    """Over sorted groups: holds a block of rows and one of queries, and lets requests pass by."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for batch in batches:
            marks = np.array([batch.column(i).to_numpy() for i in range(4)])
            bounds = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in pairwise(bounds):
                *key, kind = marks[:, a].tolist()
                yield tuple(key), kind, batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(pieces(batches), key=lambda p: p[0]):
            held: dict[int, Block] = {}
            for kind, same in groupby(group, key=lambda p: p[1]):
                if kind != REQUEST:
                    held[kind] = Block([p[2] for p in same], widths[key[0]])
                else:
                    for piece in same:
                        yield from work(held[ROW], held[QUERY], key[0], piece[2])
            if len(held) == 2 and work is not asked_for:
                yield from work(held[ROW], held[QUERY], key[0], None)

    return run


def local_scores(rows: Block, queries: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores) for slices of the queries. Floats where every sum is exact in them, else 8-byte integers."""
    most = rows.length * queries.length
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    x = rows.x.astype(kind).T
    for a in range(0, len(queries.ids), AT_ONCE):
        yield a, queries.x[a : a + AT_ONCE].astype(kind) @ x


def entries(rows: Block, queries: Block, number: int, first: int, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(queries.ids[first + i]), pa.array(rows.ids[j]), pa.array(np.full(len(i), number, np.int32)), pa.array(score[i, j].astype(np.int64))], ["query", "id", "list", "local"])


def best_local(k: int) -> Callable:
    """Phase 1: a block's k best entries of each query."""

    def work(rows: Block, queries: Block, number: int, _) -> Iterator[pa.RecordBatch]:
        n = len(rows.ids)
        for first, score in local_scores(rows, queries):
            j = np.argpartition(score, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(score), 1))
            yield entries(rows, queries, number, first, np.arange(len(score)).repeat(j.shape[1]), j.ravel(), score)

    return work


def sufficient(lists: int) -> Callable:
    """Phase 2: the entries of the cutoff's share or more."""

    def work(rows: Block, queries: Block, number: int, _) -> Iterator[pa.RecordBatch]:
        least = np.array([-(1 << 62) if c is None else -(-c // lists) for c in queries.cutoff], np.int64)
        for first, score in local_scores(rows, queries):
            i, j = np.nonzero(score >= least[first : first + len(score), None].astype(score.dtype))
            yield entries(rows, queries, number, first, i, j, score)

    return work


def asked_for(rows: Block, queries: Block, number: int, requests: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Phase 3: the local scores of the candidates asked for."""
    ids, asked = (requests.column(requests.schema.get_field_index(c)) for c in ("id", "query"))
    local = np.einsum("ij,ij->i", queries.x[queries.at(asked.to_numpy())], rows.x[rows.at(ids.to_numpy())])
    yield pa.record_batch([asked, ids, pa.array(np.full(len(local), number, np.int32)), pa.array(local)], ["query", "id", "list", "local"])


def rows_of(best: DataFrame, members: DataFrame, k: int, every: int, id_col: str) -> DataFrame:
    """From best vectors (query, id, score) to best rows: each vector's k + 1 smallest ids, then each query row's list without the row itself."""
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("node"))).where(F.col("at") <= k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    named = best.join(first.select(F.col("class").alias("id"), "node"), "id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    # At most k + 1 entries a list.
    answers = named.groupBy(F.col("query").alias("class")).agg(F.array_sort(F.collect_list(F.struct("at", "node", "score"))).alias("found"))
    asked = members.where(F.col("node") % every == 0).join(answers, "class")
    others = F.slice(F.filter("found", lambda f: f["node"] != F.col("node")), 1, k)
    out = asked.select(F.col("node").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.node").alias(id_col), F.col("hit.score").alias("score"))
