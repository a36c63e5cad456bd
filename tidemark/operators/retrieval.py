"""Search, fusion and weighting (RET-1 to RET-15), for a batch of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.text import iso_date, tokenize
from ..session import packed, settle
from .bounds import ASK, SLACK, bounded_scores, impact_blocks, pairs_asked, tasks_for
from .cells import build_cells, visited
from .chunking import version_of
from .index import Index, chunk_vectors, unit, weighted_sum, with_tokens

SOURCES = ("docs", "forum", "blog")
#: With more pairs of questions and postings, or of questions and chunks, than this, search goes by bounds and by cells; with fewer their steps cost more than the pairs. Results are the same.
MOST_PAIRS = 1 << 25
#: Pairs with postings are scored where their chunk is and not shuffled, so bounds pay from this many times as many.
SCORED_AT_ONCE = 1 << 5
#: Floors are made where they are of one in so many chunks at least.
LEAST_PARTS = 4
#: Ids of chunks that are sent to every task, and rows of pools.
IDS_AT_ONCE, POOL_AT_ONCE = 1 << 17, 1 << 15
#: Terms of questions, a row for each phrasing and source, that are sent to every task.
ASKED_AT_ONCE = 1 << 18
#: Pairs of postings and asked terms that a worker scores at once, and scores of chunks and lists that it holds.
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 22
#: Bytes of question vectors that a task holds.
QUESTION_BYTES = 32 << 20


def phrasings(analysed: DataFrame) -> DataFrame:
    """(qid, qi, term, qtf): the terms of each question (qi 0) and its expansions."""
    rows = analysed.select("qid", F.posexplode("all_queries").alias("qi", "phrase"))
    return rows.select("qid", "qi", F.explode(tokenize(F.col("phrase"))).alias("term")).groupBy("qid", "qi", "term").agg(F.count("*").alias("qtf"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """RET-3: the k best of each question, phrasing and source with their rank; ties by place in the source."""
    order = Window.partitionBy("qid", "qi", "source").orderBy(F.desc(F.round("score", 9)), "doc_pos", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_stats(terms: DataFrame, sources: DataFrame, stats: DataFrame) -> DataFrame:
    """The questions' terms with idf, df and average length, a row for each source."""
    return terms.join(stats.select("source", "term", "idf", "df"), "term").join(sources.select("source", "avgdl"), "source")


def bm25(terms: DataFrame, posts: DataFrame, sources: DataFrame, stats: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """RET-1: (qid, qi, source, chunk_id, doc_pos, score, rank).

    The questions' terms get idf and average length first, a row for each source. Of the
    postings only theirs are dealt out, by chunk: all pairs of a chunk are then scored in
    one task, and only each task's best leave it. The terms are written, so that Spark
    knows their size and broadcasts them while they are few.

    The k-th best score among a part of the chunks is a floor under that among all. With
    many tasks, one of ``parts`` chunks is scored first and what lies under its floors
    stays in its task: of each list about k * parts scores leave the tasks instead of k
    each, so they grow with the root of the corpus.
    """
    asked = packed(with_stats(terms, sources, stats))
    own = posts.join(asked.select("source", "term").distinct(), ["source", "term"], "left_semi")
    tasks = tasks_for(asked, "df")
    parts = isqrt(tasks)
    if parts < LEAST_PARTS:
        return ranked(summed(own, asked, tasks, k1, b), k).where("score > 0")
    first = ranked(summed(own.where(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == 0), asked, -(-tasks // parts), k1, b), k)
    floors = packed(first.where(F.col("rank") == k).select(*ASK, (F.round("score", 9) - SLACK).alias("floor")))
    hits = summed(own, packed(asked.join(floors, list(ASK), "left")), tasks, k1, b, "floor")
    return ranked(hits.where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor"), k).where("score > 0")


def summed(posts: DataFrame, asked: DataFrame, tasks: int, k1: float, b: float, *more: str) -> DataFrame:
    """(qid, qi, source, chunk_id, doc_pos, ``more`` of a question's list, score): the pairs of postings and asked terms added up, dealt by chunk."""
    met = posts.repartition(tasks, "chunk_id").join(asked, ["source", "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return met.groupBy(*ASK, "chunk_id", "doc_pos", *more).agg(F.sum(part).alias("score"))


def bm25_in_rows(asked: DataFrame, rows: DataFrame, qid: T.DataType, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """RET-1 over ``term_rows``: what ``bm25`` gives, without dealing out a posting.

    A chunk's postings are in its row, so the questions' terms (qid, qi, source, term,
    qtf, idf, avgdl) go to the rows, and only each task's k best of a list leave it.
    """
    found = rows.mapInArrow(best_of_rows(asked.select(*ASK, "term", "qtf", "idf", "avgdl").collect(), k, k1, b), "qid string, qi int, source string, chunk_id string, doc_pos long, score double")
    return ranked(found.withColumn("qid", F.col("qid").cast(qid)), k).where("score > 0")


def best_of_rows(asked: list, k: int, k1: float, b: float):
    """For a worker: ``term_rows`` to (qid, qi, source, chunk_id, doc_pos, score) of each list's k best in the task and their equals."""
    asked = sorted(asked, key=lambda r: (r.source, r.term))
    lists: dict[tuple, int] = {}
    sizes: dict[str, int] = {}
    to = np.zeros(len(asked), np.int64)
    for i, r in enumerate(asked):
        one = (r.qid, r.qi, r.source)
        if one not in lists:
            lists[one] = sizes[r.source] = sizes.get(r.source, 0) + 1
        to[i] = lists[one] - 1
    base = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    names: list = [None] * len(lists)
    for one, i in lists.items():
        names[base[one[2]] + i - 1] = one
    #: Of each source's term, where its rows begin and end.
    spans: dict[tuple, tuple[int, int]] = {}
    for i, r in enumerate(asked):
        spans[r.source, r.term] = (spans.get((r.source, r.term), (i,))[0], i + 1)
    qtf, width = np.array([r.qtf for r in asked], float), max(sizes.values(), default=1)
    idf, avgdl = np.array([r.idf for r in asked], float), np.array([r.avgdl for r in asked], float)
    # The workers get arrays, not the rows.
    last = len(asked) - 1

    def best(at: np.ndarray, score: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the scores are still among the k best of their lists, and each list's floor. Of equal scores the first by place stay."""
        order = np.lexsort((pos, -score, at))
        at, score, pos = at[order], score[order], pos[order]
        n = np.arange(len(at))
        begins = lambda *by: np.maximum.accumulate(np.where(np.r_[True, np.any([x[1:] != x[:-1] for x in by], axis=0)], n, 0)) if len(n) else n
        kth = (n - begins(at)) == k - 1
        floor = np.zeros(len(names))
        floor[at[kth]] = score[kth] - SLACK
        return order[(score >= floor[at]) & (begins(at, score, pos) - begins(at, score) < k)], floor

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(list, row, score) of a batch, in parts."""
        if last < 0 or not batch.num_rows:
            return
        held = batch.column(4)
        ends, entries = held.offsets.to_numpy(), held.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        source, term = batch.column(0).dictionary_encode(), entries.field(0).dictionary_encode()
        span = np.array([[spans.get((s, t), (0, 0)) for t in [*term.dictionary.to_pylist(), None]] for s in [*source.dictionary.to_pylist(), None]])
        of_row = source.indices.fill_null(-1).to_numpy()
        first, end = span[of_row[row], term.indices.fill_null(-1).to_numpy()].T
        tf, dl = entries.field(1).to_numpy().astype(float), batch.column(3).to_numpy()[row]
        one = np.minimum(first, last)
        part = idf[one] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl[one]))
        n = end - first
        starts = np.array([base.get(s, 0) for s in [*source.dictionary.to_pylist(), None]])[of_row]
        pairs = np.r_[0, np.cumsum(n)][ends - ends[0]]
        low = 0
        while low < batch.num_rows:
            high = min(max(low + 1, int(np.searchsorted(pairs, pairs[low] + PAIRS_AT_ONCE, "right")) - 1), low + max(1, CELLS_AT_ONCE // width), batch.num_rows)
            p = slice(ends[low] - ends[0], ends[high] - ends[0])
            which = np.repeat(np.arange(p.start, p.stop), n[p])
            at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[p]) - n[p], n[p])
            sums = np.bincount((row[which] - low) * width + to[at], part[which] * qtf[at], (high - low) * width)
            cell = np.flatnonzero(sums > 0)
            yield cell % width + starts[low + cell // width], low + cell // width, sums[cell]
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, score, pos, ids, floor = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(len(names))
        for batch in batches:
            # A place that is null comes first, as in Spark's order.
            place = batch.column(2).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            chunk = np.array(batch.column(1).to_pylist(), object)
            for to_list, row, sums in scored(batch):
                hit = sums >= floor[to_list]
                row = row[hit]
                at, score, pos, ids = np.r_[at, to_list[hit]], np.r_[score, sums[hit]], np.r_[pos, place[row]], np.r_[ids, chunk[row]]
                kept, floor = best(at, score, pos)
                at, score, pos, ids = at[kept], score[kept], pos[kept], ids[kept]
        for low in range(0, len(at), 1 << 16):
            some = slice(low, low + (1 << 16))
            own = [names[i] for i in at[some]]
            qids = pa.array([None if x[0] is None else str(x[0]) for x in own], pa.string())
            places = pa.array(pos[some], mask=pos[some] == -(1 << 63))
            yield pa.record_batch([qids, pa.array([x[1] for x in own], pa.int32()), pa.array([x[2] for x in own], pa.string()), pa.array(ids[some], pa.string()), places, pa.array(score[some])], ["qid", "qi", "source", "chunk_id", "doc_pos", "score"])

    return run


def bm25_bounded(terms: DataFrame, posts: DataFrame, sources: DataFrame, stats: DataFrame, blocks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """RET-1 with upper bounds: what ``bm25`` gives, without scoring the postings that cannot matter."""
    return ranked(bounded_scores(terms, posts, sources, stats, blocks, k, k1, b), k).where("score > 0")


def question_vectors(terms: DataFrame, index: Index, sublinear: bool = True) -> DataFrame:
    """IDX-9: (qid, qi, source, q): each phrasing's unit coordinate in every source's space."""
    tf = 1 + F.log(F.col("qtf").cast("double")) if sublinear else F.col("qtf").cast("double")
    space = index.vectors.where("kind = 'term'").select("source", F.col("key").alias("term"), F.col("vector").alias("v"), "idf")
    at = terms.join(space, "term").withColumn("w", tf * F.col("idf"))
    return at.groupBy("qid", "qi", "source").agg(weighted_sum("w", "v").alias("q")).select("qid", "qi", "source", unit(F.col("q")).alias("q"))


def dense(terms: DataFrame, index: Index, k: int, sublinear: bool = True) -> DataFrame:
    """RET-2: cosine of each phrasing's coordinate with the chunks of every source, above 1e-6; by cells where the index has them or there are very many pairs."""
    asked = settle(question_vectors(terms, index, sublinear))
    chunks = chunk_vectors(index.chunks, index.vectors)
    cells = index.cells
    if cells is None:
        sizes = asked.groupBy("source").agg(F.count("*").alias("a")).join(index.source_stats.select("source", "n"), "source")
        if sizes.agg(F.coalesce(F.sum(F.col("a") * F.col("n")), F.lit(0))).first()[0] <= MOST_PAIRS:
            return nearest(asked, chunks, k)
        cells = build_cells(settle(chunks))
    hits, _ = visited(asked, cells, k)
    return ranked(hits.withColumn("qid", F.col("qid").cast(terms.schema["qid"].dataType)), k)


def nearest(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks (source, chunk_id, doc_pos, x) of each question (qid, qi, source, q) by dot product, over 1e-6.

    A stated set of questions against all rows: the questions go to the tasks in parts
    of at most QUESTION_BYTES, each a pass over the chunks, which stay where they are;
    of a batch of chunks only those that may be among the k best leave the task.
    """
    size = asked.agg(F.coalesce(F.sum(F.size("q") * 8 + F.octet_length("qid") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // QUESTION_BYTES))
    out = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("qid", "qi", "source"), F.lit(parts)) == part) if parts > 1 else asked
        one = chunks.select("source", "chunk_id", "doc_pos", "x").mapInArrow(scores_of(own.collect(), k), "qid string, qi int, source string, chunk_id string, doc_pos long, score double")
        one = settle(one) if parts > 1 else one
        out = one if out is None else out.unionByName(one)
    return ranked(out.withColumn("qid", F.col("qid").cast(asked.schema["qid"].dataType)), k)


def scores_of(rows: list, k: int):
    """For a worker: batches of chunks to (qid, qi, source, chunk_id, doc_pos, score) of each question's k best and their equals."""
    by_source: dict[str, tuple[list, np.ndarray]] = {}
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        by_source[source] = [(str(r.qid), r.qi) for r in own], np.array([r.q for r in own], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = np.array(batch.column(0).to_pylist(), object)
            for source in set(sources.tolist()) & set(by_source):
                names, q = by_source[source]
                at = np.flatnonzero(sources == source)
                x = np.array([v for v in batch.column(3).take(pa.array(at)).to_pylist()], float)
                score = x @ q.T
                near = np.round(score, 9)
                if len(at) > k:
                    least = np.partition(near, len(at) - k, axis=0)[len(at) - k]
                    hit = (near >= least) & (score > 1e-6)
                else:
                    hit = score > 1e-6
                i, j = np.nonzero(hit)
                if len(i):
                    chosen = pa.array(at[i])
                    yield pa.record_batch([pa.array([names[n][0] for n in j]), pa.array([names[n][1] for n in j], pa.int32()), pa.array([source] * len(i)), batch.column(1).take(chosen), batch.column(2).take(chosen), pa.array(score[i, j])], ["qid", "qi", "source", "chunk_id", "doc_pos", "score"])

    return run


def fuse(lists: DataFrame, k: int = 60, expansion: float = 0.35) -> DataFrame:
    """RET-5 to RET-7: lists (arm, qid, qi, source, chunk_id, rank, score) fused by weight / (k + rank), with each list's rank and score as components."""
    weight = F.when(F.col("qi") == 0, 1.0).otherwise(expansion)
    name = F.concat("arm", F.lit("_q"), F.col("qi").cast("string"))
    entries = F.flatten(F.collect_list(F.array(F.struct(F.concat(name, F.lit("_rank")).alias("key"), F.col("rank").cast("double").alias("value")), F.struct(F.concat(name, F.lit("_score")).alias("key"), F.col("score").alias("value")))))
    return lists.where(weight > 0).groupBy("qid", "source", "chunk_id").agg(F.sum(weight / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("lists_matched"), F.map_from_entries(F.array_sort(entries)).alias("components"))


def source_weight(intent: Column, source: Column, config: EngineConfig) -> Column:
    """RET-8."""
    table = config.get("retrieval.weights")
    pairs = [F.lit(x) for i, row in table.items() for s, w in row.items() for x in (f"{i}/{s}", float(w))]
    known = F.create_map(*pairs)
    row = F.when(intent.isin(*table), intent).otherwise("unknown")
    return F.coalesce(F.try_element_at(known, F.concat_ws("/", row, source)), F.lit(0.7))


def authority(config: EngineConfig) -> Column:
    """RET-9."""
    a = config.get("retrieval.authority")
    prior = F.create_map(*[F.lit(x) for kv in a["docs_type_prior"].items() for x in kv])
    votes = F.least(F.coalesce("votes", F.lit(0)) / F.lit(float(a["forum_votes_saturation"])), F.lit(1.0))
    role = F.when(F.col("author_role") == "staff", 1.0).when(F.col("author_role") == "mvp", 0.6).otherwise(0.0)
    forum = a["forum_accepted_weight"] * F.coalesce(F.col("is_accepted"), F.lit(False)).cast("double") + a["forum_votes_weight"] * votes + a["forum_staff_weight"] * role
    forum = F.when(F.coalesce("corroborating_followups", F.lit(0)) > 0, F.least(forum + 0.05, F.lit(1.0))).otherwise(forum)
    return (
        F.when(F.col("source") == "docs", F.coalesce(F.try_element_at(prior, F.col("doc_type")), F.lit(0.8)))
        .when(F.col("source") == "forum", F.when(F.coalesce(F.col("unanswered"), F.lit(False)), 0.10).otherwise(forum))
        .when(F.col("source") == "blog", F.when(F.col("author_role") == "staff", a["blog_staff_bonus"]).otherwise(a["blog_guest_bonus"]))
        .otherwise(0.5)
    )


def recency(intent: Column, config: EngineConfig) -> Column:
    """RET-10."""
    r = config.get("retrieval.recency")
    if not r["enabled"]:
        return F.lit(1.0)
    date = iso_date(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("published_at", "created_at", "last_updated")]))
    age = F.greatest(F.lit(0), F.datediff(F.lit(r["reference_date"]).cast("date"), date))
    faded = F.greatest(F.lit(float(r["floor"])), F.exp(-F.log(F.lit(2.0)) * age / r["half_life_days"]))
    return F.when(intent.isin(*r["skip_for_intents"]) | (F.col("source") == "docs") | date.isNull(), 1.0).otherwise(faded)


def weigh(fused: DataFrame, analysed: DataFrame, chunks: DataFrame, config: EngineConfig) -> DataFrame:
    """RET-11: the combined score with its parts."""
    rows = fused.join(chunks, ["source", "chunk_id"]).join(analysed.select("qid", "query", "intent", "version_mentioned", "product_area", "entities"), "qid")
    rows = rows.withColumn("version_own", version_of()).withColumn("authority", authority(config)).withColumn("recency", recency(F.col("intent"), config)).withColumn("source_weight", source_weight(F.col("intent"), F.col("source"), config))
    score = F.col("source_weight") * F.col("rrf") * (1 + config.get("retrieval.authority.beta") * F.col("authority")) * (1 + config.get("retrieval.recency.strength") * (F.col("recency") - 1))
    return rows.withColumn("retrieval_score", F.round(score, 12))


def version_filter(rows: DataFrame) -> DataFrame:
    """RET-12: after ranking, only a chunk of another major version than the one mentioned goes."""
    major = lambda c: F.split(F.col(c), r"\.")[0]
    free = F.coalesce(F.col("doc_type").isin("changelog", "guide"), F.lit(False)) | F.coalesce(F.col("product_area_of_chunk") == "migration", F.lit(False))
    return rows.where(F.col("version_mentioned").isNull() | free | F.col("version_own").isNull() | (major("version_own") == major("version_mentioned")))


def pool(rows: DataFrame, size: int, floor: int) -> DataFrame:
    """RET-13, RET-14: the best ``floor`` of each source, then the best of the rest, up to ``size``; rank_before by score."""
    best = [F.desc("retrieval_score"), F.asc("chunk_id")]
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("qid", "source").orderBy(*best)))
    kept = own.withColumn("_at", F.row_number().over(Window.partitionBy("qid").orderBy((F.col("_own") > floor).cast("int"), *best))).where((F.col("_at") <= size) | (F.col("_own") <= floor))
    return kept.withColumn("rank_before", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).drop("_own", "_at")


def search_lists(analysed: DataFrame, index: Index, config: EngineConfig) -> DataFrame:
    """RET-4: both arms' lists side by side."""
    terms = phrasings(analysed)
    k = config.get("retrieval.top_k_per_source")
    arms = []
    if config.get("index.bm25.enabled"):
        shape = (k, config.get("index.bm25.k1"), config.get("index.bm25.b"))
        terms = settle(terms)
        tables = (index.postings, index.source_stats, index.stats_of(terms))
        asked = packed(with_stats(terms, *tables[1:])) if index.rows is not None else None
        if asked is not None and asked.count() <= ASKED_AT_ONCE:
            found = bm25_in_rows(asked, index.rows, terms.schema["qid"].dataType, *shape)
        elif pairs_asked(terms, tables[2]) > MOST_PAIRS * SCORED_AT_ONCE:
            blocks = index.blocks if index.blocks is not None else settle(impact_blocks(index.postings, index.source_stats, *shape[1:]))
            found = bm25_bounded(terms, *tables, blocks, *shape)
        else:
            found = bm25(terms, *tables, *shape)
        arms.append(found.withColumn("arm", F.lit("bm25")))
    if config.get("index.dense.enabled") and index.vectors is not None:
        arms.append(dense(terms, index, k, config.get("index.dense.sublinear_tf")).withColumn("arm", F.lit("dense")))
    return reduce(DataFrame.unionByName, arms)


TEXTS = ("text", "display_text", "context_header", "tokens", "display_tokens")


def without_texts(chunks: DataFrame) -> DataFrame:
    """An index's chunks for weighing: a hash in the place of their texts, by which ``with_texts`` finds them."""
    return chunks.withColumn("_texts", F.xxhash64("text", "display_text", "context_header")).drop(*TEXTS).withColumnRenamed("product_area", "product_area_of_chunk")


def named_by(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that ``rows``, a written table, name. Up to IDS_AT_ONCE ids go to all tasks, so that no other chunk is shuffled."""
    ids = packed(rows.select("source", "chunk_id").distinct())
    return chunks.join(F.broadcast(ids) if ids.count() <= IDS_AT_ONCE else ids, ["source", "chunk_id"], "left_semi")


def with_texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of ``without_texts`` with their texts and tokens. No text of another chunk is shuffled or cut into tokens; up to POOL_AT_ONCE rows go to the texts, so that none is shuffled, unless chunks repeat."""
    rows = packed(rows)
    key = ["source", "chunk_id", "_texts"]
    own = named_by(rows, chunks.select("source", "chunk_id", *TEXTS[:3])).withColumn("_texts", F.xxhash64(*TEXTS[:3]))
    if rows.count() <= min(POOL_AT_ONCE, IDS_AT_ONCE) and own.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return with_tokens(own).join(F.broadcast(rows), key).select(*rows.columns, *TEXTS).drop("_texts")
    return rows.join(with_tokens(own.dropDuplicates(key)), key).select(*rows.columns, *TEXTS).drop("_texts")


def scored_candidates(lists: DataFrame, analysed: DataFrame, index: Index, config: EngineConfig) -> DataFrame:
    """The lists, a written table, fused and weighed, without chunks of another version and without texts."""
    fused = fuse(lists, config.get("retrieval.rrf_k"), config.get("retrieval.query_analysis.expansion_weight"))
    scored = weigh(fused, analysed, without_texts(named_by(lists, index.chunks)), config)
    return version_filter(scored) if config.get("retrieval.query_analysis.version_filter_is_hard") else scored


def candidates_of(lists: DataFrame, analysed: DataFrame, index: Index, config: EngineConfig) -> DataFrame:
    """The pool of each question."""
    return with_texts(pool(scored_candidates(lists, analysed, index, config), config.get("retrieval.candidate_pool"), config.get("retrieval.min_per_source")), index.chunks)


def retrieve(analysed: DataFrame, index: Index, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(candidates, per-source statistics: RET-15)."""
    # Written once: the pool and the statistics read them.
    lists = packed(search_lists(analysed, index, config))
    scored = packed(scored_candidates(lists, analysed, index, config))
    hits = lists.groupBy("qid", "source").agg(F.count(F.when(F.col("arm") == "bm25", 1)).alias("bm25_hits"), F.count(F.when(F.col("arm") == "dense", 1)).alias("dense_hits"), F.countDistinct("chunk_id").alias("fused"))
    top = scored.groupBy("qid", "source").agg(F.bround(F.max("retrieval_score"), 6).alias("top_score"))
    best = pool(scored, config.get("retrieval.candidate_pool"), config.get("retrieval.min_per_source"))
    return with_texts(best, index.chunks), hits.join(top, ["qid", "source"], "left").fillna(0.0, ["top_score"])
