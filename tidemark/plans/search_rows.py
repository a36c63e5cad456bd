"""Registered queries of search by bounds and cells, of both arms together, and of the latent space, with their SQL.

Vectors of terms and chunks are those of ``dense_lists`` (digits of a hash), as a hosted
encoder would give them; the latent space is that of the benchmark's passages at full
rank, where its products are those of the weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import text as tx
from ..operators import index as ix
from ..operators import retrieval as ret
from ..operators.bounds import impact_blocks
from ..operators.cells import build_cells
from ..operators.lsa import lsa
from ..session import packed, settle, spread
from . import catalog, more_sql
from .engine_rows import analysed, index, stage
from .engine_sql import CTES, chain
from .more_rows import given_vectors

BOTH = EngineConfig()
#: Dimensions asked for, more than the passages of a source.
FULL = 1024


def bm25_bounds(spark, sf_dir):
    """BM25 with postings left out by upper bounds."""
    sources, posts = catalog.indexed(spark, sf_dir)
    asked = catalog.questions(spark, sf_dir).select("qid", F.array("query").alias("all_queries"))
    found = ret.bm25_bounded(settle(ret.phrasings(asked)), posts, sources, ix.term_stats(posts, sources), impact_blocks(posts, sources), 10)
    return found.select("qid", "source", "chunk_id", F.round("score", 6).alias("score"), "rank")


@stage
def both_arms(spark, sf_dir):
    """The index with given vectors of the questions' terms and of all chunks, and the chunks' cells."""
    built = index(spark, sf_dir)
    vectors = packed(given_vectors(built, ret.phrasings(analysed(spark, sf_dir))))
    return replace(built, vectors=vectors, cells=build_cells(ix.chunk_vectors(built.chunks, vectors)))


def cell_lists(spark, sf_dir):
    """Dense search that visits only cells which can matter."""
    found = ret.dense(ret.phrasings(analysed(spark, sf_dir)), both_arms(spark, sf_dir), 10)
    return found.select("qid", "qi", "source", "chunk_id", F.round("score", 6).alias("score"), "rank")


@stage
def two_lists(spark, sf_dir):
    return ret.search_lists(analysed(spark, sf_dir), both_arms(spark, sf_dir), BOTH)


def two_arm_lists(spark, sf_dir):
    return two_lists(spark, sf_dir).select("arm", "qid", "qi", "source", "chunk_id", "rank", F.round("score", 6).alias("score"))


def two_arm_fused(spark, sf_dir):
    fused = ret.fuse(two_lists(spark, sf_dir), BOTH.get("retrieval.rrf_k"), BOTH.get("retrieval.query_analysis.expansion_weight"))
    parts = F.transform(F.array_sort(F.map_keys("components")), lambda k: F.concat(k, F.lit("="), F.format_string("%.4f", F.element_at("components", k))))
    return fused.select("qid", "source", "chunk_id", F.round("rrf", 9).alias("rrf"), "lists_matched", F.array_join(F.filter(parts, lambda p: p.contains("_rank")), "|").alias("ranks"))


def two_arm_stats(spark, sf_dir):
    """Hits by arm and the best score of each source, and the pool, with both arms on."""
    rows, hits = ret.retrieve(analysed(spark, sf_dir), both_arms(spark, sf_dir), BOTH)
    pool = rows.groupBy("qid", "source").agg(F.count("*").alias("pooled"))
    return hits.join(pool, ["qid", "source"], "left").select("qid", "source", "bm25_hits", "dense_hits", "fused", F.coalesce("pooled", F.lit(0)).cast("long").alias("pooled"))


# ---- the latent space ----


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spread(catalog.table(spark, sf_dir, "benchmark"))
    source = F.when(F.col("item_id") % 2 == 0, "docs").otherwise("blog")
    return b.select(source.alias("source"), F.col("item_id").cast("string").alias("chunk_id"), F.col("item_id").alias("doc_pos"), tx.tokenize(F.col("text")).alias("tokens"))


@stage
def space(spark, sf_dir):
    """(chunks, weights, vectors) of the passages at full rank."""
    rows = settle(passages(spark, sf_dir))
    weights = settle(ix.tfidf(ix.postings(rows), ix.source_stats(rows)))
    return rows, weights, settle(lsa(weights, FULL))


def lsa_spectrum(spark, sf_dir):
    """Of the singular values s, sum s^2 is that of the squared weights and sum s^4 that of the squared products of chunks. A term's vector is sqrt(s) v."""
    terms = space(spark, sf_dir)[2].where("kind = 'term'").select("source", F.posexplode("vector").alias("k", "x"))
    values = terms.groupBy("source", "k").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return values.groupBy("source").agg(F.round(F.sum(F.col("s") ** 2), 5).alias("squares"), F.round(F.sum(F.col("s") ** 4), 5).alias("fourths"))


def products(spark, sf_dir) -> DataFrame:
    """(source, chunk_id, term, p, length): products of chunk and term vectors for the terms of a chunk; over their length they are its weights."""
    _, weights, vectors = space(spark, sf_dir)
    side = lambda kind, key, name: vectors.where(F.col("kind") == kind).select("source", F.col("key").alias(key), F.col("vector").alias(name))
    met = weights.select("source", "chunk_id", "term").join(side("chunk", "chunk_id", "x"), ["source", "chunk_id"]).join(side("term", "term", "y"), ["source", "term"])
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    rows = met.select("source", "chunk_id", "term", dot.alias("p"))
    return rows.withColumn("length", F.sqrt(F.sum(F.col("p") * F.col("p")).over(Window.partitionBy("source", "chunk_id"))))


def lsa_weights(spark, sf_dir):
    """The weights of all terms of a chunk, from its coordinates and theirs."""
    return products(spark, sf_dir).select("source", "chunk_id", "term", F.round(F.col("p") / F.col("length"), 6).alias("w"))


def lsa_topk(spark, sf_dir):
    """The best passages of each question in the latent space: cosines by fold-in and cells; freed of the chunks' own lengths there and measured by the best, they are those of the weights."""
    rows, _, vectors = space(spark, sf_dir)
    built = replace(index(spark, sf_dir), chunks=rows, vectors=vectors, cells=build_cells(ix.chunk_vectors(rows, vectors)))
    asked = catalog.questions(spark, sf_dir).select("qid", F.array("query").alias("all_queries"))
    found = ret.dense(ret.phrasings(asked), built, 1 << 20)
    lengths = products(spark, sf_dir).groupBy("source", "chunk_id").agg(F.max("length").alias("length"))
    w = Window.partitionBy("qid", "source")
    part = found.join(lengths, ["source", "chunk_id"]).withColumn("part", F.col("score") / F.col("length")).withColumn("part", F.round(F.col("part") / F.max("part").over(w), 6))
    return part.withColumn("rank", F.row_number().over(w.orderBy(F.desc("part"), F.col("doc_pos")))).where("rank <= 5").select("qid", "source", "chunk_id", "part", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bm25_bounds, cell_lists, two_arm_lists, two_arm_fused, two_arm_stats, lsa_spectrum, lsa_weights, lsa_topk)}

# ---- SQL ----

_dense = lambda k: f"dhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qi, source ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS rank FROM sc WHERE score > 1e-6) WHERE rank <= {k})"
K = BOTH.get("retrieval.top_k_per_source")
TWO = f"{more_sql.DENSE}, {_dense(K)}, two AS (SELECT 'bm25' AS arm, qid, qi, source, chunk_id, rank, score FROM hits UNION ALL SELECT 'dense', qid, qi, source, chunk_id, rank, score FROM dhits)"


def two_chain(select: str) -> str:
    """``select`` over the stages up to the pool, with the lists of both arms fused."""
    names = list(CTES)
    parts = []
    for n in names[: names.index("pool") + 1]:
        body = CTES[n].replace("FROM hits GROUP BY ALL", "FROM two GROUP BY ALL") if n == "fused" else CTES[n]
        if n == "fused":
            parts.append(TWO)
        parts.append(f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({body})")
    return "WITH RECURSIVE " + ", ".join(parts) + " " + select


_passages = f"chunks AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'docs' ELSE 'blog' END AS source, CAST(item_id AS VARCHAR) AS chunk_id, item_id AS doc_pos, {catalog.tokens_sql('text')} AS tokens FROM benchmark)"
_weights = (
    f"WITH {_passages}, {catalog.POSTS}, {catalog.STATS}, d AS (SELECT source, term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM posts JOIN stats USING (source) GROUP BY source, term HAVING count(*) >= CASE WHEN any_value(n) > 4 THEN 2 ELSE 1 END), "
    "raw AS (SELECT source, chunk_id, term, (1 + ln(tf)) * idf AS raw FROM posts JOIN d USING (source, term)), w AS MATERIALIZED (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY source, chunk_id)) AS w FROM raw)"
)
ORACLES: dict[str, str] = {
    "bm25_bounds": catalog.ORACLES["bm25_topk"],
    "cell_lists": more_sql.ORACLES["dense_lists"],
    "two_arm_lists": chain("hits", f", {TWO} SELECT arm, qid, CAST(qi AS INTEGER) AS qi, source, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM two"),
    "two_arm_fused": chain("hits", f", {TWO} SELECT qid, source, chunk_id, round(sum(CASE WHEN qi = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END / (60 + rank)), 9) AS rrf, count(*) AS lists_matched, string_agg(arm || '_q' || qi || '_rank=' || format('{{:.4f}}', CAST(rank AS DOUBLE)), '|' ORDER BY arm || '_q' || qi || '_rank') AS ranks FROM two GROUP BY ALL"),
    "two_arm_stats": two_chain("SELECT h.qid, h.source, count(*) FILTER (arm = 'bm25') AS bm25_hits, count(*) FILTER (arm = 'dense') AS dense_hits, count(DISTINCT h.chunk_id) AS fused, (SELECT count(*) FROM pool p WHERE p.qid = h.qid AND p.source = h.source) AS pooled FROM two h GROUP BY h.qid, h.source"),
    "lsa_spectrum": f"{_weights}, g AS (SELECT a.source, sum(a.w * b.w) AS g FROM w a JOIN w b USING (source, term) GROUP BY a.source, a.chunk_id, b.chunk_id) SELECT source, round((SELECT sum(w * w) FROM w WHERE w.source = g.source), 5) AS squares, round(sum(g * g), 5) AS fourths FROM g GROUP BY source",
    "lsa_weights": f"{_weights} SELECT source, chunk_id, term, round(w, 6) AS w FROM w",
    "lsa_topk": f"{_weights}, {catalog.ASKED}, s AS (SELECT qid, w.source, w.chunk_id, sum((1 + ln(qtf)) * idf * w) AS s FROM asked JOIN d USING (term) JOIN w ON w.source = d.source AND w.term = asked.term GROUP BY ALL), r AS (SELECT *, round(s / max(s) OVER (PARTITION BY qid, source), 6) AS part FROM s) "
    "SELECT qid, source, chunk_id, part, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY part DESC, CAST(chunk_id AS BIGINT)) AS rank FROM r) WHERE rank <= 5",
}
