"""Registered queries of text functions, chunkers by source, scans, sinks and dense search, on tables derived from the driver's."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..operators import retrieval as ret
from ..operators.chunking import chunk
from ..session import shared_dir, spread
from ..sources import corpus
from .catalog import table
from .engine_rows import analysed, index, pick

UNITS = ("KiB", "kb", "MiB", "mb", "bytes", "")
GREETINGS = ("hi there", "Thanks, you are great!", "hello, how is retries", "", "ok ok ok ok ok ok ok", "Good MORNING")
DATES = ("2024-02-30", "2024-02-29T10:00:00Z", "x", "2023-13-01", "2025-01-31 later", "")
VERSIONS = ("2.4.x", "3.10.1", None, "v3", "2..5", "")
DIMS = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")))


def text_forms(spark, sf_dir):
    """Quotes, blocks and fences."""
    d = documents(spark, sf_dir)
    quoted = F.concat(F.lit("> said\n"), "text", F.lit("\n\n\n\n> more\nend"))
    blocks = F.concat(F.lit("## Head\n"), "text", F.lit(" ```code\nblock``` and `inline` end"))
    fences = F.concat(F.lit("a\n```\nb\n~~~\n"), "text", F.lit("\n  ```\nz"))
    mask = F.transform(tx.fenced_lines(fences), lambda x: x.cast("int").cast("string"))
    return d.select("doc_id", F.md5(tx.strip_quotes(quoted)).alias("unquoted"), F.md5(tx.strip_blocks(blocks)).alias("plain"), F.array_join(mask, "").alias("fenced"))


def text_values(spark, sf_dir):
    """Sizes, greetings, dates, versions, likeness and free names (for the digits of the text's hash, which repeat)."""
    d = documents(spark, sf_dir)
    # Values of whole texts that are used again and again are columns first, so each is computed once for a row.
    d = d.select("doc_id", F.array_distinct(tx.tokenize(F.col("text"))).alias("tokens"), F.array_distinct(tx.tokenize(F.coalesce(F.try_element_at(tx.sentences(F.col("text")), F.lit(1)), F.lit("")))).alias("first"), F.md5("text").alias("text_md5"), F.md5("source").alias("source_md5"))
    d = d.select("*", F.split("text_md5", "").alias("letters"), digits("text_md5").alias("x"), digits("source_md5").alias("y"))
    i = F.col("doc_id")
    size = F.when(i % 7 == 0, F.lit("no size")).otherwise(F.concat((i * 37 % 2000).cast("string"), F.when(i % 2 == 0, F.lit(".5 ")).otherwise(F.lit(",000")), pick(UNITS, i % len(UNITS))))
    parts = F.array_join(F.transform(tx.version_parts(pick(VERSIONS, i % len(VERSIONS))), lambda p: p.cast("string")), "|")
    return d.select(
        "doc_id", tx.size_in_bytes(size).alias("bytes"), tx.is_small_talk(pick(GREETINGS, i % len(GREETINGS))).alias("greeting"), tx.iso_date(pick(DATES, i % len(DATES))).cast("string").alias("day"), parts.alias("parts"),
        F.round(tx.jaccard(F.col("tokens"), F.col("first")), 6).alias("likeness"), F.round(tx.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.array_join(tx.dedupe_slugs(F.col("letters")), "|").alias("names"),
    )


def with_body(spark, sf_dir, body: F.Column) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("s", tx.sentences(F.col("text")))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.lit("guide").alias("doc_type"), F.lit("3.1").alias("version"), F.col("doc_id").alias("doc_pos"), body.alias("body"))


def docs_sections(spark, sf_dir):
    """A page's headings, fences and parents; sections are not merged or split."""
    first = F.coalesce(F.try_element_at("s", F.lit(1)), F.lit("none"))
    body = F.concat(F.lit("intro\n# Page\nlead\n## Part one\n"), F.concat_ws(" ", F.lit("One"), F.array_join("s", " ")), F.lit("\n### Sub\n```\n# no heading\n```\n## Part one\n"), first, F.lit("\n## Empty\n\n## Last ##\nend"))
    rows = chunk(with_body(spark, sf_dir, body), "docs", EngineConfig().variant({"chunking.docs.min_tokens": 0, "chunking.docs.max_tokens": 1 << 30}))
    return rows.select("chunk_id", "context_header", "parent_id", "section_title", F.array_join("section_path", "/").alias("path"), "heading_level", F.md5("display_text").alias("text_md5"))


def merged_sections(spark, sf_dir):
    """Sections of three sentences; small ones join the one before."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("s") / 3).cast("int")), lambda k: F.concat(F.lit("## S"), k.cast("string"), F.lit("\n"), F.array_join(F.slice("s", k * 3 + 1, 3), " ")))
    rows = chunk(with_body(spark, sf_dir, F.array_join(parts, "\n")), "docs", EngineConfig().variant({"chunking.docs.max_tokens": 1 << 30}))
    return rows.select("chunk_id", "section_title", F.md5("display_text").alias("text_md5"))


def split_sections(spark, sf_dir):
    """One section with a paragraph for each sentence, cut into pieces that share a sentence."""
    rows = chunk(with_body(spark, sf_dir, F.concat(F.lit("## P\n"), F.array_join("s", "\n\n"))), "docs", EngineConfig().variant({"chunking.docs.min_tokens": 0, "chunking.docs.max_tokens": 200}))
    return rows.select("chunk_id", F.md5("display_text").alias("text_md5"))


def semantic_windows(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("doc_id").alias("doc_pos"))
    rows = chunk(d, "blog", EngineConfig().variant({"chunking.blog.semantic_split": True, "chunking.blog.window_tokens": 150}))
    return rows.select("chunk_id", "window_index", "window_count", F.md5("display_text").alias("text_md5"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: the first turn asks, the assistant's turns answer it, users' turns reply to the turn before."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    post = F.struct(
        F.concat(F.lit("p"), t.cast("string")).alias("post_id"), F.when(t % 5 == 1, "staff").when(t % 5 == 2, None).otherwise("user").alias("author_role"), F.concat(F.lit("a"), t.cast("string")).alias("author"), F.lit("2024-05-01").alias("created_at"),
        ((F.length("text") + t) % 6).cast("long").alias("votes"), (t % 7 == 3).alias("is_accepted"), F.when(t == 0, None).when(F.col("role") == "assistant", "p0").otherwise(F.concat(F.lit("p"), (t - 1).cast("string"))).alias("parent_post_id"), F.concat(F.lit("> quoted\n"), F.coalesce("text", F.lit(""))).alias("body"),
    )
    posts = F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))), lambda x: x["post"])
    return c.groupBy("conv_id").agg(posts.alias("posts")).select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("title"), F.lit("solved").alias("status"), F.lit("2.4").alias("product_version_mentioned"), F.col("conv_id").alias("doc_pos"), "posts")


def thread_answers(spark, sf_dir):
    rows = chunk(threads(spark, sf_dir), "forum", EngineConfig())
    return rows.select("chunk_id", "parent_id", "context_header", "author_role", "votes", "is_accepted", "corroborating_followups", F.coalesce("unanswered", F.lit(False)).alias("unanswered"), F.md5("display_text").alias("text_md5"))


def fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"


def frontmatter(spark, sf_dir):
    """Pages with a block of JSON, with another block, and without."""
    i = F.col("doc_id")
    meta = F.concat(F.lit('{"title": "T'), i.cast("string"), F.lit('", "version": "3.1", "canonical": true, "tags": ["a", "b"]}'))
    head = F.when(i % 3 == 0, F.concat(F.lit("---\n"), meta, F.lit("\n---\n\n"))).when(i % 3 == 1, F.lit("---\nnot: json\n---\n")).otherwise("")
    rows = corpus.parse_frontmatter(documents(spark, sf_dir).select("doc_id", F.concat(head, F.lit("Body "), "text").alias("text")))
    return rows.select("doc_id", F.col("meta.title").alias("title"), F.col("meta.version").alias("version"), F.col("meta.canonical").alias("canonical"), F.size("meta.tags").cast("long").alias("tags"), F.md5("body").alias("body_md5"))


def written(rows: DataFrame, name: str, item: F.Column) -> str:
    """Rows as JSON files of one object each, whose list ``name`` holds up to a few hundred items."""
    path = fresh(rows.sparkSession)
    parts = rows.groupBy(F.floor(F.col("doc_pos") / 200).alias("part")).agg(F.collect_list(item).alias(name))
    parts.select(F.to_json(F.struct(name)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def forum_scan(spark, sf_dir):
    path = written(threads(spark, sf_dir), "threads", F.struct(F.col("doc_id").alias("thread_id"), "title", "status", "posts"))
    return corpus.read_forum(spark, path).select("doc_id", "title", "status", F.size("posts").cast("long").alias("posts"), F.md5("body").alias("body_md5"))


def blog_scan(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("doc_pos", F.col("doc_id"))
    post = F.struct(F.col("doc_id").cast("string").alias("post_id"), F.concat(F.lit("Post "), F.col("doc_id").cast("string")).alias("title"), F.lit("2024-01-05").alias("published_at"), F.col("text").alias("body"))
    return corpus.read_blog(spark, written(d, "posts", post)).select("doc_id", "title", "published_at", F.md5("body").alias("body_md5"))


def numbered_rows(spark, sf_dir):
    """Places in the order of the text, as scans number their files."""
    rows = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("name"))
    return corpus.numbered(rows, "name", "doc_id").select("doc_id", "doc_pos")


def chunk_dump(spark, sf_dir):
    """Chunks written and read back."""
    path = fresh(spark)
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("doc_id").alias("doc_pos"))
    corpus.write_chunks(chunk(d, "blog", EngineConfig().variant({"chunking.strategy": "uniform"})), path)
    return spark.read.json(path).select("chunk_id", "source", "parent_id", "chunker", F.md5("display_text").alias("text_md5"))


def trace_log(spark, sf_dir):
    """Traces appended twice; the last twenty about a word."""
    path = fresh(spark)
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("trace_id"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("item_id") % 60).cast("string"), 2, "0")).alias("timestamp"), F.when(F.col("item_id") % 2 == 0, "About RETRIES").otherwise("Else").alias("query"))
    corpus.append_traces(b.where("trace_id < 't000020'"), path)
    corpus.append_traces(b.where("trace_id >= 't000020'"), path)
    return corpus.read_traces(spark, path, 20, "retries").select("trace_id", "timestamp", "query")


def digits(md5: str) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.lit(DIMS)), lambda i: F.conv(F.substring(F.col(md5), i, F.lit(1)), 16, 10).cast("double") - 7.5)


def hexes(name: str) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.lit(DIMS)), lambda i: F.conv(F.substring(F.md5(F.col(name)), i, F.lit(1)), 16, 10).cast("double") - 7.5)


def given_vectors(built, asked: DataFrame) -> DataFrame:
    """Vectors of an index's chunks and of those of its terms that ``asked`` has, by digits of their hashes."""
    terms = built.stats_of(asked).select("source", F.lit("term").alias("kind"), F.col("term").alias("key"), hexes("term").alias("vector"), (1 + F.length("term") / 10).alias("idf"))
    chunks = built.chunks.select("source", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), hexes("chunk_id").alias("vector"), F.lit(None).cast("double").alias("idf"))
    return terms.unionByName(chunks)


def dense_lists(spark, sf_dir):
    """Fold-in and dense search over given vectors of the terms asked and of all chunks."""
    built = index(spark, sf_dir)
    terms = ret.phrasings(analysed(spark, sf_dir))
    found = ret.dense(terms, replace(built, vectors=given_vectors(built, terms)), 10)
    return found.select("qid", "qi", "source", "chunk_id", F.round("score", 6).alias("score"), "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (text_forms, text_values, docs_sections, merged_sections, split_sections, semantic_windows, thread_answers, frontmatter, forum_scan, blog_scan, numbered_rows, chunk_dump, trace_log, dense_lists)
}

