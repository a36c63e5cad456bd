"""Scans of the three text sources, the gold set and traces; sinks for chunks and traces (SRC, SNK)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import place_in_group

#: Names that a warning shows.
SHOWN = 5
POSTS = "array<struct<post_id: string, author_role: string, author: string, created_at: string, votes: bigint, is_accepted: boolean, parent_post_id: string, body: string>>"
THREADS = f"threads array<struct<thread_id: string, title: string, tags: array<string>, product_version_mentioned: string, status: string, views: bigint, created_at: string, posts: {POSTS}>>"
ARTICLES = "posts array<struct<post_id: string, title: string, author: string, author_role: string, published_at: string, product_version_at_time: string, tags: array<string>, url: string, body: string>>"
FRONT = "doc_id string, title string, doc_type string, version string, product_area string, last_updated string, canonical boolean, url string, tags array<string>"
FENCE = r"(?s)^\s*---[^\n]*\n(.*?)\n---[^\n]*(?:\n+|$)"


def parse_frontmatter(rows: DataFrame, text: str = "text") -> DataFrame:
    """SRC-1: adds ``meta`` (null unless the block between the marks is a JSON object) and ``body``."""
    block = F.regexp_extract(F.col(text), FENCE, 1)
    rest = F.regexp_replace(F.regexp_replace(F.col(text), FENCE, ""), r"^\n+", "")
    meta = F.when(F.expr(f"try_parse_json(regexp_extract({text}, '{FENCE.replace(chr(92), chr(92) * 2)}', 1))").isNotNull() & block.rlike(r"^\s*\{"), F.from_json(block, FRONT))
    return rows.withColumn("meta", meta).withColumn("body", F.when(F.col("meta").isNotNull(), rest).otherwise(F.col(text)))


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2: markdown pages, ordered by file name; a missing folder raises."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_file"))
    rows = parse_frontmatter(files)
    stem = F.regexp_replace("source_file", r"\.md$", "")
    doc_id = F.coalesce(F.nullif(F.col("meta.doc_id"), F.lit("")), stem)
    kept = [F.col(f"meta.{c}").alias(c) for c in ("doc_type", "version", "product_area", "last_updated", "canonical", "url", "tags")]
    title = F.coalesce(F.nullif(F.col("meta.title"), F.lit("")), F.initcap(F.replace(doc_id, F.lit("-"), F.lit(" "))))
    return numbered(rows.select(doc_id.alias("doc_id"), title.alias("title"), "body", "source_file", *kept), "source_file")


def read_forum(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: threads with their posts; the body is the opening post's."""
    threads = spark.read.schema(THREADS).json(path, multiLine=True).select(F.posexplode("threads").alias("at", "t")).select("at", "t.*")
    opening = F.coalesce(F.try_element_at(F.filter("posts", lambda p: p["parent_post_id"].isNull()), F.lit(1)), F.try_element_at("posts", F.lit(1)))
    return numbered(threads.withColumn("body", F.coalesce(opening["body"], F.lit(""))).withColumnRenamed("thread_id", "doc_id"), "at").drop("at")


def read_blog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: articles."""
    posts = spark.read.schema(ARTICLES).json(path, multiLine=True).select(F.posexplode("posts").alias("at", "p")).select("at", "p.*")
    return warn_undated(numbered(posts.withColumnRenamed("post_id", "doc_id"), "at").drop("at"))


def warn_undated(articles: DataFrame) -> DataFrame:
    """SRC-4: ``articles``, with a warning that names the first of those without a date."""
    names = [r.doc_id for r in undated(articles).limit(SHOWN).collect()]
    if names:
        warnings.warn(f"articles without published_at, the first of them: {names}", stacklevel=2)
    return articles


def undated(articles: DataFrame) -> DataFrame:
    """SRC-4's check: articles without a date."""
    return articles.where(F.coalesce(F.col("published_at"), F.lit("")) == "").select("doc_id")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``doc_pos`` (0, 1, ...) in the order of the columns. No task holds all rows: they are dealt by ranges, and only the ranges are summed up."""
    return place_in_group(rows.withColumn("_all", F.lit(0)), ["_all"], list(order)).withColumnRenamed("place", "doc_pos").drop("n", "_all")


def read_corpus(spark: SparkSession, docs: str, forum: str, blog: str) -> dict[str, DataFrame]:
    """SRC-5."""
    return {"docs": read_docs(spark, docs), "forum": read_forum(spark, forum), "blog": read_blog(spark, blog)}


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: a YAML gold set."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = (yaml.safe_load(f) or {}).get("queries", [])
    rows = [
        (str(q["qid"]), str(q["query"]), str(q.get("intent", "unknown")), [(str(r["id"]), int(r["grade"])) for r in q.get("relevant") or []], list(q.get("expected_sources") or []), q.get("expects_conflict"), bool(q.get("expects_refusal")), bool(q.get("expects_no_conflict")), list(q.get("answer_must_contain") or []), list(q.get("answer_must_not_contain") or []))
        for q in items
    ]
    return spark.createDataFrame(rows, "qid string, query string, intent string, relevant array<struct<label: string, grade: int>>, expected_sources array<string>, expects_conflict string, expects_refusal boolean, expects_no_conflict boolean, must_contain array<string>, must_not_contain array<string>")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """SNK-1: a JSON line for each chunk, by source and place."""
    from ..operators.chunking import version_of

    out = chunks.select("chunk_id", "source", F.col("token_count").alias("tokens"), "context_header", "parent_id", "chunker", version_of().alias("version"), "display_text", F.array_position(F.array(*map(F.lit, ("docs", "forum", "blog"))), F.col("source")).alias("_s"), "doc_pos")
    out.repartitionByRange("_s", "doc_pos").sortWithinPartitions("_s", "doc_pos").drop("_s", "doc_pos").write.mode("overwrite").json(path)


def append_traces(traces: DataFrame, path: str) -> None:
    """SNK-2."""
    traces.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, last: int = 20, contains: str | None = None) -> DataFrame:
    """SRC-8: the last traces, newest first, with the needle in their question."""
    rows = spark.read.json(path)
    if contains:
        rows = rows.where(F.contains(F.lower("query"), F.lit(contains.lower())))
    return rows.orderBy(F.desc("timestamp"), F.desc("trace_id")).limit(last)
