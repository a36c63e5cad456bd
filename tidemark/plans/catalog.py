"""Registered queries of the engine's operators over the driver's tables, with their SQL.

Documents are chunks with their language as the source, first sentences of benchmark
passages are questions. ``engine_rows`` and ``more_rows`` have the stages behind search,
the chunkers and the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import text as tx
from ..operators import index as ix
from ..operators import questions as rules
from ..operators.chunking import chunk
from ..operators.evaluation import nearest_ranks
from ..operators.questions import analyse
from ..operators.rerank import min_max
from ..operators.retrieval import bm25, fuse, phrasings
from ..session import packed, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"))
    return d.select(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("doc_pos"), "text", tx.tokenize(F.col("text")).alias("tokens"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.coalesce(F.try_element_at(tx.sentences(F.col("text")), F.lit(1)), F.lit("")).alias("query"))


def tokenize_tokens(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows.select(F.col("doc_pos").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources' statistics, postings), from one pass over the texts; the postings are written for the several uses of them."""
    rows = chunks(spark, sf_dir)
    posts = packed(ix.postings(rows.drop("tokens")))
    return packed(ix.source_stats_of(rows, posts)), posts


def term_freq(spark, sf_dir):
    return ix.postings(chunks(spark, sf_dir).drop("tokens")).groupBy("source", "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


def doc_freq_idf(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    # Written, so that Spark sees how few they are; a join by source would put all terms of one into one task.
    sources = packed(ix.source_stats(rows).select("source", "n"))
    return ix.term_stats(ix.postings(rows.drop("tokens")), sources).select("source", "term", "df", F.round("idf", 6).alias("idf"))


def source_stats(spark, sf_dir):
    return ix.source_stats(chunks(spark, sf_dir)).select("source", "n", F.round("avgdl", 6).alias("avgdl"))


def vocabulary(spark, sf_dir):
    return ix.vocabulary(ix.postings(chunks(spark, sf_dir).drop("tokens")))


def tfidf_top_terms(spark, sf_dir):
    sources, posts = indexed(spark, sf_dir)
    w = ix.tfidf(posts, sources)
    order = Window.partitionBy("source", "chunk_id").orderBy(F.desc(F.round("w", 9)), "term")
    return w.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("source", "chunk_id", "term", F.round("w", 6).alias("w"), "rank")


def searched(spark, sf_dir, k=10) -> DataFrame:
    """The search needs statistics of the asked terms alone, so no count of another term is shuffled. The terms are written, so that Spark knows how few they are."""
    sources, posts = indexed(spark, sf_dir)
    terms = packed(phrasings(questions(spark, sf_dir).select("qid", F.array("query").alias("all_queries"))))
    own = posts.join(terms.select("term").distinct(), "term", "left_semi")
    return bm25(terms, posts, sources, ix.term_stats(own, sources), k)


def bm25_topk(spark, sf_dir):
    return searched(spark, sf_dir).select("qid", "source", "chunk_id", F.round("score", 6).alias("score"), "rank")


def minmax_norm(spark, sf_dir):
    rows = searched(spark, sf_dir).withColumn("norm", min_max(F.round("score", 9), "qid"))
    return rows.select("qid", "source", "chunk_id", F.round("norm", 6).alias("norm"))


def rrf_fused(spark, sf_dir):
    """Two lists of each question and source: by BM25 and by the documents' order."""
    hits = searched(spark, sf_dir)
    by_id = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "source").orderBy("doc_pos")))
    lists = hits.withColumn("arm", F.lit("bm25")).unionByName(by_id.withColumn("arm", F.lit("dense")).withColumn("qi", F.lit(1)))
    return fuse(lists).select("qid", "source", "chunk_id", F.round("rrf", 9).alias("rrf"), "lists_matched")


def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def sentence_split(spark, sf_dir):
    s = tx.sentences(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


def slugify_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slugify(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("slug"))


def uniform_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("doc_id").alias("doc_pos"))
    rows = chunk(spread(d), "blog", EngineConfig().variant({"chunking.strategy": "uniform"}))
    return rows.select("chunk_id", F.col("window_index"), F.md5("display_text").alias("text_md5"))


def sliding_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("doc_id").alias("doc_pos"))
    return chunk(spread(d), "blog", EngineConfig()).select("chunk_id", "window_index", "window_count", "token_count")


def nearest_rank_percentile(spark, sf_dir):
    return nearest_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 50, "p95": 95})


def intent_classify(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(F.when(F.col("turn") % 4 == 0, "How do I ").when(F.col("turn") % 4 == 1, "Why does it fail ").when(F.col("turn") % 4 == 2, "Should I use retries or migrate v2.4 ").otherwise("How many "), "text").alias("query"))
    a = analyse(q, EngineConfig())
    return a.select("qid", "intent", "version_mentioned", "product_area", F.size("expanded_queries").cast("long").alias("n_expansions"))


def entities(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    from ..operators.questions import entities as found

    return q.select(F.col("qid").alias("doc_id"), F.array_join(found(F.col("query"), "product"), "|").alias("entities"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk, tokenize_tokens, term_freq, doc_freq_idf, source_stats, vocabulary, tfidf_top_terms, minmax_norm, rrf_fused, estimate_tokens, sentence_split, slugify_pages, uniform_chunks, sliding_windows,
        nearest_rank_percentile, intent_classify, entities,
    )
}

# ---- SQL ----

FOLDED = r"lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g'))"
STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 3 OR regexp_matches({t}, '[0-9._\\-/]') THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN left({t}, -3) || 'y' WHEN {t} LIKE '%sses' THEN left({t}, -2) "
        f"WHEN {t} LIKE '%ss' OR {t} LIKE '%us' OR {t} LIKE '%is' THEN {t} WHEN {t} LIKE '%s' THEN left({t}, -1) WHEN {t} LIKE '%ing' AND length({t}) > 6 THEN left({t}, -3) WHEN {t} LIKE '%ed' AND length({t}) > 5 THEN left({t}, -2) ELSE {t} END"
    )


def tokens_sql(x: str) -> str:
    version = r"'^v?[0-9]+(?:\.[0-9]+)*$'"
    parts = f"list_transform(list_filter(regexp_split_to_array(t, '[._\\-/]'), lambda p: length(p) >= 2 AND NOT list_contains({STOPS}, p) AND NOT regexp_matches(p, {version})), lambda p: {stem_sql('p')})"
    each = f"CASE WHEN list_contains({STOPS}, t) THEN []::VARCHAR[] WHEN regexp_matches(t, {version}) THEN [t] WHEN regexp_matches(t, '[._\\-/]') THEN list_concat([t], {parts}) ELSE [{stem_sql('t')}] END"
    return f"flatten(list_transform(regexp_extract_all({FOLDED.format(x=x)}, '[a-z0-9]+(?:[._\\-/][a-z0-9]+)*'), lambda t: {each}))"


def sentences_sql(x: str) -> str:
    cut = f"regexp_replace(trim({x}, ' \t\n\r'), '([.!?])\\s+([A-Z0-9])', concat('\\1', chr(1), '\\2'), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s, ' \t\n\r')), lambda s: length(s) > 0)"


CHUNKS = f"chunks AS (SELECT lang AS source, CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS doc_pos, {tokens_sql('text')} AS tokens FROM documents)"
POSTS = "posts AS (SELECT source, chunk_id, doc_pos, term, count(*) AS tf FROM (SELECT source, chunk_id, doc_pos, unnest(tokens) AS term FROM chunks) GROUP BY ALL)"
STATS = "stats AS (SELECT source, count(*) AS n, avg(len(tokens)) AS avgdl FROM chunks GROUP BY source)"
TERMS = "terms AS (SELECT p.source, p.term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts p JOIN stats USING (source) GROUP BY p.source, p.term)"
ASKED = f"asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tokens_sql('first')}) AS term FROM (SELECT item_id, trim(coalesce({sentences_sql('text')}[1], '')) AS first FROM benchmark)) GROUP BY ALL)"
HITS = (
    "scored AS (SELECT qid, p.source, p.chunk_id, p.doc_pos, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(c.tokens) / s.avgdl)) * a.qtf) AS score FROM asked a JOIN posts p USING (term) JOIN terms t ON t.source = p.source AND t.term = p.term JOIN chunks c ON c.chunk_id = p.chunk_id JOIN stats s ON s.source = p.source GROUP BY ALL), "
    "hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(score, 9) DESC, doc_pos, chunk_id) AS rank FROM scored) WHERE rank <= 10 AND score > 0)"
)
SEARCH = f"WITH {CHUNKS}, {POSTS}, {STATS}, {TERMS}, {ASKED}, {HITS}"

ORACLES: dict[str, str] = {
    "tokenize_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "term_freq": f"WITH {CHUNKS}, {POSTS} SELECT source, term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, max(tf) AS max_tf FROM posts GROUP BY source, term",
    "doc_freq_idf": f"WITH {CHUNKS}, {POSTS}, {STATS}, {TERMS} SELECT source, term, df, round(idf, 6) AS idf FROM terms",
    "source_stats": f"WITH {CHUNKS}, {STATS} SELECT source, n, round(avgdl, 6) AS avgdl FROM stats",
    "vocabulary": f"WITH {CHUNKS}, {POSTS} SELECT term, count(*) AS df FROM posts GROUP BY term",
    "tfidf_top_terms": f"WITH {CHUNKS}, {POSTS}, {STATS}, d AS (SELECT source, term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM posts JOIN stats USING (source) GROUP BY source, term HAVING count(*) >= CASE WHEN any_value(n) > 4 THEN 2 ELSE 1 END), "
    "raw AS (SELECT source, chunk_id, term, (1 + ln(tf)) * idf AS raw FROM posts JOIN d USING (source, term)), w AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY source, chunk_id)) AS w FROM raw) "
    "SELECT source, chunk_id, term, round(w, 6) AS w, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, chunk_id ORDER BY round(w, 9) DESC, term) AS INTEGER) AS rank FROM w) WHERE rank <= 3",
    "bm25_topk": f"{SEARCH} SELECT qid, source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
    "minmax_norm": f"{SEARCH}, r AS (SELECT qid, source, chunk_id, round(score, 9) AS s FROM hits), w AS (SELECT *, min(s) OVER (PARTITION BY qid) AS lo, max(s) OVER (PARTITION BY qid) AS hi FROM r) SELECT qid, source, chunk_id, round(CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (s - lo) / (hi - lo) END, 6) AS norm FROM w",
    "rrf_fused": f"{SEARCH}, two AS (SELECT qid, source, chunk_id, rank, 1.0 AS w FROM hits UNION ALL SELECT qid, source, chunk_id, row_number() OVER (PARTITION BY qid, source ORDER BY doc_pos), 0.35 FROM hits) SELECT qid, source, chunk_id, round(CAST(sum(CAST(w AS DOUBLE) / (60 + rank)) AS DOUBLE), 9) AS rrf, count(*) AS lists_matched FROM two GROUP BY ALL",
    "estimate_tokens": "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(greatest(length(text) / 4.0::DOUBLE, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 0)) * 1.3::DOUBLE), 0)) END AS BIGINT) AS tokens FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)",
    "slugify_pages": f"WITH s AS (SELECT page_id, regexp_replace(regexp_replace({FOLDED.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM pages) SELECT page_id, CASE WHEN length(g) <= 60 THEN g WHEN length(regexp_replace(left(g, 60), '-[^-]*$', '')) > 0 THEN regexp_replace(left(g, 60), '-[^-]*$', '') ELSE left(g, 60) END AS slug FROM s",
    "uniform_chunks": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(source || chr(10) || chr(10) || text, '\\s+'), lambda x: length(x) > 0) AS w FROM documents), i AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 769) / 616.0) AS BIGINT)))) AS k FROM w) SELECT 'blog:' || doc_id || ':u' || k AS chunk_id, k AS window_index, md5(array_to_string(list_slice(w, k * 616 + 1, k * 616 + 769), ' ')) AS text_md5 FROM i",
    "nearest_rank_percentile": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[least(len(v), CAST(floor(len(v) * 50 / 100.0) AS BIGINT) + 1)] AS p50, v[least(len(v), CAST(floor(len(v) * 95 / 100.0) AS BIGINT) + 1)] AS p95 FROM s",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def intent_sql() -> str:
    """The rules of question analysis as SQL, for the catalog's questions and the brand "product"."""
    own = lambda p: p.replace("{brand}", "product")
    kinds = " ".join(f"WHEN regexp_matches(l, {quoted('|'.join(f'(?:{own(p)})' for p in patterns))}) THEN '{name}'" for name, patterns in rules.INTENTS.items())
    scores = ", ".join(f"{{'n': {' + '.join(f'CAST(contains(l, {quoted(own(w))}) AS INTEGER)' for w in words)}, 'i': {-i}, 'area': '{area}'}}" for i, (area, words) in enumerate(rules.AREAS.items()))
    synonym = " OR ".join(f"contains(l, {quoted(needle)})" for needle, _ in rules.SYNONYMS)
    begin = "CASE turn % 4 WHEN 0 THEN 'How do I ' WHEN 1 THEN 'Why does it fail ' WHEN 2 THEN 'Should I use retries or migrate v2.4 ' ELSE 'How many ' END"
    version = r"'(?i)\bv?([23])\.(\d+)(?:\.\d+)?\b'"
    return (
        f"WITH q AS (SELECT conv_id || '-' || turn AS qid, {begin} || text AS query, lower({begin} || text) AS l FROM conversations), "
        f"a AS (SELECT *, list_max([{scores}]) AS best, regexp_extract(query, {version}, 1) AS major FROM q) "
        f"SELECT qid, CASE {kinds} ELSE 'unknown' END AS intent, CASE WHEN major <> '' THEN major || '.' || regexp_extract(query, {version}, 2) END AS version_mentioned, "
        f"CASE WHEN best.n > 0 THEN best.area END AS product_area, CAST(CAST({synonym} AS INTEGER) + CAST(best.n > 0 AS INTEGER) AS BIGINT) AS n_expansions FROM a"
    )


def entities_sql() -> str:
    plain = "[" + ", ".join(quoted(w.replace("{brand}", "product")) for w in rules.NO_ENTITIES) + "]"
    keep = f"NOT list_contains({plain}, lower(t)) AND (regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '[_.\\-]') OR regexp_matches(t, '^.+[A-Z]'))"
    return (
        f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._\\-]*'), lambda t: {keep}) AS l FROM documents), u AS (SELECT doc_id, l, list_transform(l, lambda x: lower(x)) AS k FROM t) "
        "SELECT doc_id, coalesce(array_to_string(list_slice(list_filter(l, lambda x, i: list_position(k, lower(x)) = i), 1, 8), '|'), '') AS entities FROM u"
    )


ORACLES |= {"intent_classify": intent_sql(), "entities": entities_sql()}
