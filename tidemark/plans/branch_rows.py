"""Registered queries that reach every claim, rule and text that the other queries' data leave out, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..operators import answers as gen
from ..operators import conflicts as con
from ..operators import evaluation as evl
from ..operators.chunking import chunk
from ..streaming.traces import closed_counts
from . import engine_rows as rows
from .catalog import quoted, sentences_sql, table
from .engine_rows import CONFIG, pick
from .engine_sql import ORACLES as ENGINE
from .engine_sql import chain, claim_sql, options
from .more_rows import fresh
from .more_sql import tokens_of

BRAND = CONFIG.get("brand")
#: A sentence for each pattern of the claims, one beside it that no pattern takes, and line ends.
CLAIMED = (
    "max_retries defaults to **7** now.", "It defaults to 4 retry attempts.", "The default max_retries rose from 3 to 6.", "v3 default of 9 retries.", "Payloads at 256 KiB go.", "At most 1,024 KB fit.", "It caps job payloads at 2.5 MB.", "The 512 KiB limit holds.",
    "A visibility timeout, 30 seconds by default.", "The default visibility timeout is 45 seconds.", "visibility timeout of 60 seconds by default", "It hides for 90 seconds by default, the visibility of a job.", "It runs 90 seconds by default. Its visibility is low.", "The visibility timeout was dropped from 120s to 20 seconds.",
    f"Send X-{BRAND}-Key.", f"Send Authorization: {BRAND} abc.", f"X-{BRAND}-Keys are no claim.", "timeout=0 does NOT disable it.", "timeout=0 means fail-fast", "`timeout=0` disables the timeout.", "Set timeout=0 to turn it off.",
    "Jobs are never replayed automatically.", "There is no automatic replay.", "Replay is manual.", "It replays automatically.", "It sweeps and replays automatically.", "The CLI works on Windows.", "Windows is a fully supported platform.", "The CLI is broken on Windows.", "It is completely unusable on Windows.", "credential_store_unreadable",
    "`--legacy-ack` flag has been **removed**.", "--legacy-ack was removed.", "| `--legacy-ack` | yes |", "run with --legacy-ack", "client.enqueue() is the supported way.", "Use `client.enqueue()`.", "use push in a loop", "push is the enqueue call.",
    "By default, run **8** concurrent handlers by default.", "Concurrency defaults to the host's CPU count.", "Agent concurrency defaults to the host CPU count.", "Defaults to 16.", "The SDK honours `Retry-After`.", "It honours the Retry-After header.", "It now honours the `Retry-After`.",
    "It parses `Retry-After` and then discards it.", "It is not being read.", "It did not respect Retry-After.", "It computed backoff without consulting Retry-After.", "", "No claim at all.",
)
RELATIONSHIPS = ("contradict", "version_drift", "conditional", "deprecation", "misconception", "docs_drift", "docs_gap", "empirical_override", "complementary", "unheard of")
SIDES = ("docs", "forum", "blog")
PARTS = ((2, 4), (3, 0), (3, 2), ())
SAMPLES = 500


def claims_everywhere(spark, sf_dir):
    """Every pattern of every attribute, alone and beside another one, at the end of the text and before more of it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.coalesce(F.try_element_at(tx.sentences(F.col("text")), F.lit(1)), F.lit(""))
    i = F.col("doc_id")
    shown = F.when(i % 3 == 0, pick(CLAIMED, i % len(CLAIMED))).when(i % 3 == 1, F.concat(pick(CLAIMED, i % len(CLAIMED)), F.lit(" "), first)).otherwise(F.concat(first, F.lit(" "), pick(CLAIMED, (i * 7) % len(CLAIMED)), F.lit(" "), pick(CLAIMED, i % len(CLAIMED))))
    return con.claims(d.select("doc_id", shown.alias("display_text")), BRAND).select("doc_id", "attribute", "value", F.md5("evidence").alias("evidence_md5"))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conflict of each document: relationships, sources, ranks, versions and days by its id."""
    i = F.col("doc_id")
    parts = F.array(*[F.array(*map(F.lit, p)).cast("array<int>") for p in PARTS])
    k = lambda n, m: (F.floor(i / n) % m).cast("int")
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("qid"), F.lit(1).alias("finding"), pick(RELATIONSHIPS, i % len(RELATIONSHIPS)).alias("relationship"), F.lit("a").alias("chunk_id_a"), F.lit("b").alias("chunk_id_b"), pick(SIDES, k(2, 3)).alias("source_a"), pick(SIDES, k(5, 3)).alias("source_b"),
        k(3, 4).alias("authority_rank_a"), k(7, 4).alias("authority_rank_b"), parts[k(11, 4)].alias("version_parts_a"), parts[k(13, 4)].alias("version_parts_b"), k(2, 5).alias("day_a"), k(3, 5).alias("day_b"),
    )


def rule_cascade(spark, sf_dir):
    """Each relationship under each order of sources, authorities, versions and days: all eight rules, under two precedences."""
    turned = ["recency_within_tier", "source_authority", "empirical_override", "explicit_deprecation"]
    one = con.resolve(sides(spark, sf_dir), CONFIG).withColumn("order", F.lit("given"))
    two = con.resolve(sides(spark, sf_dir), CONFIG.variant({"contradiction.precedence": turned, "contradiction.disclosure.always_disclose_unresolved": False})).withColumn("order", F.lit("turned"))
    return one.unionByName(two).select("order", "qid", "rule_fired", "winner", "loser", "must_disclose", F.md5("explanation").alias("explanation_md5"))


def refusal_texts(spark, sf_dir):
    """The whole answers to questions that are refused."""
    return rows.answered(spark, sf_dir).select("qid", F.when(F.col("refused"), F.col("text")).alias("refusal"), F.size("citations").cast("long").alias("cited"))


def long_questions(spark, sf_dir):
    """Threads whose first post is a whole document: questions are cut to whole sentences within their limit, or to 600 characters of a sentence that is longer."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    post = lambda name, parent, body: F.struct(F.lit(name).alias("post_id"), F.lit("staff").alias("author_role"), none.alias("author"), none.alias("created_at"), F.lit(9).cast("long").alias("votes"), F.lit(True).alias("is_accepted"), parent.alias("parent_post_id"), body.alias("body"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("word "), 300), F.lit("end. Next."))).otherwise(F.col("text"))
    threads = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("T").alias("title"), F.col("doc_id").alias("doc_pos"), F.array(post("p1", none, body), post("p2", F.lit("p1"), F.lit("Yes."))).alias("posts"))
    return chunk(threads, "forum", EngineConfig()).select("chunk_id", F.md5("display_text").alias("text_md5"), F.length("display_text").cast("long").alias("chars"))


def bootstrap_interval(spark, sf_dir):
    """The interval of ndcg10 and of the pool's recall over the questions."""
    found = rows.ranking_quality(spark, sf_dir)
    one = lambda metric: evl.bootstrap_interval(found, metric, SAMPLES).select(F.lit(metric).alias("metric"), *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])
    return one("ndcg10").unionByName(one("recall20_pool"))


def trace_records(spark, sf_dir):
    """The traces of the batch, without ids and times."""
    pool, hits = rows.retrieved(spark, sf_dir)
    made = evl.traces(rows.analysed(spark, sf_dir), pool, hits, evl_stats(spark, sf_dir), rows.final(spark, sf_dir), rows.found(spark, sf_dir), rows.resolved(spark, sf_dir), rows.answered(spark, sf_dir))
    return made.select(
        F.md5("query").alias("query_md5"), F.col("analysis.intent").alias("intent"), F.col("retrieval.candidates_considered").alias("candidates"), F.size(F.coalesce("final_chunks", F.array())).cast("long").alias("chosen"),
        F.try_element_at("final_chunks", F.lit(1))["chunk_id"].alias("first"), F.when(F.col("conflicts").isNull(), 0).otherwise(F.size("conflicts")).cast("long").alias("conflicts"), "refused", F.size("citations").cast("long").alias("cited"),
    )


def stream_counts(spark, sf_dir):
    """Events as traces that come in two parts, the second after a restart: counts of the days that are closed."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").cast("string").alias("trace_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("q").alias("query"), F.coalesce(F.col("value") < 50, F.lit(False)).alias("refused"), F.struct(F.col("event_type").alias("intent")).alias("analysis"))
    half = F.lit("2024-01-15 00:00:00").cast("timestamp")
    path = fresh(spark)
    for part in (F.col("timestamp") < half, F.col("timestamp") >= half):
        log.where(part).write.mode("append").json(f"{path}/log")
        closed_counts(spark, f"{path}/log", f"{path}/counts", f"{path}/place", "1 day", "2 days")
    return spark.read.parquet(f"{path}/counts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "intent", "questions", "refused")


def evl_stats(spark, sf_dir) -> DataFrame:
    from ..operators.rerank import statistics

    return statistics(rows.blended(spark, sf_dir), CONFIG)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (claims_everywhere, rule_cascade, refusal_texts, long_questions, bootstrap_interval, trace_records, stream_counts)}

# ---- SQL ----

_n = len(CLAIMED)
_first = f"coalesce({sentences_sql('text')}[1], '')"
_ = lambda n, m: f"(doc_id // {n}) % {m}"
_parts = "[" + ", ".join("[" + ", ".join(map(str, p)) + "]::INTEGER[]" for p in PARTS) + "]"
_sides = (
    f"s AS (SELECT CAST(doc_id AS VARCHAR) AS qid, {options(RELATIONSHIPS, f'doc_id % {len(RELATIONSHIPS)}')} AS rel, {options(SIDES, _(2, 3))} = 'docs' AS docs_a, {options(SIDES, _(5, 3))} = 'docs' AS docs_b, {_(3, 4)} AS ra, {_(7, 4)} AS rb, {_parts}[{_(11, 4)} + 1] AS va, {_parts}[{_(13, 4)} + 1] AS vb, {_(2, 5)} AS da, {_(3, 5)} AS db FROM documents), "
    "t AS (SELECT *, CASE WHEN va <> vb THEN va > vb ELSE da >= db END AS newer FROM s), u AS (SELECT *, CASE WHEN ra <> rb THEN ra < rb ELSE newer END AS stronger FROM t)"
)
_text = "CASE rule " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in con.EXPLAINED.items()) + " END"


def _cascade(order: str, unresolved: str, rules: str) -> str:
    return (
        f"SELECT '{order}' AS \"order\", qid, rule AS rule_fired, CASE rule WHEN 'complementary_scope' THEN 'both' WHEN 'version_scoping' THEN 'both' WHEN 'empirical_override' THEN 'disclose_both' WHEN 'unresolved' THEN 'unresolved' ELSE CASE WHEN a_wins THEN 'a' ELSE 'b' END END AS winner, "
        f"CASE WHEN rule IN ('explicit_deprecation', 'authority_canonical', 'recency_within_tier') THEN CASE WHEN a_wins THEN 'b' ELSE 'a' END END AS loser, CASE rule WHEN 'complementary_scope' THEN false WHEN 'unresolved' THEN {unresolved} ELSE true END AS must_disclose, md5({_text}) AS explanation_md5 "
        f"FROM (SELECT *, CASE rule WHEN 'explicit_deprecation' THEN CASE WHEN docs_a THEN true WHEN docs_b THEN false ELSE stronger END WHEN 'docs_gap_staff_authority' THEN NOT docs_a WHEN 'authority_canonical' THEN stronger WHEN 'recency_within_tier' THEN newer END AS a_wins FROM (SELECT *, CASE {rules} ELSE 'unresolved' END AS rule FROM u))"
    )


_scope = "WHEN rel = 'complementary' THEN 'complementary_scope' WHEN rel IN ('version_drift', 'conditional') THEN 'version_scoping' "
_rest = "WHEN rel = 'deprecation' THEN 'explicit_deprecation' WHEN rel = 'empirical_override' THEN 'empirical_override' WHEN rel = 'docs_gap' THEN 'docs_gap_staff_authority' WHEN rel IN ('contradict', 'misconception') THEN 'authority_canonical' WHEN rel = 'docs_drift' THEN 'recency_within_tier'"
_most = EngineConfig().get("chunking.forum.max_question_tokens")
_posted = "CASE WHEN doc_id % 5 = 0 THEN repeat('word ', 300) || 'end. Next.' ELSE coalesce(text, '') END"
_clean = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_odds = " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INTEGER)" for p in evl.POISSON)
_boot = lambda metric: (
    f"(WITH d AS (SELECT s, {metric} AS x, CAST('0x' || substr(md5('42:' || s || ':' || qid), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM v, (SELECT unnest(range(0, {SAMPLES})) AS s)), w AS (SELECT s, x, {_odds} AS w FROM d), m AS (SELECT sum(w * x) / sum(w) AS mean FROM w GROUP BY s HAVING sum(w) > 0), l AS (SELECT list(mean ORDER BY mean) AS l FROM m) "
    f"SELECT '{metric}' AS metric, round((SELECT avg({metric}) FROM v), 6) AS mean, round(l[least(len(l), CAST(floor(len(l) * 0.025::DOUBLE) AS BIGINT) + 1)], 6) AS low, round(l[least(len(l), CAST(floor(len(l) * 0.975::DOUBLE) AS BIGINT) + 1)], 6) AS high FROM l)"
)
ORACLES: dict[str, str] = {
    "claims_everywhere": f"WITH f AS (SELECT doc_id, {_first} AS f FROM documents), t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {options(CLAIMED, f'doc_id % {_n}')} WHEN 1 THEN {options(CLAIMED, f'doc_id % {_n}')} || ' ' || f ELSE f || ' ' || {options(CLAIMED, f'(doc_id * 7) % {_n}')} || ' ' || {options(CLAIMED, f'doc_id % {_n}')} END AS shown FROM f), "
    f"c AS (SELECT doc_id, unnest({claim_sql('shown')}) AS c FROM t) SELECT doc_id, c.attribute AS attribute, c.value AS value, md5(c.evidence) AS evidence_md5 FROM c",
    "rule_cascade": f"WITH {_sides} {_cascade('given', 'true', _scope + _rest)} UNION ALL {_cascade('turned', 'false', _rest)}",
    "refusal_texts": chain("answered", "SELECT a.qid, CASE WHEN a.refused THEN 'Nothing about this was found in the available sources (documentation, forum, blog). Only ' || CAST(round_even(s.coverage * 100, 0) AS INTEGER) || '% of the distinctive terms of the question occur in what was retrieved, so it is treated as out of scope.' END AS refusal, a.cited FROM (SELECT qid, refused, CASE WHEN refused OR citations IS NULL OR citations = '' THEN CAST(0 AS BIGINT) ELSE len(string_split(citations, '|')) END AS cited FROM answered) a JOIN signals s USING (qid)"),
    "long_questions": f"WITH p AS (SELECT doc_id, {_clean(_posted)} AS b FROM documents), s AS (SELECT doc_id, b, {sentences_sql('b')} AS s FROM p), c AS (SELECT *, list_transform(s, lambda x: {tokens_of('x')}) AS c FROM s), "
    f"k AS (SELECT *, len(list_filter(range(1, len(c) + 1), lambda i: list_sum(list_slice(c, 1, i)) <= {_most})) AS k FROM c), "
    f"q AS (SELECT doc_id, CASE WHEN {tokens_of('b')} <= {_most} THEN b WHEN k > 0 THEN array_to_string(list_slice(s, 1, k), ' ') ELSE left(b, 600) END AS q FROM k), t AS (SELECT doc_id, {_clean("'QUESTION: T' || chr(10) || q")} || chr(10) || chr(10) || 'ANSWER (staff, accepted, 9 votes):' || chr(10) || 'Yes.' AS t FROM q) "
    "SELECT 'forum:' || doc_id || ':p2' AS chunk_id, md5(t) AS text_md5, length(t) AS chars FROM t",
    "bootstrap_interval": f"WITH v AS MATERIALIZED ({ENGINE['ranking_quality']}) SELECT * FROM {_boot('ndcg10')} UNION ALL SELECT * FROM {_boot('recall20_pool')}",
    "stream_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS intent, count(*) AS questions, count(*) FILTER (value < 50) AS refused FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL",
    "trace_records": chain("answered", "SELECT md5(q.query) AS query_md5, q.intent, p.n AS candidates, coalesce(f.n, 0) AS chosen, f.first, coalesce(r.n, 0) AS conflicts, a.refused, CASE WHEN a.refused OR a.citations IS NULL OR a.citations = '' THEN CAST(0 AS BIGINT) ELSE len(string_split(a.citations, '|')) END AS cited FROM qa q LEFT JOIN (SELECT qid, count(*) AS n FROM pool GROUP BY qid) p USING (qid) LEFT JOIN (SELECT qid, count(*) AS n, arg_min(chunk_id, rank_after) AS first FROM final GROUP BY qid) f USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM resolved GROUP BY qid) r USING (qid) JOIN answered a USING (qid)"),
}
