"""Analysis of questions (QRY-1 to QRY-7): a projection over fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

# Intents with their patterns on the lower-case question, the first group that matches wins. {brand} is the configured product name.
INTENTS = {
    "version_migration": (r"\bmigrat", r"\bupgrad", r"\bv?2\.\d.*\bv?3\.\d", r"\bbreaking change", r"\bmoving (?:from|to)\b", r"\bafter upgrading\b", r"\bwhat breaks\b"),
    "conceptual": (r"\binstead of\b", r"\brather than\b", r"\brationale\b", r"\btrade-?off", r"\bwhy (?:does|do|did) (?:{brand}|the|it|you)\b", r"\bhow does .{0,30}work\b", r"\bwhat is the point\b", r"\bexplain\b", r"\bunder the hood\b", r"\bdesign decision\b", r"\bwhy not\b"),
    "opinion": (r"\bbetter than\b", r"\bvs\.?\b", r"\bversus\b", r"\bshould i (?:use|pick|choose)\b", r"\bworth it\b", r"\brecommend\b", r"\bcompare"),
    "troubleshooting": (
        r"\bwhy (?:do|does|is|are|am|did)\b", r"\berror\b", r"\bfail", r"\bbroken\b", r"\bnot work", r"\bstuck\b", r"\bhang", r"\bforever\b", r"\btwice\b", r"\bduplicate", r"\bcrash",
        r"\b4\d{2}\b", r"\b5\d{2}\b", r"\bdisappear", r"\bunexpected", r"\bissue\b", r"\bproblem\b", r"\bkeeps?\b", r"\bgone\b", r"\bmissing\b", r"\bignor", r"\bwon'?t\b",
    ),
    "api_reference": (r"\bwhat(?:'s| is) the (?:default|maximum|max|minimum|min|limit)\b", r"\bhow many\b", r"\bsignature\b", r"\bparameter", r"\bwhich header\b", r"\bdefault value\b", r"\bmax(?:imum)? (?:size|number|payload|batch)\b", r"\bexit code", r"\bdefault (?:retry|retries|concurrency|timeout)\b", r"\bdeprecat"),
    "how_to": (r"\bhow (?:do|can|should) i\b", r"\bhow to\b", r"\bsteps? to\b", r"\bconfigur", r"\bset up\b", r"\benable\b", r"\binspect\b", r"\bcheck\b", r"\bcan i\b"),
}

# Product areas with words that a question about them contains.
AREAS = {
    "retries": ("retry", "retries", "backoff", "max_retries", "attempt", "jitter"),
    "rate_limits": ("429", "rate limit", "retry-after", "quota", "throttle", "too many requests"),
    "dlq": ("dlq", "dead-letter", "dead letter", "replay", "dead-lettered"),
    "auth": ("auth", "401", "api key", "header", "x-{brand}-key", "authorization", "credential"),
    "payloads": ("payload", "413", "size limit", "kib", "base64", "serialis", "serializ"),
    "concurrency": ("concurrency", "worker", "visibility timeout", "cpu", "parallel", "lease"),
    "idempotency": ("idempoten", "duplicate", "exactly once", "at-least-once", "dedup"),
    "timeouts": ("timeout", "fail-fast", "heartbeat"),
    "cli": ("cli", "command line", "{brand} dlq", "flag", "windows", "terminal"),
    "sdk": ("sdk", "client.", "enqueue", "push", "handler"),
    "migration": ("migrate", "migration", "upgrade", "breaking"),
    "batch": ("batch", "enqueue_many", "bulk"),
}

# Words that are no entities, beside the product's name.
NO_ENTITIES = ("what", "which", "where", "when", "does", "about", "from", "with", "this", "that", "they", "there", "then", "{brand}", "jobs", "job")

# The first that the question contains adds its words.
SYNONYMS = (
    ("retry forever", "retries indefinitely loop endlessly backoff"),
    ("retries", "retry attempt backoff max_retries"),
    ("retry", "retries attempt backoff max_retries"),
    ("429", "rate limit too many requests Retry-After throttled"),
    ("timeout", "time limit deadline fail-fast visibility"),
    ("dlq", "dead-letter queue failed jobs replay"),
    ("dead letter", "dlq replay failed job"),
    ("disable", "turn off unset none"),
    ("twice", "duplicate redelivery double execution visibility timeout"),
    ("broken", "fails error not working bug"),
    ("windows", "windows credential store powershell"),
    ("payload", "job body size limit bytes"),
    ("concurrency", "workers parallel handlers"),
    ("automatically", "automatic replay manual"),
)

VERSION = r"(?iU)\bv?([23])\.(\d+)(?:\.\d+)?\b"
CANONICAL = r"(?U)\b(default|maximum|max|limit|exactly)\b"


def intent(query: Column, brand: str) -> Column:
    """QRY-1."""
    low = F.lower(query)
    out = None
    for name, patterns in INTENTS.items():
        hit = low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns).replace("{brand}", brand.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def version_mentioned(query: Column) -> Column:
    """QRY-2."""
    major = F.regexp_extract(query, VERSION, 1)
    return F.when(major != "", F.concat_ws(".", major, F.regexp_extract(query, VERSION, 2)))


def product_area(query: Column, brand: str) -> Column:
    """QRY-3: the area with most of its words in the question; of equals the first."""
    low = F.lower(query)
    scores = [F.struct(sum(F.contains(low, F.lit(w.replace("{brand}", brand.lower()))).cast("int") for w in own).alias("n"), F.lit(-i).alias("i"), F.lit(area).alias("area")) for i, (area, own) in enumerate(AREAS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["area"])


def once(items: Column, key, most: int | None = None) -> Column:
    """The first of each key, in order; with ``most``, no more are looked for than that."""
    full = lambda done: F.lit(False) if most is None else F.size(done) >= most
    return F.aggregate(items, F.array().cast("array<string>"), lambda done, t: F.when(full(done), done).when(F.exists(done, lambda d: key(d) == key(t)), done).otherwise(F.concat(done, F.array(t))))


def entities(query: Column, brand: str) -> Column:
    """QRY-4: tokens that look like identifiers, at most eight."""
    plain = F.array(*[F.lit(w.replace("{brand}", brand.lower())) for w in NO_ENTITIES])
    found = F.filter(F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9][A-Za-z0-9._\-]*"), F.lit(0)), lambda t: ~F.array_contains(plain, F.lower(t)) & (t.rlike(r"^[0-9]+$") | t.rlike(r"[_.\-]") | t.rlike(r"^.+[A-Z]")))
    return once(found, F.lower, 8)


def expansions(query: Column, area: Column, most: int) -> Column:
    """QRY-5."""
    low = F.lower(query)
    words = None
    for needle, more in SYNONYMS:
        hit = F.contains(low, F.lit(needle))
        words = F.when(hit, F.lit(more)) if words is None else words.when(hit, F.lit(more))
    raw = F.filter(F.array(F.concat_ws(" ", query, words), F.when(area.isNotNull(), F.concat_ws(" ", query, F.replace(area, F.lit("_"), F.lit(" "))))), lambda x: x.isNotNull())
    fresh = F.filter(F.transform(raw, F.trim), lambda x: F.lower(x) != F.lower(F.trim(query)))
    return F.slice(once(fresh, F.lower), 1, most) if most > 0 else F.array().cast("array<string>")


def all_queries(query: Column, more: Column) -> Column:
    """QRY-7: the question, then its expansions, without blanks and repeats."""
    return once(F.filter(F.transform(F.concat(F.array(query), more), F.trim), lambda x: F.length(x) > 0), F.lower)


def analyse(queries: DataFrame, config: EngineConfig) -> DataFrame:
    """(qid, query) with intent, version_mentioned, product_area, entities, expanded_queries, requires_canonical_answer (QRY-6) and all_queries."""
    brand, q = config.get("brand"), F.col("query")
    most = config.get("retrieval.query_analysis.max_expansions") if config.get("retrieval.query_analysis.expand_queries") else 0
    out = queries.select("qid", "query").withColumn("intent", intent(q, brand)).withColumn("version_mentioned", version_mentioned(q)).withColumn("product_area", product_area(q, brand))
    out = out.withColumn("entities", entities(q, brand)).withColumn("expanded_queries", expansions(q, F.col("product_area"), most))
    return completed(out, "rules")


def completed(rows: DataFrame, classifier: str) -> DataFrame:
    """An analysis (qid, query, intent, version_mentioned, product_area, entities, expanded_queries) with what follows from it."""
    q = F.col("query")
    canonical = F.col("intent").isin("api_reference", "version_migration") | F.lower(q).rlike(CANONICAL)
    return rows.withColumn("requires_canonical_answer", canonical).withColumn("all_queries", all_queries(q, F.col("expanded_queries"))).withColumn("classifier", F.lit(classifier))


#: What a hosted analysis of a question gives (EXT-3).
ANALYSIS = "intent string, version_mentioned string, product_area string, entities array<string>, expanded_queries array<string>"


def hosted_analysis(queries: DataFrame, given: DataFrame, config: EngineConfig) -> DataFrame:
    """``given`` (qid and ANALYSIS) as ``analyse`` has it: an intent that is none counts as unknown, and expansions as the rules' do."""
    most = config.get("retrieval.query_analysis.max_expansions") if config.get("retrieval.query_analysis.expand_queries") else 0
    rows = given.join(queries, "qid").withColumn("intent", F.when(F.col("intent").isin(*INTENTS), F.col("intent")).otherwise("unknown"))
    rows = rows.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).withColumn("expanded_queries", F.slice(F.coalesce("expanded_queries", F.array().cast("array<string>")), 1, most) if most > 0 else F.array().cast("array<string>"))
    return completed(rows.select("qid", "query", "intent", "version_mentioned", "product_area", "entities", "expanded_queries"), "hosted")
