"""Claims, conflicts and their resolution (CON-10 to CON-25) over final chunks (qid, chunk_id, rank_after, ...)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.pytext import LIKE_ASCII, WHITE, lower, searched
from ..functions.text import iso_date, jaccard, size_in_bytes, tokenize, version_parts
from ..session import settle

# Attributes with ordered patterns; the value is group 1 (None), its size in bytes ("bytes") or the constant. {brand} is the configured product name.
CLAIMS: dict[str, tuple[tuple[str, str | None], ...]] = {
    "max_retries_default": (
        (r"max_retries\s+defaults?\s+to\s+\*{0,2}(\d+)", None),
        (r"defaults?\s+(?:of|to)\s+\*{0,2}(\d+)\s*\*{0,2}\s*retry attempts", None),
        (r"default\s+`?max_retries`?\s+(?:rose|raised|changed)\s+from\s+\d+\s+to\s+(\d+)", None),
        (r"v3 default of\s+(\d+)\s+retries", None),
    ),
    "max_payload_bytes": (
        (r"payloads?\s+at\s+\*{0,2}(\d+(?:\.\d+)?\s*(?:KiB|KB|MiB|MB))", "bytes"),
        (r"at most\s+\*{0,2}(\d+(?:[\d,]*)\s*(?:KiB|KB|MiB|MB))", "bytes"),
        (r"caps job payloads at\s+\*{0,2}(\d+(?:\.\d+)?\s*(?:KiB|KB|MiB|MB))", "bytes"),
        (r"(?:the\s+)?(\d+(?:\.\d+)?\s*(?:KiB|KB|MiB|MB))\s+(?:limit|ceiling|maximum)", "bytes"),
    ),
    "visibility_timeout_default": (
        (r"visibility timeout,?\s+\*{0,2}(\d+)\s*seconds?\s+by default", None),
        (r"default visibility timeout is\s+\*{0,2}(\d+)\s*seconds?", None),
        (r"visibility timeout\s+(?:is|of)\s+\*{0,2}(\d+)\s*seconds?\s+by default", None),
        (r"(\d+)\s*seconds?\s+by default(?=[^.]*visibility)", None),
        (r"visibility timeout[^.]{0,40}dropped from\s+\*{0,2}\d+s?\s*(?:seconds?)?\s*to\s+\*{0,2}(\d+)", None),
    ),
    "auth_header": ((r"\bX-{brand}-Key\b", "x-{brand}-key"), (r"Authorization:\s*{brand}\b", "authorization-{brand}")),
    "timeout_zero_semantics": (
        (r"timeout=0\s+(?:does NOT|does not)\s+disable", "fail_fast"),
        (r"timeout=0\s+means\s+fail-fast", "fail_fast"),
        (r"`?timeout=0`?\s+disables? the timeout", "disables"),
        (r"timeout=0\s+to\s+(?:turn|disable)", "disables"),
    ),
    "dlq_auto_replay": (
        (r"never replayed automatically", "no"),
        (r"no automatic replay", "no"),
        (r"replay is manual", "no"),
        (r"replays? (?:and sweeps )?automatically", "yes"),
        (r"sweeps and replays automatically", "yes"),
    ),
    "windows_cli_support": (
        (r"CLI works on Windows", "supported"),
        (r"Windows is a (?:fully )?supported platform", "supported"),
        (r"(?:CLI is|is) broken on Windows", "broken"),
        (r"completely unusable on Windows", "broken"),
        (r"credential_store_unreadable", "broken"),
    ),
    "legacy_ack_flag": (
        (r"`?--legacy-ack`?\s+(?:flag\s+)?has been\s+\*{0,2}removed", "removed"),
        (r"`?--legacy-ack`?\s+was removed", "removed"),
        (r"\|\s*`--legacy-ack`\s*\|", "available"),
        (r"--legacy-ack`?\]?\s*$", "available"),
    ),
    "enqueue_api": (
        (r"`?client\.enqueue\(\)`?\s+is the supported way", "enqueue"),
        (r"use\s+`?client\.enqueue\(\)`?", "enqueue"),
        (r"use push in a loop", "push"),
        (r"push is the enqueue call", "push"),
    ),
    "worker_concurrency_default": (
        (r"run\s+\*{0,2}(\d+)\s+concurrent handlers\*{0,2}\s+by default", None),
        (r"concurrency defaults? to the host(?:'s)? CPU count", "cpu_count"),
        (r"agent concurrency defaults? to the host CPU count", "cpu_count"),
        (r"Defaults? to\s+(\d+)\.", None),
    ),
    "retry_after_honoured": (
        (r"SDK honours `?Retry-After`?", "yes"),
        (r"honours the `?Retry-After`? header", "yes"),
        (r"now honours the `?Retry-After`?", "yes"),
        (r"parses `?Retry-After`? and then discards it", "no"),
        (r"(?:ignored|not being read|never applied to scheduling)", "no"),
        (r"did not respect Retry-After|does not respect Retry-After", "no"),
        (r"computed backoff without consulting `?Retry-After`?", "no"),
    ),
}

# Areas of the attributes; a documentation gap is judged by rank instead.
ATTRIBUTE_AREAS = {
    "max_retries_default": ("retries",),
    "max_payload_bytes": ("payloads",),
    "visibility_timeout_default": ("concurrency", "timeouts", "idempotency"),
    "auth_header": ("auth", "migration"),
    "timeout_zero_semantics": ("timeouts",),
    "dlq_auto_replay": ("dlq",),
    "windows_cli_support": ("cli",),
    "legacy_ack_flag": ("cli", "migration"),
    "enqueue_api": ("sdk", "batch", "migration"),
    "worker_concurrency_default": ("concurrency",),
    "retry_after_honoured": ("rate_limits", "retries", "dlq"),
}

# Cues, as parts of the lower-case text.
SCOPES = {
    "self_hosted": ("self-hosted", "{brand}-agent", "self hosted agent", "agent concurrency"),
    "managed": ("managed worker", "{brand} worker start", "managed infrastructure", "managed workers"),
}
OBSERVED = ("i packet-captured", "i logged", "i checked", "we captured", "confirmed", "in practice", "observed", "measured", "reproduc", "every single one shows", "the intervals are", "same thing bit us", "i have seen it")
UNDOCUMENTED = ("undocumented", "not on the cli reference page", "does not appear in", "not documented", "oversight on our side", "no way to discover it")
DEPRECATED = ("deprecated", "deprecationwarning", "scheduled for removal", "superseded")
RECONCILED = ("two different components", "two different defaults", "not in conflict", "are not in conflict", "this differs from", "differs from", "nothing is being ignored", "which one applies depends", "different deployment", "separate deployment")

#: Relationships that are conflicts.
CONFLICTS = ("contradict", "version_drift", "conditional", "deprecation", "misconception", "docs_drift", "docs_gap", "empirical_override")
GAP = "documentation_coverage"

#: What a resolution says, by the rule that fired.
EXPLAINED = {
    "complementary_scope": "The passages are about different components; each is right for its own.",
    "version_scoping": "Each claim holds for its own version or condition; the newer one is current.",
    "explicit_deprecation": "Both forms work, but one is deprecated; the current one is recommended.",
    "empirical_override": "Independent reports differ from what is documented; both are shown, the documented behaviour first.",
    "docs_gap_staff_authority": "The documentation is silent; a post by staff fills the gap, so this may change without notice.",
    "authority_canonical": "One fact has one value; the source of higher authority wins.",
    "recency_within_tier": "Two sources of one tier differ; the newer one wins.",
    "unresolved": "No rule decides; both claims are shown with their sources.",
}


def has_cue(text: Column, cues: tuple[str, ...], brand: str = "") -> Column:
    """CON-11."""
    return F.exists(F.array(*[F.lit(c.replace("{brand}", brand.lower())) for c in cues]), lambda c: F.contains(F.lower(text), c))


#: What a worker finds in a text; ``sized`` values are still to be made bytes.
CLAIM = T.ArrayType(T.StructType([T.StructField("attribute", T.StringType()), T.StructField("value", T.StringType()), T.StructField("sized", T.BooleanType()), T.StructField("evidence", T.StringType())]))


def claims_in(text: str, held: set[str], known: list) -> Iterator[tuple[str, str, bool, str]]:
    """(attribute, value, sized, evidence) of a text. A pattern is searched only where all that it needs occurs; ``held`` are those it has of what patterns need first."""
    low = None
    for attribute, patterns in known:
        for needs, pattern, value in patterns:
            if held.isdisjoint(needs[0]):
                continue
            low = low or lower(text)
            if not all(any(x in low for x in some) for some in needs[1:]) or not (at := pattern.search(low)):
                continue
            start, end = at.span()
            stop = text.find(".", end) + 1 or end + 120
            yield attribute, text[slice(*at.span(1))] if value in (None, "bytes") else value, value == "bytes", text[text.rfind(".", 0, start) + 1 : stop].strip(WHITE)
            break


def finder(brand: str) -> Callable[[pa.Array], pa.Array]:
    """For a worker: texts to their claims. One automaton finds the first place in each text where any pattern has what it needs; most texts have none."""
    known = [(attribute, [(*searched(pattern, brand=brand), value and value.replace("{brand}", brand.lower())) for pattern, value in patterns]) for attribute, patterns in CLAIMS.items()]
    firsts = {x for _, patterns in known for needs, _, _ in patterns for x in needs[0]}
    # A letter that the automaton may not take for an ASCII one is a place too, and a needed text can begin before it.
    places, reach = "|".join(map(re.escape, [*sorted(firsts), *LIKE_ASCII])), 4 * max(map(len, firsts))

    def find(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for text, place in zip(texts, pc.find_substring_regex(texts, places, ignore_case=True).to_pylist(), strict=True):
            if place is not None and place >= 0:
                data = text.as_buffer().to_pybytes()
                tail = lower(data[max(0, place - reach) :].decode("utf-8", "replace"))
                found += claims_in(data.decode("utf-8", "replace"), {x for x in firsts if x in tail}, known)
            ends.append(len(found))
        columns = [[c[k] for c in found] for k in range(4)]
        rows = pa.StructArray.from_arrays([pa.array(v, pa.bool_() if f.name == "sized" else pa.string()) for v, f in zip(columns, CLAIM.elementType, strict=True)], CLAIM.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return find


def claims(chunks: DataFrame, brand: str) -> DataFrame:
    """CON-10: (the rows', attribute, value, evidence): the first pattern of each attribute that matches, and the sentence around it. A text is read once by a worker, in time that grows with its length."""
    found = arrow_udf(finder(brand), CLAIM)(F.col("display_text").cast("string"))
    rows = chunks.withColumn("_claim", F.explode(found))
    value = F.when(F.col("_claim.sized"), size_in_bytes(F.col("_claim.value"))).otherwise(F.col("_claim.value"))
    return rows.select(*chunks.columns, "_claim.attribute", value.alias("value"), "_claim.evidence")


def facts(chunks: DataFrame, config: EngineConfig) -> DataFrame:
    """What classification and resolution ask of a chunk, once."""
    brand = config.get("brand")
    votes, accepted = F.coalesce("votes", F.lit(0)), F.coalesce("is_accepted", F.lit(False))
    staff = F.coalesce(F.col("author_role").isin("staff", "mvp"), F.lit(False))
    tier = (
        F.when(F.col("source") == "docs", F.when(F.col("doc_type") == "changelog", "docs:changelog").otherwise("docs"))
        .when(F.col("source") == "forum", F.when(staff, "forum:staff").when(accepted, "forum:accepted").when(votes >= 20, "forum:high_votes").otherwise("forum:low_votes"))
        .otherwise(F.when(F.col("author_role") == "staff", "blog:staff").otherwise("blog:guest"))
    )
    order = F.array(*map(F.lit, config.get("contradiction.source_authority_order")))
    date = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("last_updated", "published_at", "created_at")])
    return chunks.select(
        "qid", "chunk_id", "rank_after", "source", "display_text", "display_tokens", F.col("version_own").alias("version"), "doc_type", F.coalesce("product_area_of_chunk", F.lit("")).alias("area"),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("tags"), F.split("chunk_id", ":")[1].alias("doc"), staff.alias("staff"), (accepted | (votes >= 10)).alias("popular"),
        ((F.col("source") == "docs") | staff | ((F.col("source") == "forum") & (accepted | (votes >= 20)))).alias("credible"),
        F.filter(F.array(*[F.when(has_cue(F.col("text"), cues, brand), F.lit(name)) for name, cues in SCOPES.items()]), lambda s: s.isNotNull()).alias("scopes"),
        has_cue(F.col("display_text"), OBSERVED).alias("observed"), has_cue(F.col("display_text"), UNDOCUMENTED).alias("undocumented"), has_cue(F.col("display_text"), DEPRECATED).alias("deprecated"), has_cue(F.col("display_text"), RECONCILED).alias("reconciled"),
        tier.alias("tier"), F.coalesce(F.nullif(F.array_position(order, tier), F.lit(0)), F.size(order) + 1).alias("authority_rank"),
        version_parts(F.col("version_own")).alias("version_parts"), F.coalesce(F.unix_date(iso_date(date)), F.lit(0)).alias("day"),
    )


def sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("qid", *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "qid"])


def classify() -> Column:
    """CON-13 to CON-15 on rows with both sides: struct(relationship, reconcilable, confidence)."""
    c = F.col
    kind = lambda name, ok, sure: F.struct(F.lit(name).alias("relationship"), F.lit(ok).alias("reconcilable"), (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"))
    docs_a, docs_b = c("source_a") == "docs", c("source_b") == "docs"
    one_docs, both_docs = docs_a | docs_b, docs_a & docs_b
    pick = lambda name: F.when(docs_a, c(f"{name}_b")).otherwise(c(f"{name}_a"))  # noqa: E731  of the side beside the documentation
    versions = c("version_a").isNotNull() & c("version_b").isNotNull() & (c("version_a") != c("version_b"))
    same_major = F.split("version_a", r"\.")[0] == F.split("version_b", r"\.")[0]
    apart = (F.size("scopes_a") > 0) & (F.size("scopes_b") > 0) & ~F.arrays_overlap("scopes_a", "scopes_b")
    reports = F.size(F.array_except("observers", F.array(pick("doc")))) + 1
    lay_popular = F.when(c("staff_a"), c("popular_b")).otherwise(c("popular_a"))
    return (
        F.when(c("reconciled_a") | c("reconciled_b"), kind("complementary", True, 0.88))
        .when(apart, kind("complementary", True, 0.85))
        .when(one_docs & (pick("source") == "forum") & pick("observed") & (reports >= c("least_reports")), kind("empirical_override", True, 0.89))
        .when((~c("credible_a") | ~c("credible_b")) & one_docs, kind("misconception", False, 0.80))
        .when(versions & same_major, kind("conditional", True, 0.88))
        .when(versions, kind("version_drift", True, 0.90))
        .when((c("attribute") == "legacy_ack_flag") & (c("deprecated_a") | c("deprecated_b")) & both_docs & F.array_contains(F.array("value_a", "value_b"), "removed") & F.array_contains(F.array("value_a", "value_b"), "available"), kind("docs_drift", False, 0.92))
        .when((c("attribute") == "enqueue_api") | ((c("attribute") == "legacy_ack_flag") & (c("deprecated_a") | c("deprecated_b"))), kind("deprecation", True, 0.85))
        .when(both_docs, kind("docs_drift", False, 0.80))
        .when(one_docs, kind("misconception", False, F.when(pick("popular"), 0.86).otherwise(0.72)))
        .when((c("source_a") == "forum") & (c("source_b") == "forum") & (c("staff_a") != c("staff_b")), kind("misconception", False, F.when(lay_popular, 0.84).otherwise(0.70)))
        .otherwise(kind("contradict", False, 0.65))
    )


def topics_overlap() -> Column:
    """CON-17."""
    c = F.col
    return ((c("area_a") != "") & (c("area_a") == c("area_b"))) | F.arrays_overlap("tags_a", "tags_b") | ((c("area_b") != "") & F.array_contains("tags_a", c("area_b"))) | ((c("area_a") != "") & F.array_contains("tags_b", c("area_a")))


def findings(final: DataFrame, config: EngineConfig) -> DataFrame:
    """CON-12, CON-16, CON-19: typed pairs of each question, the first max_pairs by confidence, those of two sources first."""
    # Written once: both sides of the pairs, the observers and the gaps read them.
    known = settle(facts(final, config))
    said = settle(claims(known, config.get("brand")).drop("display_text", "display_tokens"))
    observers = known.where((F.col("source") == "forum") & F.col("observed")).groupBy("qid").agg(F.collect_set("doc").alias("observers"))
    pairs = sided(said, "a").join(sided(said.withColumnRenamed("attribute", "_attribute"), "b"), "qid").where("attribute_a = _attribute_b and rank_after_a < rank_after_b and value_a <> value_b")
    if config.get("contradiction.pair_selection.cross_source_only"):
        pairs = pairs.where("source_a <> source_b")
    pairs = pairs.withColumnRenamed("attribute_a", "attribute").join(observers, "qid", "left").withColumn("observers", F.coalesce("observers", F.array().cast("array<string>"))).withColumn("least_reports", F.lit(config.get("contradiction.empirical_override.min_independent_reports")))
    text = lambda s: F.concat(F.col("attribute"), F.lit(" = "), F.col(f"value_{s}"), F.lit(": "), F.substring(f"evidence_{s}", 1, 200))
    typed = pairs.withColumns({"kind": classify(), "topic": F.col("attribute"), "claim_a": text("a"), "claim_b": text("b"), "_pass": F.lit(1)})
    # The silent documentation is side a of a gap, whichever ranks first.
    gaps = sided(known.where("source = 'docs'"), "a").join(sided(known.where("source <> 'docs' and undocumented and staff"), "b"), "qid").where(topics_overlap())
    met = typed.select("qid", F.explode(F.array(F.struct("chunk_id_a", "chunk_id_b"), F.struct(F.col("chunk_id_b").alias("chunk_id_a"), F.col("chunk_id_a").alias("chunk_id_b")))).alias("p")).select("qid", "p.*").distinct()
    gaps = gaps.join(met, ["qid", "chunk_id_a", "chunk_id_b"], "left_anti")
    gaps = gaps.withColumns({"kind": F.struct(F.lit("docs_gap").alias("relationship"), F.lit(True).alias("reconcilable"), F.lit(0.82).alias("confidence")), "topic": F.lit(GAP), "claim_a": F.lit("no page of the documentation says anything about it"), "claim_b": F.substring("display_text_b", 1, 220), "_pass": F.lit(2)}).drop(*[f"display_{what}_{side}" for what in ("text", "tokens") for side in "ab"])
    both = typed.select(*gaps.columns).unionByName(gaps).select("*", "kind.*").drop("kind")
    return numbered(both, config, "rules")


def numbered(both: DataFrame, config: EngineConfig, detector: str) -> DataFrame:
    """CON-19: the first max_pairs of each question by confidence, those of two sources first."""
    order = Window.partitionBy("qid").orderBy(F.desc("confidence"), (F.col("source_a") == F.col("source_b")).cast("int"), "_pass", F.least("rank_after_a", "rank_after_b"), F.greatest("rank_after_a", "rank_after_b"), "topic")
    return both.withColumn("finding", F.row_number().over(order)).where(F.col("finding") <= config.get("contradiction.pair_selection.max_pairs")).drop("_pass").withColumn("detector", F.lit(detector))


#: What a hosted detector gives for a question (EXT-3).
PAIRS = "chunk_id_a string, chunk_id_b string, topic string, relationship string, reconcilable boolean, confidence double, claim_a string, claim_b string"


def hosted_findings(final: DataFrame, given: DataFrame, config: EngineConfig) -> DataFrame:
    """``given`` (qid and PAIRS) as ``findings`` has it; pairs that name a chunk which the question does not have, or no known relationship, are left out."""
    known = facts(final, config).drop("display_text", "display_tokens")
    pairs = given.where(F.col("relationship").isin(*CONFLICTS, "complementary"))
    both = pairs.join(sided(known, "a"), ["qid", "chunk_id_a"]).join(sided(known, "b"), ["qid", "chunk_id_b"]).withColumn("_pass", F.lit(1))
    return numbered(both, config, "hosted")


def relevant(analysed: DataFrame, found: DataFrame) -> DataFrame:
    """CON-20, CON-21: conflicts that bear on the question, one for each pair and topic."""
    areas = F.create_map(*[x for k, v in ATTRIBUTE_AREAS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = found.where(F.col("relationship").isin(*CONFLICTS)).join(analysed.select("qid", "query", F.col("product_area").alias("asked_area")), "qid")
    by_area = F.coalesce(F.array_contains(F.try_element_at(areas, F.col("topic")), F.col("asked_area")), F.lit(False))
    by_words = F.arrays_overlap(tokenize(F.col("query")), tokenize(F.replace("topic", F.lit("_"), F.lit(" "))))
    filler = lambda name: F.when(F.col("source_a") == "docs", F.col(f"{name}_b")).otherwise(F.col(f"{name}_a"))
    gap_ok = (filler("rank_after") <= 3) & (F.col("asked_area").isNull() | (F.size(filler("tags")) == 0) | F.array_contains(filler("tags"), F.lower("asked_area")))
    central = F.when(F.col("topic") == GAP, gap_ok).otherwise((F.col("rank_after_a") <= 3) & (F.col("rank_after_b") <= 3))
    rows = rows.where(by_area | by_words | F.coalesce(central, F.lit(False)))
    pair = F.array_sort(F.array("chunk_id_a", "chunk_id_b"))
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy("qid", pair, "topic").orderBy("finding"))).where("_first = 1").drop("_first")


def a_is_newer() -> Column:
    """CON-25: by version, then by date; a if both are equal."""
    a, b = F.col("version_parts_a"), F.col("version_parts_b")
    return F.when(a != b, a > b).otherwise(F.col("day_a") >= F.col("day_b"))


def resolve(conflicts: DataFrame, config: EngineConfig) -> DataFrame:
    """CON-22 to CON-24: winner, loser, rule_fired, explanation and must_disclose by the first rule of the cascade that applies."""
    rel, docs_a, docs_b = F.col("relationship"), F.col("source_a") == "docs", F.col("source_b") == "docs"
    rank_a, rank_b = F.col("authority_rank_a"), F.col("authority_rank_b")
    stronger = F.when(rank_a != rank_b, rank_a < rank_b).otherwise(a_is_newer())

    def won(rule: str, a_wins: Column, with_loser: bool = True) -> Column:
        loser = F.when(a_wins, F.col("chunk_id_b")).otherwise(F.col("chunk_id_a")) if with_loser else F.lit(None).cast("string")
        return F.struct(F.when(a_wins, F.col("chunk_id_a")).otherwise(F.col("chunk_id_b")).alias("winner"), loser.alias("loser"), F.lit(rule).alias("rule_fired"), F.lit(True).alias("must_disclose"))

    def said(rule: str, winner: str, disclose: bool = True) -> Column:
        return F.struct(F.lit(winner).alias("winner"), F.lit(None).cast("string").alias("loser"), F.lit(rule).alias("rule_fired"), F.lit(disclose).alias("must_disclose"))

    rules = {
        "version_scoping": F.when(rel == "complementary", said("complementary_scope", "both", False)).when(rel.isin("version_drift", "conditional"), said("version_scoping", "both")),
        "explicit_deprecation": F.when(rel == "deprecation", won("explicit_deprecation", F.when(docs_a, True).when(docs_b, False).otherwise(stronger))),
        "empirical_override": F.when(rel == "empirical_override", said("empirical_override", "disclose_both")),
        "source_authority": F.when(rel == "docs_gap", won("docs_gap_staff_authority", ~docs_a, False)).when(rel.isin("contradict", "misconception"), won("authority_canonical", stronger)),
        "recency_within_tier": F.when(rel == "docs_drift", won("recency_within_tier", a_is_newer())),
        "unresolved": said("unresolved", "unresolved", config.get("contradiction.disclosure.always_disclose_unresolved")),
    }
    chain = [rules[r] for r in config.get("contradiction.precedence") if r in rules]
    text = F.create_map(*[F.lit(x) for kv in EXPLAINED.items() for x in kv])
    return conflicts.withColumn("_r", F.coalesce(*chain, rules["unresolved"])).select("*", "_r.*").drop("_r").withColumn("explanation", F.element_at(text, F.col("rule_fired")))


def similar_pairs(final: DataFrame, least: float = 0.6) -> DataFrame:
    """CON-18: pairs of a question whose topics meet and whose words are alike, for detectors that compare texts."""
    rows = final.select("qid", "chunk_id", "rank_after", "source", F.coalesce("product_area_of_chunk", F.lit("")).alias("area"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("tags"), "display_tokens")
    alike = jaccard(F.array_distinct("display_tokens_a"), F.array_distinct("display_tokens_b"))
    return sided(rows, "a").join(sided(rows, "b"), "qid").where("rank_after_a < rank_after_b").where(topics_overlap()).withColumn("similarity", alike).where(F.col("similarity") >= least * 0.25).select("qid", "chunk_id_a", "chunk_id_b", "similarity")
