"""Ranking, conflict and answer metrics, and traces (EVL-1 to EVL-12, TRC-1 to TRC-3)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graded(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """EVL-1: rows (chunk_id) or (qid, chunk_id) with the best grade of a matching label for each question; rows without one are left out.

    A label is a chunk or a prefix of ids, so each id's prefixes are joined by
    equality instead of comparing all labels with all chunks.
    """
    labels = gold.select("qid", F.explode("relevant").alias("l")).select("qid", "l.label", "l.grade")
    parts = F.split("chunk_id", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    keys = [c for c in ("qid", "chunk_id") if c in rows.columns]
    return rows.select(*keys, F.explode(prefixes).alias("label")).join(labels, ["label", *[k for k in keys if k == "qid"]]).groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade")).where("grade > 0")


def gain(grade: Column, rank: Column) -> Column:
    """EVL-2."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ranking_metrics(final: DataFrame, pool: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """EVL-2 to EVL-4: ndcg10, recall5, recall10, recall20_pool and mrr against the whole corpus; questions without labels are left out."""
    right = graded(chunks.select("chunk_id"), gold)
    ideal = right.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "chunk_id"))).groupBy("qid").agg(F.sum(F.when(F.col("r") <= 10, gain(F.col("grade"), F.col("r")))).alias("ideal"), F.count("*").alias("relevant_n"))
    hit = final.select("qid", "chunk_id", "rank_after").join(graded(final.select("qid", "chunk_id"), gold), ["qid", "chunk_id"])
    got = hit.groupBy("qid").agg(F.sum(F.when(F.col("rank_after") <= 10, gain(F.col("grade"), F.col("rank_after")))).alias("dcg"), F.count(F.when(F.col("rank_after") <= 5, 1)).alias("h5"), F.count(F.when(F.col("rank_after") <= 10, 1)).alias("h10"), F.min("rank_after").alias("first"))
    pooled = pool.select("qid", "chunk_id", "rank_before").join(graded(pool.select("qid", "chunk_id"), gold), ["qid", "chunk_id"]).where("rank_before <= 20").groupBy("qid").agg(F.count("*").alias("h20"))
    rows = gold.where(F.size("relevant") > 0).select("qid", F.size("relevant").alias("labels_n")).join(ideal, "qid", "left").join(got, "qid", "left").join(pooled, "qid", "left")
    total = F.coalesce("relevant_n", "labels_n")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select("qid", zero(F.col("dcg") / F.col("ideal")).alias("ndcg10"), zero(F.col("h5") / total).alias("recall5"), zero(F.col("h10") / total).alias("recall10"), zero(F.col("h20") / total).alias("recall20_pool"), zero(1 / F.col("first")).alias("mrr"))


def source_metrics(final: DataFrame, gold: DataFrame) -> DataFrame:
    """EVL-5: source_recall and source_precision of questions that expect sources."""
    want = gold.where(F.size("expected_sources") > 0).select("qid", "expected_sources")
    rows = want.join(final.select("qid", "source"), "qid", "left").groupBy("qid", "expected_sources").agg(F.collect_set("source").alias("present"), F.avg(F.array_contains("expected_sources", F.col("source")).cast("double")).alias("p"))
    return rows.select("qid", (F.size(F.array_intersect("expected_sources", "present")) / F.size("expected_sources")).alias("source_recall"), F.coalesce("p", F.lit(0.0)).alias("source_precision"))


def displacement(final: DataFrame, gold: DataFrame) -> DataFrame:
    """EVL-5: how the reranker moved each question's best chunk of grade 2 or more."""
    best = final.select("qid", "chunk_id", "rank_before", "rank_after").join(graded(final.select("qid", "chunk_id"), gold).where("grade >= 2"), ["qid", "chunk_id"]).groupBy("qid").agg(F.min(F.struct("rank_after", "rank_before")).alias("b"))
    return best.select("qid", F.col("b.rank_before").alias("gold_rank_before"), F.col("b.rank_after").alias("gold_rank_after"), (F.col("b.rank_before") - F.col("b.rank_after")).alias("gold_displacement"), ((F.col("b.rank_before") > 3) & (F.col("b.rank_after") <= 3)).alias("promoted_into_top3"))


def conflict_metrics(found: DataFrame, resolutions: DataFrame, gold: DataFrame) -> DataFrame:
    """EVL-6. A question without labels is not scored: nothing expected, nothing wrong."""
    seen = found.groupBy("qid").agg(F.max(F.col("relationship") == "complementary").alias("complementary"))
    made = resolutions.groupBy("qid").agg(F.count("*").alias("n"), F.max(F.col("topic") == "worker_concurrency_default").alias("workers"), F.max(F.col("relationship") == "contradict").alias("contradict"), F.min(F.struct("finding", "relationship", "rule_fired")).alias("first"))
    rows = gold.join(seen, "qid", "left").join(made, "qid", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    scored = F.size("relevant") > 0
    expects = scored & F.col("expects_conflict").isNotNull() & (F.col("expects_conflict") != "") & ~F.col("expects_no_conflict")
    rows = rows.withColumn("expects_no_conflict", F.col("expects_no_conflict") & scored)
    return rows.select(
        "qid", F.when(F.col("expects_no_conflict"), no("complementary")).when(expects, F.col("n").isNotNull()).otherwise(False).alias("conflict_detected"),
        F.when(F.col("expects_no_conflict"), F.when(no("complementary"), "complementary")).when(expects, F.col("first.relationship")).alias("conflict_relationship"), F.when(expects, F.col("first.rule_fired")).alias("conflict_rule"),
        F.when(F.col("expects_no_conflict"), no("workers")).when(expects | ~scored, False).otherwise(no("contradict")).alias("false_positive_conflict"),
    )


def evaluate(gold: DataFrame, pool: DataFrame, final: DataFrame, found: DataFrame, resolutions: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """EVL-5: all metrics, a row for each question."""
    rows = gold.join(answers.select("qid", "text", "refused"), "qid", "left")
    low = F.lower(F.coalesce("text", F.lit("")))
    ok = F.when(F.size("relevant") == 0, True).otherwise(F.forall("must_contain", lambda s: F.contains(low, F.lower(s))))
    bad = ~F.exists("must_not_contain", lambda s: F.contains(low, F.lower(s)))
    base = rows.select("qid", (F.size("relevant") > 0).alias("ranked"), F.col("expects_conflict").alias("conflict_expected"), F.col("expects_refusal").alias("refusal_expected"), "expects_no_conflict", F.coalesce("refused", F.lit(True)).alias("refused"), ok.alias("contains_ok"), bad.alias("excludes_ok"))
    base = base.withColumn("refusal_correct", F.col("refused") == F.col("refusal_expected"))
    for part in (ranking_metrics(final, pool, gold, chunks), source_metrics(final, gold), displacement(final, gold), conflict_metrics(found, resolutions, gold)):
        base = base.join(part, "qid", "left")
    return base


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """EVL-7: one row, or one for each value of ``by``. Ranking means run over the questions that expect no refusal, a metric that is not there counting 0; displacement is the mean way, up or down, of the best relevant chunk where there is one; conflicts count where one is expected and none is wrong."""
    scored = ~F.col("refusal_expected")
    expects = F.coalesce(F.col("conflict_expected"), F.lit("")) != ""
    mean = lambda c, when=F.lit(True), digits=4: F.coalesce(F.bround(F.avg(F.when(when, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), digits), F.lit(0.0)).alias(c)
    scores = scores.withColumn("moved", F.abs("gold_displacement"))
    return scores.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count(F.when(scored, 1)).alias("ranked_questions"), *[mean(c, scored) for c in ("ndcg10", "recall5", "recall10", "recall20_pool", "mrr", "source_recall", "source_precision", "promoted_into_top3")],
        mean("moved", scored & F.col("moved").isNotNull(), 3).alias("gold_displacement"), mean("conflict_detected", expects & ~F.coalesce("false_positive_conflict", F.lit(False))), mean("false_positive_conflict"), mean("refusal_correct"), mean("contains_ok"), mean("excludes_ok"),
    )


def place_in_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``place`` (0, 1, ...) of each row in its group and ``n``, the group's size. No task sorts a whole group: rows are dealt by ranges of (group, order), and only a row for each range and group is summed up."""
    from ..session import settle

    dealt = settle(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    parts = dealt.groupBy("_part", *group).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    w = Window.partitionBy(*group)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_rows").over(w))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("_part", *group)]
    joined = dealt.alias("r").join(parts.alias("p"), reduce(lambda x, y: x & y, same))
    return joined.select("r.*", "p._first", "p._before", "p.n").withColumn("place", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def nearest_ranks(rows: DataFrame, group: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """EVL-8: for each group and name, the value at index floor(n * percent / 100) of the sorted values, the last at most; nulls do not count."""
    placed = place_in_group(rows.where(F.col(value).isNotNull()).select(*group, value), group, [value])
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    return placed.groupBy(*group).agg(*[F.max(F.when(F.col("place") == at(p), F.col(value))).alias(name) for name, p in percents.items()])


#: Chances that a Poisson draw of mean 1 is at most 0, 1, ...; beyond the last lies less than one draw in 10^9.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def bootstrap_samples(values: DataFrame, metric: str, samples: int = 1000, seed: int = 42, by: tuple[str, ...] = (), key: str = "qid") -> DataFrame:
    """(by, sample, mean): the means of ``samples`` resamples of a metric, in one aggregate. In each sample a row counts as often as a Poisson draw of mean 1 says, which a hash of (seed, sample, key) decides; a row needs no other row, so nothing is gathered. Nulls do not count."""
    rows = values.where(F.col(metric).isNotNull()).select(*by, F.col(key).alias("_key"), F.col(metric).cast("double").alias("_value"))
    drawn = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("sample").cast("string"), F.col("_key").cast("string"))), 1, 12)
    chance = F.conv(digits, 16, 10).cast("double") / float(1 << 48)
    weight = sum((chance >= p).cast("int") for p in POISSON)
    sums = drawn.withColumn("_weight", weight).groupBy(*by, "sample").agg(F.sum("_weight").alias("n"), F.sum(F.col("_weight") * F.col("_value")).alias("total"))
    return sums.where("n > 0").select(*by, "sample", (F.col("total") / F.col("n")).alias("mean"))


def bootstrap_interval(values: DataFrame, metric: str, samples: int = 1000, seed: int = 42, by: tuple[str, ...] = (), key: str = "qid") -> DataFrame:
    """EVL-9: (by, mean, low, high): the mean, and the means at 2.5 and 97.5 percent of the samples' sorted ones. No rows give no interval."""
    means = bootstrap_samples(values, metric, samples, seed, by, key).groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("means"))  # as many as there are samples
    n = F.size("means")
    at = lambda p: F.try_element_at("means", F.least(n, F.floor(n * p).cast("int") + 1))
    whole = values.groupBy(*by).agg(F.avg(F.col(metric).cast("double")).alias("mean"))
    found = means.select(*by, at(0.025).alias("low"), at(0.975).alias("high"))
    return whole.where("mean is not null").join(found, list(by)) if by else whole.where("mean is not null").crossJoin(F.broadcast(found))


def traces(analysed: DataFrame, pool: DataFrame, hits: DataFrame, stats: DataFrame | None, final: DataFrame, found: DataFrame, resolutions: DataFrame, answers: DataFrame, config_name: str = "default") -> DataFrame:
    """TRC-1: one nested record for each question."""
    per = hits.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("bm25_hits", "dense_hits", "fused", "top_score").alias("s"))))).alias("per_source"))
    spread = pool.groupBy("qid", "source").agg(F.count("*").alias("n")).groupBy("qid").agg(F.sum("n").alias("candidates_considered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("candidate_distribution"))
    weights = pool.groupBy("qid", "source").agg(F.bround(F.max("source_weight"), 4).alias("w")).groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "w")))).alias("weights_applied"))
    chunk = F.struct("rank_after", "chunk_id", "source", "rank_before", "rank_delta", *[F.bround(F.col(c), d).alias(c) for c, d in (("retrieval_score", 6), ("ce_score", 6), ("final_score", 6), ("authority", 4), ("recency", 4), ("source_weight", 4))], F.col("version_own").alias("version"), "context_header")
    chosen = final.groupBy("qid").agg(F.array_sort(F.collect_list(chunk)).alias("final_chunks"))
    pair = lambda *more: F.array_sort(F.collect_list(F.struct("finding", F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"), "relationship", "topic", *more)))
    made = resolutions.groupBy("qid").agg(pair(F.bround("confidence", 3).alias("confidence"), F.substring("claim_a", 1, 240).alias("claim_a"), F.substring("claim_b", 1, 240).alias("claim_b"), "rule_fired", "winner", "loser", "explanation", F.col("must_disclose").alias("disclosed"), "detector").alias("conflicts"))
    from .conflicts import CONFLICTS

    others = found.where(~F.col("relationship").isin(*CONFLICTS)).groupBy("qid").agg(pair().alias("non_conflict_findings"))
    rows = analysed
    for part in (per, spread, weights, chosen, made, others, answers.select("qid", "text", "refused", "generator", "citations", "source_distribution")):
        rows = rows.join(part, "qid", "left")
    if stats is not None:
        rows = rows.join(stats.select("qid", F.struct(*[F.bround(F.col(c).cast("double"), 4).alias(c) for c in stats.columns if c != "qid"]).alias("rerank")), "qid", "left")
    else:
        rows = rows.withColumn("rerank", F.lit(None).cast("struct<reranked: double>"))
    return rows.select(
        F.expr("uuid()").alias("trace_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), F.lit(config_name).alias("config"), "query",
        F.struct("intent", "product_area", "version_mentioned", "expanded_queries", "entities", "requires_canonical_answer", "classifier").alias("analysis"), "weights_applied",
        F.struct("per_source", "candidates_considered", "candidate_distribution", "non_conflict_findings").alias("retrieval"), "rerank", "final_chunks", "source_distribution", "conflicts", "citations", F.col("text").alias("answer_text"), "refused", "generator",
        F.create_map().cast("map<string,double>").alias("timing_ms"),
    )


def explain_trace(trace: dict) -> str:
    """TRC-2: a trace as text."""
    about = trace.get("analysis") or {}
    lines = [f"{trace['query']}", f"  config {trace['config']}  intent {about.get('intent')}  area {about.get('product_area')}  version {about.get('version_mentioned')}", "  after before  score   ce      chunk"]
    for c in trace.get("final_chunks") or []:
        ce = "-" if c.get("ce_score") is None else f"{c['ce_score']:.4f}"
        lines.append(f"  {c['rank_after']:>5} {c['rank_before']:>6}  {c['final_score']:.4f}  {ce:>6}  {c['chunk_id']}")
    lines += [f"  conflict {c['topic']}: {c['relationship']} by {c['rule_fired']} -> {c['winner']}" for c in trace.get("conflicts") or []]
    return "\n".join([*lines, "  refused" if trace.get("refused") else "", trace.get("answer_text") or ""])


@dataclass
class Stages:
    """TRC-3: the stages of a run with their times. A stage is timed over the action that writes its table; its rows are counted by that same action."""

    timing_ms: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def timed(self, stage: str):
        began = time.perf_counter()
        yield
        self.timing_ms[stage] = round(self.timing_ms.get(stage, 0.0) + (time.perf_counter() - began) * 1000, 2)

    def written(self, stage: str, make: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``write`` of what ``make`` plans, timed together, as planning may run jobs too; rows are observed on the way."""
        seen = Observation(stage)
        with self.timed(stage):
            found = write(make().observe(seen, F.count(F.lit(1)).alias("rows")))
        self.rows[stage] = int(seen.get["rows"])
        return found

    def table(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the batch's times as the map timing_ms."""
        pairs = [x for name, ms in self.timing_ms.items() for x in (F.lit(name), F.lit(float(ms)))]
        return rows.withColumn("timing_ms", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>"))
