"""The engine on an authored corpus with planted conflicts."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import EngineConfig, coerce
from tidemark.operators.evaluation import conflict_metrics, explain_trace, nearest_ranks, place_in_group, summary
from tidemark.plans.engine import Engine
from tidemark.sources.corpus import append_traces, read_corpus, read_gold, read_traces, undated, write_chunks

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="module")
def corpus(spark):
    return read_corpus(spark, f"{HERE}/docs", f"{HERE}/threads.json", f"{HERE}/articles.json")


@pytest.fixture(scope="module")
def engine(corpus):
    return Engine.build(corpus)


@pytest.fixture(scope="module")
def run(engine, spark):
    return engine.run(read_gold(spark, f"{HERE}/gold.yaml").select("qid", "query"))


def test_sources(corpus, spark):
    docs = {r.doc_id: r for r in corpus["docs"].collect()}
    assert set(docs) == {"retries", "limits", "plain-page"}
    assert docs["plain-page"].title == "Plain Page" and docs["plain-page"].body.startswith("--- not json")
    assert docs["retries"].version == "3.2" and docs["retries"].body.startswith("# Retries")
    assert corpus["forum"].where("doc_id = 't1'").first().body.startswith("My job")
    assert undated(corpus["blog"]).count() == 0


def test_chunks(engine, tmp_path, spark):
    rows = {r.chunk_id: r for r in engine.index.chunks.collect()}
    assert "forum:t1:p2" in rows and "forum:t1:p4" not in rows
    answer = rows["forum:t1:p2"]
    assert "FOLLOW-UP (user, 1 votes):" in answer.display_text and "quoted line" not in answer.display_text
    assert answer.context_header == 'Product Forum > solved > v2.4 > "Retries never stop" > accepted answer by user'
    assert rows["forum:t3:p1"].unanswered and rows["forum:t3:p1"].context_header.endswith("original question")
    assert rows["blog:a1:w0"].context_header == 'Product Blog > 2025-08-12 (v2.4 era) > staff > "Why queues"'
    assert all(r.text == f"{r.context_header}\n\n{r.display_text}" for r in rows.values())
    write_chunks(engine.index.chunks, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks")).count() == len(rows)


def test_analysis(run):
    rows = {r.qid: r for r in run.analysed.collect()}
    assert (rows["q1"].intent, rows["q1"].product_area) == ("api_reference", "retries")
    assert rows["q4"].intent == "troubleshooting" and rows["q4"].entities == ["Retry-After", "429"]
    assert rows["q2"].requires_canonical_answer and rows["q2"].all_queries[0] == "What is the maximum payload size?"


def test_pool_and_final(run):
    pool = run.pool.where("qid = 'q1'").orderBy("rank_before").collect()
    assert [r.rank_before for r in pool] == list(range(1, len(pool) + 1))
    assert {r.source for r in pool} == {"docs", "forum", "blog"}
    final = run.final.where("qid = 'q1'").collect()
    assert sorted(r.rank_after for r in final) == list(range(1, len(final) + 1)) and len(final) <= 8
    assert all(r.rank_delta == r.rank_before - r.rank_after for r in final)


def test_conflicts(run):
    found = {(r.qid, r.topic): r for r in run.resolutions.collect()}
    versions = found["q1", "max_retries_default"]
    assert (versions.relationship, versions.winner, versions.rule_fired) == ("version_drift", "both", "version_scoping")
    sizes = found["q2", "max_payload_bytes"]
    assert sizes.relationship == "misconception" and sizes.winner.startswith("docs:limits") and "1000000" in sizes.claim_a + sizes.claim_b
    header = found["q4", "retry_after_honoured"]
    assert (header.relationship, header.winner) == ("empirical_override", "disclose_both")


def test_answers(run):
    rows = {r.qid: r for r in run.answers.collect()}
    assert rows["q3"].refused and rows["q3"].citations == [] and "out of scope" in rows["q3"].text
    assert not rows["q1"].refused and "max_retries defaults to" in rows["q1"].text and "### Note on conflicting information" in rows["q1"].text
    assert rows["q2"].citations[0].source == "docs"


def test_evaluation(engine, spark):
    scores, row = engine.evaluate(read_gold(spark, f"{HERE}/gold.yaml"))
    got = row.first()
    assert got.questions == 4 and got.ranked_questions == 3
    assert 0.5 < got.ndcg10 <= 1 and got.mrr > 0.5 and got.refusal_correct == 1.0 and got.conflict_detected == 1.0
    low, high = engine.confidence(scores)
    assert low <= got.ndcg10 <= high


def test_traces(run, tmp_path, spark):
    path = str(tmp_path / "log")
    append_traces(run.traces, path)
    append_traces(run.traces, path)
    last = read_traces(spark, path, 3, "payload")
    assert last.count() == 2
    assert "conflict max_payload_bytes" in explain_trace(last.first().asDict(recursive=True))


def test_every_stage_has_a_time(run):
    """The times are those of the actions that write the stages, and the same actions count the rows."""
    stages = {"analysis", "retrieval", "rerank", "contradiction", "resolution", "generation"}
    assert all(set(r.timing_ms) == stages and min(r.timing_ms.values()) > 0 for r in run.traces.collect())
    assert run.stages.rows == {"analysis": run.analysed.count(), "retrieval": run.pool.count(), "rerank": run.final.count(), "contradiction": run.findings.count(), "resolution": run.resolutions.count(), "generation": run.answers.count()}


def test_ask(engine):
    assert engine.ask("hi there").first().kind == "greeting"
    assert engine.ask("What is the maximum payload size?").first().kind == "answer"


def test_config():
    config = EngineConfig().with_overrides(["rerank.alpha=0.5", "rerank.mmr.enabled=false"])
    assert config.get("rerank.alpha") == 0.5 and config.get("rerank.mmr.enabled") is False and EngineConfig().get("rerank.alpha") == 0.7
    assert coerce("1,2") == [1, 2] and coerce("none") is None and coerce("x") == "x"


def test_unknown_backend(engine, spark):
    other = Engine(engine.index, EngineConfig().variant({"rerank.backend": "listwise"}))
    with pytest.raises(ValueError):
        other.run(spark.createDataFrame([("q", "retries")], "qid string, query string"))


def test_nearest_rank(spark):
    rows = spark.range(1, 16).select(F.lit("a").alias("g"), "id").unionByName(spark.range(5).select(F.lit(None).cast("string").alias("g"), F.lit(7).cast("long").alias("id"))).unionByName(spark.range(3).select(F.lit("b").alias("g"), F.lit(None).cast("long").alias("id")))
    got = {r.g: (r.p95, r.p50) for r in nearest_ranks(rows.repartition(7), ["g"], "id", {"p95": 95, "p50": 50}).collect()}
    assert got == {"a": (15, 8), None: (7, 7)}
    placed = place_in_group(spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(9), ["g"], ["id"]).collect()
    assert all(r.place == r.id // 3 and r.n == 334 - (r.g > 0) for r in placed)


def test_summary_and_conflict_scores(spark):
    """Ways up and down do not cancel; no relevant chunk is no promotion; unlabelled questions have no conflict."""
    fields = "qid string, refusal_expected boolean, conflict_expected string, ndcg10 double, recall5 double, recall10 double, recall20_pool double, mrr double, source_recall double, source_precision double, gold_displacement int, promoted_into_top3 boolean, conflict_detected boolean, false_positive_conflict boolean, refusal_correct boolean, contains_ok boolean, excludes_ok boolean"
    rows = [("a", False, "c1", 0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 4, True, True, False, True, True, True), ("b", False, None, 1.0, 0.0, 0.5, 0.5, 0.5, None, None, -2, False, False, True, True, False, True), ("c", False, "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, False, False, True, True, True), ("d", True, None, None, None, None, None, None, None, None, None, None, False, False, False, True, True)]
    got = summary(spark.createDataFrame(rows, fields)).first()
    assert (got.questions, got.ranked_questions, got.ndcg10, got.gold_displacement, got.promoted_into_top3) == (4, 3, 0.5, 3.0, 0.3333)
    assert (got.conflict_detected, got.false_positive_conflict, got.refusal_correct, got.source_recall) == (1.0, 0.25, 0.75, 0.3333)
    gold = spark.createDataFrame([("x", [], None, False), ("y", [("l", 2)], None, False), ("z", [], None, True)], "qid string, relevant array<struct<label: string, grade: int>>, expects_conflict string, expects_no_conflict boolean")
    found = spark.createDataFrame([(q, "contradict") for q in "xyz"] + [("z", "complementary")], "qid string, relationship string")
    made = spark.createDataFrame([(q, 1, "t", "contradict", "unresolved") for q in "xyz"], "qid string, finding int, topic string, relationship string, rule_fired string")
    assert {r.qid: (r.conflict_detected, r.false_positive_conflict) for r in conflict_metrics(found, made, gold).collect()} == {"x": (False, False), "y": (False, True), "z": (False, False)}


def test_without_reranking_every_question_is_refused(engine, spark):
    from tidemark.config import VARIANTS

    run = Engine(engine.index, engine.config.variant(VARIANTS["expansion"])).run(spark.createDataFrame([("q", "What is the maximum payload size?")], "qid string, query string"))
    assert run.stats is None and run.answers.first().refused
    assert [r.rank_after for r in run.final.orderBy("rank_after").collect()] == list(range(1, run.final.count() + 1))
    assert run.traces.first().rerank is None
