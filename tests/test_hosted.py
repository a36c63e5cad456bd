"""Hosted stages: fallback question by question, and jobs that resume."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.answers import WRITTEN
from tidemark.operators.conflicts import PAIRS
from tidemark.operators.questions import ANALYSIS, analyse
from tidemark.plans.engine import Engine
from tidemark.plans.hosted import ask, cross_encoder, encoded, stored_answers
from tidemark.sources.corpus import read_corpus, read_gold

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.build(read_corpus(spark, f"{HERE}/docs", f"{HERE}/threads.json", f"{HERE}/articles.json"))


def test_only_failed_questions_go_to_the_rules(spark):
    """Of 40 questions every fifth fails, one gets a wrong shape, one is left out: those and no others are the rules'."""
    from tidemark.operators.questions import hosted_analysis
    from tidemark.plans.hosted import or_rules

    queries = spark.createDataFrame([(f"q{i}", f"How do I set max_retries {i}?") for i in range(40)], "qid string, query string").repartition(3)

    def call(row):
        if int(row["qid"][1:]) % 5 == 0:
            raise TimeoutError(f"no answer to {row['qid']}")
        if row["qid"] == "q7":
            return [{"intent": 5}]
        return [{"intent": "opinion" if row["qid"] != "q8" else "no such intent", "version_mentioned": None, "product_area": "cli", "entities": ["max_retries"], "expanded_queries": ["a", "b", "c", "d", "e"]}]

    answered = ask(queries.where("qid <> 'q9'"), call, ANALYSIS)
    errors = {r.qid: r.error for r in answered.where("error is not null").collect()}
    assert errors["q5"] == "TimeoutError: no answer to q5" and set(errors) == {f"q{i}" for i in range(0, 40, 5)} | {"q7"}
    seen = []

    def rules(rows):
        seen.extend(r.qid for r in rows.collect())
        return analyse(rows, EngineConfig())

    out = or_rules(queries, answered, rules, lambda given: hosted_analysis(queries, given, EngineConfig()))
    rows = {r.qid: r for r in out.collect()}
    assert len(rows) == 40 and sorted(seen) == sorted({*errors, "q9"})
    assert {q for q, r in rows.items() if r.classifier == "rules"} == set(seen)
    assert rows["q1"].intent == "opinion" and rows["q8"].intent == "unknown" and rows["q1"].all_queries == ["How do I set max_retries 1?", "a", "b", "c"]
    plain = {r.qid: r for r in analyse(queries, EngineConfig()).collect()}
    assert all(rows[q] == plain[q] for q in seen)


def test_all_stages_by_question(engine, spark):
    """One of several questions fails in each stage; the others keep the hosted results, and a wrong chunk is not taken."""
    gold = read_gold(spark, f"{HERE}/gold.yaml").select("qid", "query")
    plain = engine.run(gold)

    def analyser(queries):
        def call(row):
            if row["qid"] == "q1":
                raise OSError("network")
            return [{"intent": "opinion", "version_mentioned": None, "product_area": None, "entities": [], "expanded_queries": None}]

        return ask(queries, call, ANALYSIS)

    def detector(analysed, final):
        rows = final.groupBy("qid").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))

        def call(row):
            if row["qid"] == "q2":
                raise OSError("network")
            a, b = row["ids"][:2]
            same = {"topic": "t", "relationship": "contradict", "reconcilable": False, "confidence": 0.9, "claim_a": "x", "claim_b": "y"}
            return [] if row["qid"] == "q4" else [{"chunk_id_a": a, "chunk_id_b": b, **same}, {"chunk_id_a": a, "chunk_id_b": "made up", **same}]

        return ask(rows, call, PAIRS)

    def synthesizer(analysed, final, resolutions):
        def call(row):
            if row["qid"] == "q2":
                return None
            return [{"text": f"About {row['query']}", "cited": [row["best"], "made up"]}]

        best = final.where("rank_after = 1").select("qid", F.col("chunk_id").alias("best"))
        return ask(analysed.select("qid", "query").join(best, "qid"), call, WRITTEN)

    run = Engine(engine.index, engine.config, analyser=analyser, detector=detector, synthesizer=synthesizer).run(gold)
    assert {r.qid: r.classifier for r in run.analysed.collect()} == {"q1": "rules", "q2": "hosted", "q3": "hosted", "q4": "hosted"}
    found = {(r.qid, r.detector, r.chunk_id_b) for r in run.findings.collect()}
    assert {q for q, d, _ in found if d == "hosted"} - {"q3"} == {"q1"} and {q for q, d, _ in found if d == "rules"} == {"q2"} and "made up" not in {b for *_, b in found}
    answers = {r.qid: r for r in run.answers.collect()}
    assert {q: r.generator for q, r in answers.items() if q != 'q3'} == {"q1": "hosted", "q2": "extractive", "q4": "hosted"}, answers
    assert answers["q1"].text.startswith("About ") and [c.chunk_id for c in answers["q1"].citations] == [run.final.where("qid = 'q1' and rank_after = 1").first().chunk_id]
    assert run.findings.columns == plain.findings.columns and run.answers.schema.simpleString() == plain.answers.schema.simpleString() and run.analysed.columns == plain.analysed.columns
    assert run.resolutions.where("qid = 'q1' and rule_fired = 'authority_canonical'").count() <= 1 and run.traces.count() == 4


def test_a_bug_in_a_stage_is_no_outage(engine, spark):
    def broken(queries):
        raise LookupError("a wrong column")

    with pytest.raises(LookupError):
        Engine(engine.index, engine.config, analyser=broken).run(spark.createDataFrame([("q", "retries")], "qid string, query string"))


class Counting:
    """Writes down what it is asked; stops working after so many requests."""

    def __init__(self, folder, requests=None):
        self.folder, self.requests = str(folder), requests

    def __call__(self, texts):
        at = f"{self.folder}/asked"
        before = open(at).read().count("\n--\n") if os.path.exists(at) else 0
        if self.requests is not None and before >= self.requests:
            raise ConnectionError("killed")
        with open(at, "a") as f:
            f.write("\n".join(map(str, texts)) + "\n--\n")
        return [[float(len(str(t))), 1.0] for t in texts]

    def asked(self):
        return [line for line in open(f"{self.folder}/asked").read().split("\n") if line and line != "--"]


def test_a_killed_job_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 50}", "kept") for i in range(120)] + [(200, None, "kept")], "id long, text string, answer string").repartition(4)
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="killed"):
        stored_answers(rows, ["text"], Counting(tmp_path, 6), "array<double>", path, batch=4, tasks=1)
    half = len(Counting(tmp_path).asked())
    assert 15 < half < 40
    done = stored_answers(rows, ["text"], Counting(tmp_path), "array<double>", path, batch=4, tasks=1)
    assert {(r.id, r.answer[0]) for r in done.collect()} == {(i, float(len(f"text {i % 50}"))) for i in range(120)} | {(200, 0.0)}
    asked = Counting(tmp_path).asked()
    assert len(asked) == len(set(asked)) == 50
    # A later run with new texts asks for those alone.
    more = rows.unionByName(spark.createDataFrame([(300, "new one", "x")], rows.schema))
    stored_answers(more, ["text"], Counting(tmp_path), "array<double>", path, batch=4, tasks=1).count()
    assert Counting(tmp_path).asked()[len(asked) :] == ["new one"]


def test_encoder_and_cross_encoder(engine, spark, tmp_path):
    vectors = encoded(engine.index.chunks, Counting(tmp_path), str(tmp_path / "v"))
    assert vectors.count() == engine.index.chunks.count() and vectors.where(F.abs(F.col("vector")[0] * F.col("vector")[0] + F.col("vector")[1] * F.col("vector")[1] - 1) > 1e-9).count() == 0
    scorer = cross_encoder(lambda pairs: [float(len(q) + len(t)) for q, t in pairs], str(tmp_path / "c"))
    run = Engine(engine.index, engine.config, scorer=scorer).run(spark.createDataFrame([("q", "What is the maximum payload size?")], "qid string, query string"))
    assert all(r.ce_score == len(r.query) + len(r.text) for r in run.final.collect()) and run.final.count() > 0
    assert stored_answers(spark.createDataFrame([], "text string"), ["text"], Counting(tmp_path), "double", str(tmp_path / "none")).count() == 0
