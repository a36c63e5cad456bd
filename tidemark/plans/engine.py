"""The engine: build an index from a corpus, answer and evaluate batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VARIANTS, EngineConfig
from ..functions.text import is_small_talk
from ..operators.answers import answer, hosted_answers
from ..operators.chunking import chunk_corpus
from ..operators.conflicts import findings, hosted_findings, relevant, resolve
from ..operators.evaluation import Stages, bootstrap_interval, evaluate, summary, traces
from ..operators.index import Index, build_index
from ..operators.questions import analyse, hosted_analysis
from ..operators.rerank import blend, features, rerank, select
from ..operators.retrieval import candidates_of, retrieve, search_lists
from ..session import packed, settle
from .hosted import or_rules


@dataclass(frozen=True)
class Run:
    """All stages' tables for a batch of questions."""

    analysed: DataFrame
    pool: DataFrame
    hits: DataFrame
    final: DataFrame
    stats: DataFrame | None
    findings: DataFrame
    resolutions: DataFrame
    answers: DataFrame
    traces: DataFrame
    stages: Stages


class Engine:
    """A built corpus and a configuration.

    A stage can ask a hosted model (EXT-3), question by question: ``analyser(queries)``,
    ``detector(analysed, final)`` and ``synthesizer(analysed, final, resolutions)`` give
    (qid, result, error), as ``hosted.ask`` makes it, with results of the fields ANALYSIS,
    PAIRS and WRITTEN. Questions with an error, or without a row, go to the rules, and
    only those. ``scorer(candidates)`` adds ce_score (``hosted.cross_encoder``).
    """

    def __init__(self, index: Index, config: EngineConfig, analyser=None, scorer=None, detector=None, synthesizer=None):
        self.index, self.config, self.scorer = index, config, scorer
        self.analyser, self.detector, self.synthesizer = analyser, detector, synthesizer

    @classmethod
    def build(cls, corpus: dict[str, DataFrame], config: EngineConfig | None = None) -> Engine:
        config = config or EngineConfig()
        return cls(build_index(chunk_corpus(corpus, config), config, packed), config)

    def run(self, queries: DataFrame) -> Run:
        """Questions (qid, query) through all stages. A stage's table is written once, and its time goes into the traces."""
        config, index, stages = self.config, self.index, Stages()
        step = lambda name, make: stages.written(name, make, settle)
        rules = lambda rows: analyse(rows, config)
        analysed = step("analysis", lambda: rules(queries) if self.analyser is None else or_rules(queries, self.analyser(queries), rules, lambda given: hosted_analysis(queries, given, config)))
        with stages.timed("retrieval"):
            candidates, hits = retrieve(analysed, index, config)
        candidates = step("retrieval", lambda: candidates)
        with stages.timed("rerank"):
            final, stats = rerank(candidates, config, self.scorer)
        final = step("rerank", lambda: final)
        found = step("contradiction", lambda: self.found(analysed, final) if config.get("contradiction.enabled") else final.sparkSession.createDataFrame([], findings(final, config).schema))
        resolutions = step("resolution", lambda: resolve(relevant(analysed, found), config))
        write = lambda rows: answer(rows, final, resolutions, index, config)
        answers = step("generation", lambda: write(analysed) if self.synthesizer is None else or_rules(analysed, self.synthesizer(analysed, final, resolutions), write, lambda given: hosted_answers(analysed, final, given, index, config)))
        made = traces(analysed, candidates, hits, stats, final, found, resolutions, answers, config.get("experiment.name"))
        return Run(analysed, candidates, hits, final, stats, found, resolutions, answers, stages.table(made), stages)

    def found(self, analysed: DataFrame, final: DataFrame) -> DataFrame:
        config = self.config
        if self.detector is None:
            return findings(final, config)
        rules = lambda asked: findings(final.join(asked.select("qid"), "qid", "left_semi"), config)
        return or_rules(analysed, self.detector(analysed, final), rules, lambda given: hosted_findings(final, given, config))

    def ask(self, question: str) -> DataFrame:
        """One question as a batch of one; greetings get no retrieval."""
        spark = self.index.chunks.sparkSession
        rows = spark.createDataFrame([("q", question)], "qid string, query string")
        if rows.where(is_small_talk(F.col("query"))).isEmpty():
            return self.run(rows).answers.withColumn("kind", F.lit("answer"))
        return rows.select("qid", "query", F.lit("greeting").alias("kind"))

    def search(self, queries: DataFrame) -> DataFrame:
        """Both arms' raw lists."""
        return search_lists(analyse(queries, self.config), self.index, self.config)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.index.get(chunk_id)

    def meta(self) -> DataFrame:
        return self.index.counts()

    def evaluate(self, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(scores, summary): EVL-10."""
        run = self.run(gold.select("qid", "query"))
        scores = settle(evaluate(gold, run.pool, run.final, run.findings, run.resolutions, run.answers, self.index.chunks))
        return scores, summary(scores)

    def confidence(self, scores: DataFrame, metric: str = "ndcg10") -> tuple[float, float]:
        """EVL-9: the interval of a metric over the ranked questions; (0, 0) without any."""
        found = bootstrap_interval(scores.where("ranked"), metric, self.config.get("evaluation.bootstrap_samples"), self.config.get("experiment.seed")).first()
        return (found.low, found.high) if found else (0.0, 0.0)


def with_variant(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` once for each variant, whose name becomes a part of the question's id."""
    return rows.crossJoin(F.broadcast(names)).withColumn("qid", F.concat_ws("/", "variant", F.col("qid").cast("string"))).drop(*[c for c in names.columns])


def compared(index: Index, variants: dict[str, EngineConfig], queries: DataFrame) -> tuple[DataFrame, ...]:
    """(candidates, final, findings, resolutions, answers) of all ``variants`` of one index, under the ids variant/qid.

    Questions are analysed and searched once, with all arms and expansions that any
    variant has; a variant takes its lists out of those. From there on each stage runs
    once over the questions of all variants, with what they differ in as columns, but
    for reranking, which selects once for each way to select.
    """
    spark = index.chunks.sparkSession
    shared = next(iter(variants.values()))
    on = lambda c, path: bool(c.get(path))
    any_of = lambda path: any(on(c, path) for c in variants.values())
    widest = shared.variant({p: any_of(p) for p in ("index.bm25.enabled", "index.dense.enabled", "retrieval.query_analysis.expand_queries")})
    ways = {name: (on(c, "rerank.enabled"), str(c.get("rerank.caps")), str(c.get("rerank.mmr"))) for name, c in variants.items()}
    rows = [(name, on(c, "index.bm25.enabled"), on(c, "index.dense.enabled"), on(c, "retrieval.query_analysis.expand_queries"), float(c.get("rerank.alpha")), ways[name][0], str(ways[name])) for name, c in variants.items()]
    names = spark.createDataFrame(rows, "variant string, bm25 boolean, dense boolean, expand boolean, alpha double, reranked boolean, way string")
    full = settle(analyse(queries, widest))
    lists = settle(search_lists(full, index, widest))
    own = lists.crossJoin(F.broadcast(names)).where(F.when(F.col("arm") == "bm25", F.col("bm25")).otherwise(F.col("dense")) & (F.col("expand") | (F.col("qi") == 0)))
    own = own.withColumn("qid", F.concat_ws("/", "variant", F.col("qid").cast("string"))).select(*lists.columns)
    analysed = with_variant(full, names)
    candidates = settle(candidates_of(own, analysed, index, shared))
    flags = names.select("variant", "alpha", "reranked", "way")
    marked = candidates.withColumn("variant", F.substring_index("qid", "/", 1)).join(F.broadcast(flags), "variant")
    final = None
    scored = settle(blend(features(marked.where("reranked").where(F.col("rank_before") <= shared.get("rerank.rerank_top_n"))), F.col("alpha"))) if any(w[0] for w in ways.values()) else None
    for way in sorted(set(ways.values())):
        config = next(c for name, c in variants.items() if ways[name] == way)
        of = F.col("way") == str(way)
        one = select(scored.where(of), config).withColumn("rank_delta", F.col("rank_before") - F.col("rank_after")) if way[0] else rerank(marked.where(of), config)[0]
        final = one if final is None else final.unionByName(one, allowMissingColumns=True)
    final = settle(final.drop("variant", "alpha", "reranked", "way"))
    found = settle(findings(final, shared))
    resolutions = settle(resolve(relevant(analysed, found), shared))
    return candidates, final, found, resolutions, settle(answer(analysed, final, resolutions, index, shared))


def variant_scores(index: Index, variants: dict[str, EngineConfig], gold: DataFrame) -> DataFrame:
    """The scores of every question under every variant, with the variant."""
    names = index.chunks.sparkSession.createDataFrame([(n,) for n in variants], "variant string")
    candidates, final, found, resolutions, answers = compared(index, variants, gold.select("qid", "query"))
    scores = evaluate(with_variant(gold, names), candidates, final, found, resolutions, answers, index.chunks)
    return settle(scores.withColumn("variant", F.substring_index("qid", "/", 1)))


def ablations(spark: SparkSession, corpus: dict[str, DataFrame], gold: DataFrame, config: EngineConfig | None = None, variants: dict[str, dict] | None = None) -> DataFrame:
    """EVL-11: the summary of every named variant, with the interval of its ndcg10. Variants that chunk and index alike are compared in one run over one index."""
    config = config or EngineConfig()
    groups: dict[str, dict[str, EngineConfig]] = {}
    for name, overrides in (VARIANTS if variants is None else variants).items():
        # An index has both arms; the variant takes its own.
        key = str({k: v for k, v in overrides.items() if k.startswith(("chunking", "index")) and not k.endswith((".bm25.enabled", ".dense.enabled"))})
        groups.setdefault(key, {})[name] = config.variant(overrides)
    scores = None
    for own in groups.values():
        widest = next(iter(own.values())).variant({f"index.{arm}.enabled": any(c.get(f"index.{arm}.enabled") for c in own.values()) for arm in ("bm25", "dense")})
        one = variant_scores(Engine.build(corpus, widest).index, own, gold)
        scores = one if scores is None else scores.unionByName(one)
    interval = bootstrap_interval(scores.where("ranked"), "ndcg10", config.get("evaluation.bootstrap_samples"), config.get("experiment.seed"), ("variant",))
    return summary(scores, "variant").join(interval.select("variant", F.col("low").alias("ndcg10_low"), F.col("high").alias("ndcg10_high")), "variant", "left")
