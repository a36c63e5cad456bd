"""Reranking and selection (RRK-1 to RRK-16) over candidates (qid, chunk_id, ...), at most the pool's size for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.text import jaccard, tokenize
from ..session import packed

# Weights of the features.
WEIGHTS = {"coverage": 0.34, "proximity": 0.16, "phrase": 0.14, "identifier": 0.18, "position": 0.08, "version": 0.10}
BACKENDS = ("surrogate",)
#: Rows of scores that are sent to the candidates.
SCORES_AT_ONCE = 1 << 17


def pair_up(tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda x: x))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pool_idf(candidates: DataFrame) -> DataFrame:
    """RRK-1: (qid, idf map) over each question's candidates, for the question's terms that any of them has."""
    met = candidates.select("qid", F.explode(F.array_intersect("q_unique", "tokens")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    sizes = candidates.groupBy("qid").agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.col("n") + 1.0) / (F.col("df") + 0.5))
    return met.join(sizes, "qid").groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", idf.alias("idf")))).alias("idf"))


def features(candidates: DataFrame) -> DataFrame:
    """RRK-2 to RRK-8: the six features and ce_score."""
    rows = candidates.withColumn("q_tokens", tokenize(F.col("query"))).withColumn("q_unique", F.array_distinct("q_tokens"))
    # Written, so that Spark knows how small it is and moves no text to it.
    rows = rows.join(packed(pool_idf(rows)), "qid", "left")
    idf = lambda t: F.coalesce(F.try_element_at(F.col("idf"), t), F.lit(1.0))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + idf(t))
    found = F.array_intersect("q_unique", "tokens")
    n = F.size("tokens")
    first = F.transform(found, lambda t: F.array_position("tokens", t) - 1)
    last = let(F.reverse("tokens"), lambda back: F.transform(found, lambda t: n - F.array_position(back, t)))
    span = F.array_max(last) - F.array_min(first) + 1
    bigrams = pair_up(F.col("q_tokens"))
    # Tokens have no spaces, so a pair of neighbours is a part of the joined text.
    spaced = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    hits = F.size(F.filter("entities", lambda e: F.contains(F.lower("text"), F.lower(e))))
    major = lambda c: F.split(F.col(c), r"\.")[0]
    rows = (
        rows.withColumn("coverage", F.when(total(F.col("q_unique")) > 0, total(found) / total(F.col("q_unique"))).otherwise(0.0))
        .withColumn("proximity", F.when(F.size(found) == 0, 0.0).when(F.size(found) == 1, 1.0).otherwise(F.least(F.lit(1.0), F.size(found) / F.greatest(span, F.size(found)))))
        .withColumn("phrase", F.when(F.size("q_tokens") < 2, 0.0).otherwise(F.size(let(spaced, lambda whole: F.filter(bigrams, lambda b: F.contains(whole, F.concat(F.lit(" "), b, F.lit(" ")))))) / F.size(bigrams)))
        .withColumn("identifier", F.when(F.size("entities") == 0, 0.0).otherwise(hits / F.size("entities")))
        .withColumn("position", F.when(F.size(found) == 0, 0.0).otherwise(1 - F.array_min(first) / n))
        .withColumn("version_match", F.when(F.col("version_mentioned").isNull() | F.col("version_own").isNull(), 0.5).when(major("version_mentioned") != major("version_own"), 0.0).when(F.col("version_mentioned") == F.col("version_own"), 1.0).otherwise(0.75))
    )
    score = sum(w * F.col("version_match" if name == "version" else name) for name, w in WEIGHTS.items())
    return rows.withColumn("ce_score", F.when((F.size("q_tokens") == 0) | (n == 0), 0.0).otherwise(F.round(score, 12))).drop("idf")


def min_max(value: Column, *by: str) -> Column:
    """RRK-11: to 0..1 within a question; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-12, 0.5).otherwise((value - low) / (high - low))


def blend(scored: DataFrame, alpha: float) -> DataFrame:
    """RRK-12: alpha of the reranker's score and the rest of the retrieval score; blend_rank by it."""
    rows = scored.withColumn("ce_norm", min_max(F.col("ce_score"), "qid")).withColumn("ret_norm", min_max(F.col("retrieval_score"), "qid"))
    rows = rows.withColumn("final_score", F.round(alpha * F.col("ce_norm") + (1 - alpha) * F.col("ret_norm"), 12))
    return rows.withColumn("blend_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final_score"), "chunk_id")))


def quota_pick(items: Column, k: int, per_source: int, per_document: int) -> Column:
    """RRK-13 on a sorted array of (source, doc, ...): positions (from 0) taken in order while the quotas last, then the first of those passed over.

    A fold: a row passed over uses up no quota, so two rank filters would not do.
    """
    count = lambda chosen, field, x: F.size(F.filter(chosen, lambda i: F.element_at(items, i + 1)[field] == x[field]))
    none = F.array().cast("array<int>")

    def place(state: Column, i: Column) -> Column:
        x = F.element_at(items, i + 1)
        fits = (F.size(state["chosen"]) < k) & (count(state["chosen"], "source", x) < per_source) & (count(state["chosen"], "doc", x) < per_document)
        return F.struct(F.when(fits, F.concat(state["chosen"], F.array(i))).otherwise(state["chosen"]).alias("chosen"), F.when(fits, state["passed"]).otherwise(F.concat(state["passed"], F.array(i))).alias("passed"))

    every = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(none)
    return F.aggregate(every, F.struct(none.alias("chosen"), none.alias("passed")), place, lambda s: F.slice(F.concat(s["chosen"], s["passed"]), 1, k))


def mmr_order(items: Column, k: int, weight: float) -> Column:
    """RRK-14 on a sorted array of (final_score, display_tokens, ...): the first, then again and again the one with the best weight * score - (1 - weight) * largest similarity to those chosen; the first of equals. Positions from 0.

    The sets of words are made once, and the fold keeps each item's largest similarity so far, so a step compares each with the one chosen last.
    """
    sets = F.transform(items, lambda x: F.struct(x["final_score"].alias("final_score"), F.array_distinct(x["display_tokens"]).alias("words")))
    return let(sets, lambda known: mmr_fold(known, k, weight))


def mmr_fold(items: Column, k: int, weight: float) -> Column:
    every = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    if weight >= 1:
        return F.slice(every, 1, k)

    def add(state: Column, _: Column) -> Column:
        last = F.element_at(items, F.element_at(state["chosen"], -1) + 1)["words"]
        like = F.zip_with(state["like"], items, lambda m, x: F.greatest(m, jaccard(x["words"], last)))
        value = lambda i, m: F.round(weight * F.element_at(items, i + 1)["final_score"] - (1 - weight) * m, 12)
        left = F.filter(F.zip_with(every, like, lambda i, m: F.struct(value(i, m).alias("v"), (-i).alias("i"))), lambda x: ~F.array_contains(state["chosen"], -x["i"]))
        return F.struct(F.concat(state["chosen"], F.array(-F.array_max(left)["i"])).alias("chosen"), like.alias("like"))

    start = F.struct(F.array(F.lit(0)).alias("chosen"), F.transform(items, lambda _: F.lit(0.0)).alias("like"))
    return F.when(F.size(items) == 0, every).otherwise(F.aggregate(F.slice(every, 2, k - 1), start, add, lambda state: state["chosen"]))


def select(blended: DataFrame, config: EngineConfig) -> DataFrame:
    """RRK-13, RRK-14: rank_after of the chunks that stay. Only the tokens of those within the quotas are moved, as MMR orders no others."""
    k = config.get("rerank.final_k")
    item = F.struct(F.col("blend_rank"), "chunk_id", "source", F.split("chunk_id", ":")[1].alias("doc"), "final_score")
    sets = blended.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    caps = config.get("rerank.caps")
    taken = F.array_sort(quota_pick(F.col("items"), k, caps["max_per_source"], caps["max_per_document"]))
    sets = sets.withColumn("items", F.transform(taken, lambda i: F.element_at("items", i + 1)))
    mmr = config.get("rerank.mmr")
    if mmr["enabled"]:
        within = packed(sets.select("qid", F.explode("items.blend_rank").alias("blend_rank")))
        item = F.struct("blend_rank", "chunk_id", "final_score", "display_tokens")
        sets = blended.join(within, ["qid", "blend_rank"]).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    order = mmr_order(F.col("items"), k, mmr["lambda"]) if mmr["enabled"] else F.transform("items", lambda _, i: i)
    chosen = sets.select("qid", "items", F.posexplode(order).alias("at", "i")).select("qid", F.element_at("items", F.col("i") + 1)["chunk_id"].alias("chunk_id"), (F.col("at") + 1).alias("rank_after"))
    return blended.join(packed(chosen), ["qid", "chunk_id"])


def statistics(blended: DataFrame, config: EngineConfig) -> DataFrame:
    """RRK-16."""
    moved = F.when(F.col("blend_rank") <= config.get("rerank.final_k"), F.abs(F.col("rank_before") - F.col("blend_rank")))
    changed = F.max(F.when((F.col("blend_rank") == 1) & (F.col("rank_before") != 1), 1).otherwise(0))
    return blended.groupBy("qid").agg(F.count("*").alias("reranked"), F.avg(moved).alias("mean_abs_rank_delta"), changed.alias("top1_changed"), F.min("ce_score").alias("ce_min"), F.max("ce_score").alias("ce_max"))


def rerank(candidates: DataFrame, config: EngineConfig, scorer=None) -> tuple[DataFrame, DataFrame | None]:
    """(final chunks with ce_score, final_score, rank_after and rank_delta; statistics). Without reranking, the first final_k as they are (RRK-15).

    ``scorer`` (RRK-9) is any DataFrame function that adds ce_score; an unknown backend raises (RRK-10).
    """
    if not config.get("rerank.enabled"):
        out = candidates.where(F.col("rank_before") <= config.get("rerank.final_k")).withColumn("ce_score", F.lit(None).cast("double"))
        return out.withColumn("final_score", F.col("retrieval_score")).withColumn("rank_after", F.col("rank_before")).withColumn("rank_delta", F.lit(0)), None
    if scorer is None and config.get("rerank.backend") not in BACKENDS:
        raise ValueError(f"unknown rerank backend {config.get('rerank.backend')!r}")
    scored = (scorer or features)(candidates.where(F.col("rank_before") <= config.get("rerank.rerank_top_n")))
    # Written once: selection and statistics read it three times. The scores are blended without the texts and go to the rows.
    scored = packed(scored.withColumn("_row", F.monotonically_increasing_id()))
    blended = packed(blend(scored.select("_row", "qid", "chunk_id", "ce_score", "retrieval_score"), config.get("rerank.alpha")).drop("qid", "chunk_id", "ce_score", "retrieval_score"))
    blended = scored.join(F.broadcast(blended) if blended.count() <= SCORES_AT_ONCE else blended, "_row").drop("_row")
    final = select(blended, config).withColumn("rank_delta", F.col("rank_before") - F.col("rank_after"))
    return final, statistics(blended, config)


def alpha_sweep(scored: DataFrame, steps: int = 10) -> DataFrame:
    """EVL-12: the blended order at alpha 0, 1/steps, ..., 1, in one plan."""
    alphas = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)).alias("alpha")
    rows = scored.withColumn("ce_norm", min_max(F.col("ce_score"), "qid")).withColumn("ret_norm", min_max(F.col("retrieval_score"), "qid")).select("*", alphas)
    rows = rows.withColumn("final_score", F.round(F.col("alpha") * F.col("ce_norm") + (1 - F.col("alpha")) * F.col("ret_norm"), 12))
    return rows.withColumn("blend_rank", F.row_number().over(Window.partitionBy("alpha", "qid").orderBy(F.desc("final_score"), "chunk_id")))
