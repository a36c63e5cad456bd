"""BM25 search that leaves out postings by upper bounds (RET-1 over blocks).

The postings of a source's term are cut into blocks by the size of their impact (the
part of a score that does not depend on the question). A question's k-th best score so
far is a floor under its answer, which rises in two steps; a block is read only if a
chunk of it could still reach the floor, and frequent terms, which together cannot reach
it, name no candidates: they are looked up for the candidates of the others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import packed

#: Steps of impact between 0 and k1 + 1; a step is a block.
STEPS = 32
#: Sums of the same numbers in another order differ by less than this.
SLACK = 1e-7
ASK = ("qid", "qi", "source")
#: Pairs of questions and postings that one task adds up, so that its table of sums stays small however large the batch.
PAIRS_OF_A_TASK = 1 << 19


def tasks_for(rows: DataFrame, pairs: str) -> int:
    """Among how many tasks to deal the pairs that the column ``pairs`` of ``rows`` adds up to."""
    found = rows.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(found) // PAIRS_OF_A_TASK))


def impact(k1: float, b: float) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def impacts(posts: DataFrame, sources: DataFrame, k1: float, b: float) -> DataFrame:
    """Postings with their impact and the step that it lies in."""
    rows = posts.join(sources.select("source", "avgdl"), "source").withColumn("impact", impact(k1, b))
    return rows.select("source", "term", "chunk_id", "doc_pos", "impact", F.floor(F.col("impact") * STEPS / (k1 + 1)).cast("int").alias("step"))


def impact_blocks(posts: DataFrame, sources: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(source, term, step, n, most): how many postings a block has, and their largest impact."""
    return impacts(posts, sources, k1, b).groupBy("source", "term", "step").agg(F.count("*").alias("n"), F.max("impact").alias("most"))


def block_choice(terms: DataFrame, stats: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(qid, qi, source, term, w, step, n, most, early, up): the blocks of each question's terms. ``early`` ones are a term's best that hold ``k`` postings; ``up`` is the term's largest part of a score."""
    asked = terms.join(stats.select("source", "term", "idf"), "term").select(*ASK, "term", (F.col("idf") * F.col("qtf")).alias("w"))
    own = Window.partitionBy(*ASK, "term")
    before = F.coalesce(F.sum("n").over(own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return asked.join(blocks, ["source", "term"]).withColumn("early", before < k).withColumn("up", F.max(F.col("w") * F.col("most")).over(own))


def kth_best(sums: DataFrame, k: int, score: str, name: str) -> DataFrame:
    """(qid, qi, source, name): the k-th largest of each list that has as many."""
    best = sums.withColumn("at", F.row_number().over(Window.partitionBy(*ASK).orderBy(F.desc(score)))).where(F.col("at") <= k)
    return best.groupBy(*ASK).agg(F.min(score).alias(name), F.count("*").alias("found")).where(F.col("found") == k).drop("found")


def chosen_blocks(choice: DataFrame, floors: DataFrame) -> DataFrame:
    """``choice`` with ``chosen`` and ``rest``, the largest part of a score that the term's blocks that are not chosen can give.

    Terms are put in order of ``up``. The first ones, whose sum is below the floor, choose
    no block; the others choose those with which, and the most of all other terms, the
    floor can be reached. Without a floor all are chosen.
    """
    terms = choice.select(*ASK, "term", "up").distinct()
    order = Window.partitionBy(*ASK).orderBy("up", "term")
    terms = terms.withColumn("below", F.sum("up").over(order)).withColumn("total", F.sum("up").over(Window.partitionBy(*ASK))).drop("up")
    rows = choice.join(terms, [*ASK, "term"]).join(floors, list(ASK), "left")
    least = F.col("floor") - SLACK
    reaches = (F.col("below") >= least) & (F.col("w") * F.col("most") + F.col("total") - F.col("up") >= least)
    rows = rows.withColumn("chosen", F.coalesce(reaches, F.lit(True)))
    rest = F.max(F.when(~F.col("chosen"), F.col("w") * F.col("most"))).over(Window.partitionBy(*ASK, "term"))
    return rows.withColumn("rest", F.coalesce(rest, F.lit(0.0))).drop("below", "total")


def bounded_scores(terms: DataFrame, posts: DataFrame, sources: DataFrame, stats: DataFrame, blocks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, qi, source, chunk_id, doc_pos, score): whole BM25 scores of chunks among which are each list's ``k`` best and their equals."""
    choice = packed(block_choice(terms, stats, blocks, k))
    tasks = tasks_for(choice, "n")
    # The batch's own part of the index, written once, as it is read three times.
    at = packed(impacts(posts.join(choice.select("source", "term").distinct(), ["source", "term"], "left_semi"), sources, k1, b))
    part = F.col("w") * F.col("impact")
    # Dealt by chunk, so that a chunk's pairs are added up where they are made.
    read = lambda rows: at.repartition(tasks, "chunk_id").join(rows.select(*ASK, "term", "w", "step", *(["rest"] if "rest" in rows.columns else [])), ["source", "term", "step"])
    early = read(choice.where("early")).groupBy(*ASK, "chunk_id").agg(F.sum(part).alias("score"))
    chosen = packed(chosen_blocks(choice, kth_best(early, k, "score", "floor")))
    known = read(chosen.where("chosen")).groupBy(*ASK, "chunk_id", "doc_pos").agg(F.sum(part).alias("known"), F.sum("rest").alias("covered"))
    known = packed(known)
    rests = chosen.groupBy(*ASK, "term").agg(F.max("rest").alias("rest"), F.max("floor").alias("floor")).groupBy(*ASK).agg(F.sum("rest").alias("rests"), F.max("floor").alias("floor"))
    limits = packed(rests.join(kth_best(known, k, "known", "reached"), list(ASK), "left"))
    # A term that is known of a chunk gives nothing more: a chunk has one posting of it.
    left = known.join(limits, list(ASK)).where(F.coalesce(F.col("known") + F.col("rests") - F.col("covered") >= F.greatest("floor", "reached") - SLACK, F.lit(True)))
    left = packed(left.select(*ASK, "chunk_id", "doc_pos", "known"))
    # Of the terms that have blocks left out, what the candidates have in those.
    open_ = chosen.groupBy(*ASK, "term").agg(F.max("w").alias("w"), F.max(F.when(~F.col("chosen"), F.col("step"))).alias("under")).where("under is not null")
    missing = left.select(*ASK, "chunk_id").join(packed(open_), list(ASK)).join(at.select("source", "term", "chunk_id", "impact", "step"), ["source", "term", "chunk_id"]).where("step <= under")
    more = missing.repartition(tasks, *ASK, "chunk_id").groupBy(*ASK, "chunk_id").agg(F.sum(part).alias("more"))
    return left.join(more, [*ASK, "chunk_id"], "left").select(*ASK, "chunk_id", "doc_pos", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("score"))


def pairs_asked(terms: DataFrame, stats: DataFrame) -> int:
    """How many (question, posting) pairs a search without bounds scores."""
    sizes = stats.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("n"))
    return terms.join(sizes, "term").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def postings_read(terms: DataFrame, posts: DataFrame, sources: DataFrame, stats: DataFrame, blocks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, qi, source, term, all, early, chosen): of each question's term, its postings and how many of them the two steps score."""
    at = impacts(posts, sources, k1, b)
    choice = block_choice(terms, stats, blocks, k)
    early = choice.where("early").select(*ASK, "term", "w", "step").join(at, ["source", "term", "step"])
    floors = kth_best(early.groupBy(*ASK, "chunk_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")), k, "score", "floor")
    counted = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name)
    return chosen_blocks(choice, floors).groupBy(*ASK, "term").agg(F.sum("n").alias("all"), counted("early"), counted("chosen"))
