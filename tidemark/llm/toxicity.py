"""Toxic passages by maximum-scoring segment search.

A token scores its log-odds of toxic against clean text (Dirichlet prior, a lower
confidence bound), less a drift; a token without significant evidence scores minus the
drift. All maximal segments (Ruzzo and Tompa) come from one pass; their scores are
calibrated by the extreme-value law of segment scores in clean text (rate ``lam``,
constant ``k``), and a document's evidence by a logistic curve on training rows.

Evidence is held by forms of a word: the word itself and its first 4 to 6 bytes, so
unseen inflections of a stem count. A word that only repeats the one before it adds
none, so saying a word many times in a row is saying it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .arrays import ByteHash, Shingler, letters, mix, odd_numbers, per_text, runs, text_slices
from .crf import logistic, sigmoid
from .labelled import remainder, training_rows

HELD_OUT_PARTS, HELD_OUT = 3, 1
#: The most labelled rows that a model is made from; its forms are some of the words in those.
TRAINING_ROWS = 20_000
STEMS = (4, 5, 6)
DRIFT, PRIOR, Z, LEAST_TEXTS = 0.5, 500.0, 3.0, 5
#: Smallest shingle hashes of a text, by which copies are told, and parts of a whole text that weights are counted in.
MINIMA, WHOLE = 16, 1 << 16
THRESHOLD = 0.7


class Forms:
    """Hashes of each word's forms: itself, then its first bytes (0 where the word is not longer). A word that repeats the one before it in its text has none, so a text of one word over and over is no evidence."""

    def __init__(self):
        self.hash, self.letter = ByteHash(), letters()

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(form hashes, word starts, word ends, bounds of each text's words)."""
        self.hash.load(data)
        starts, stops = runs(self.letter[data], ends)
        found = [self.hash.of(starts, stops)]
        for n in STEMS:
            long = stops - starts > n
            h = np.zeros(len(starts), np.uint64)
            h[long] = mix(self.hash.of(starts[long], starts[long] + n) + np.uint64(n))
            found.append(h)
        bound = per_text(starts, ends)
        again = np.zeros(len(starts) + 1, bool)
        again[1:-1] = found[0][1:] == found[0][:-1]
        again[bound] = False
        for h in found:
            h[again[:-1]] = 0
        return found, starts, stops, bound


@dataclass
class ToxicModel:
    form: np.ndarray  # sorted hashes of forms with evidence
    score: np.ndarray
    lam: float
    k: float
    weights: np.ndarray

    def token_scores(self, forms: list[np.ndarray], maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the words with evidence."""
        at_all, score_all = [], []
        for h in forms:
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            if len(at):
                i = np.minimum(np.searchsorted(self.form, h[at]), len(self.form) - 1)
                hit = self.form[i] == h[at]
                at_all.append(at[hit]), score_all.append(self.score[i[hit]])
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0)
        at, score = np.concatenate(at_all), np.concatenate(score_all)
        order = np.lexsort((-score, at))
        at, score = at[order], score[order]
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        return at[first], score[first]

    def maybe(self) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(self.form >> np.uint64(44)).astype(np.int64)] = True
        return table


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end word, score) of words that score ``score`` at ``at`` and -drift elsewhere.

    Linear, as Ruzzo and Tompa's: each candidate keeps the running sum before and after
    it and a pointer to the nearest earlier candidate that starts lower. A new one
    follows the pointers and never looks at what they pass over again.
    """
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    total, word = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (i - word)
        word = i + 1
        start, under = i, total
        total += s
        if s <= 0:
            continue
        j = len(low) - 1
        while j >= 0 and low[j] >= under:
            j = back[j]
        while j >= 0 and high[j] < total:
            start, under, k = first[j], low[j], back[j]
            del first[j:], end[j:], low[j:], high[j:], back[j:]
            j = k
        first.append(start), end.append(i + 1), low.append(under), high.append(total), back.append(j)
    return [(a, b, h - v) for a, b, v, h in zip(first, end, low, high, strict=True)]


def evidence(found: list[tuple[int, int, float]], words: int, lam: float, k: float) -> tuple[float, float, float]:
    """(sum of significant scores, best score, log of the length), in the units of the extreme-value law."""
    base = np.log(max(1.0, k * words))
    bits = [lam * s - base for _, _, s in found]
    return float(np.log1p(sum(max(0.0, b) for b in bits))), float(np.log1p(max([0.0, *(lam * s for _, _, s in found)]))), float(np.log1p(words) / 10)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = HELD_OUT_PARTS, held_out: int = HELD_OUT, most: int = TRAINING_ROWS) -> ToxicModel | None:
    """A model from at most ``most`` labelled rows; None when they are not of both classes.

    Counts of forms are made on executors; only forms with significant evidence come to
    the driver. A text weighs 1 / n, where n is the median, over MINIMA hash functions,
    of how many texts of its label have the same smallest shingle: a group of copies
    counts about once, while texts that share only a passage count each. Weights are
    whole parts of WHOLE and rows are sorted before a fit, so neither the order of rows
    nor their partitions change the model.
    """
    rows = training_rows(docs, labels, label_col, id_col, text_col, parts, held_out, most)
    by = odd_numbers(MINIMA, 37)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, shingler = Forms(), Shingler(5)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for row, end, data, ends in text_slices(batch.column(1)):
                least = [[int(mix(s * m).min()) >> 1 for m in by] if len(s) else [-1] * MINIMA for s in shingler.sets(data, ends)]
                found, _, _, bound = forms.of(data, ends)
                form, n = [], []
                for a, b in zip(bound[:-1], bound[1:], strict=True):
                    h, count = np.unique(np.concatenate([f[a:b] for f in found]), return_counts=True)
                    form.append(h[h != 0].view(np.int64)), n.append(count[h != 0])
                cut = pa.array(np.r_[0, np.cumsum([len(h) for h in form])], pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x), pa.int64())) for x in (form, n)]
                yield pa.record_batch([pa.array(label[row:end], pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array(np.diff(bound), pa.int64()), *lists], ["label", "least", "words", "form", "n"])

    toxic = (F.col("label") == 1).cast("int")
    own = rows.select("label", "text").mapInArrow(counts, "label int, least array<long>, words long, form array<long>, n array<long>").where("words > 0")
    own = settle(own.withColumn("toxic", toxic).withColumn("row", F.monotonically_increasing_id()))
    alike = own.select("row", "toxic", F.posexplode("least").alias("at", "least"))
    alike = alike.withColumn("same", F.count("*").over(Window.partitionBy("toxic", "at", "least")))
    weight = F.greatest(F.lit(1), F.round(F.lit(WHOLE) / F.percentile("same", F.lit(0.5)))).cast("long")
    own = own.drop("least").join(alike.groupBy("row").agg(weight.alias("weight")), "row")
    own = settle(own.select("toxic", "weight", (F.col("words") * F.col("weight")).alias("words"), "form", "n"))
    totals = {bool(r.toxic): r.words for r in own.groupBy("toxic").agg(F.sum("words").alias("words")).collect()}
    if len(totals) < 2:
        return None
    bad, good = totals[True] / WHOLE, totals[False] / WHOLE
    each = own.select("toxic", "weight", F.explode(F.arrays_zip("form", "n")).alias("x")).select("toxic", "weight", "x.form", (F.col("x.n") * F.col("weight")).alias("n"))
    each = each.groupBy("form").agg((F.sum(F.col("n") * F.col("toxic")) / WHOLE).alias("y"), (F.sum(F.col("n") * (1 - F.col("toxic"))) / WHOLE).alias("x"), (F.sum(F.col("weight") * F.col("toxic")) / WHOLE).alias("texts"))
    # Dirichlet prior: PRIOR words at the form's rate in all training text, and half a word of every form.
    prior = F.lit(PRIOR) * (F.col("y") + F.col("x")) / (bad + good) + 0.5
    y, x = F.col("y") + prior, F.col("x") + prior
    odds = F.log(y / (bad + PRIOR - y)) - F.log(x / (good + PRIOR - x))
    spread = F.sqrt(1 / y + 1 / x)
    strong = each.where(F.col("texts") >= LEAST_TEXTS).select("form", (odds - spread).alias("score"), (odds / spread).alias("z"), (x / (good + PRIOR)).alias("rate"))
    strong = strong.where((F.col("z") >= Z) & (F.col("score") > 3 * DRIFT)).select("form", "score", "rate").orderBy("form").collect()
    form = np.array([r.form for r in strong], np.int64).view(np.uint64)
    score, rate = np.array([r.score for r in strong], float), np.array([r.rate for r in strong], float)
    order = np.argsort(form)
    model = ToxicModel(form[order], score[order], 1.0, 1.0, np.array([-3.0, 0.0, 1.0, 0.0]))
    model.lam = decay(score - DRIFT, rate, DRIFT)
    # For rare positive steps, the chance that a passage of a clean text reaches s is at most words * k * exp(-lam * s).
    model.k = 1 - float(np.exp(-model.lam * DRIFT))
    seen = np.array(sorted(tuple(r) for r in score_texts(rows.select("label", "text"), model, "label int").select("label", "sum_", "best", "words").collect()), float)
    model.weights = logistic(seen[:, 1:], (seen[:, 0] == 1).astype(float), ridge=0.05)
    return model


def decay(score: np.ndarray, rate: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(lam * score)] = 1 over clean text; 1 where there is none."""
    if not len(score) or (rate * score).sum() - (1 - rate.sum()) * drift >= 0:
        return 1.0
    mean = lambda lam: (rate * np.exp(np.minimum(700, lam * score))).sum() + max(0.0, 1 - rate.sum()) * np.exp(-lam * drift)
    low, high = 0.0, 1.0
    while mean(high) < 1:
        high *= 2
    low = high / 1024
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def scorer_of(model: ToxicModel):
    """For a worker: yields (first row, end row, (evidence, scores, passages)) of slices of a column of texts."""

    def make():
        forms, maybe = Forms(), model.maybe()

        def score(column: pa.Array):
            for row, end, data, ends in text_slices(column):
                found, _, _, bound = forms.of(data, ends)
                at, points = model.token_scores(found, maybe)
                cut = np.searchsorted(at, bound)
                seen = np.zeros((end - row, 3))
                seen[:, 2] = np.log1p(np.diff(bound)) / 10
                passages: list[list] = [[] for _ in range(end - row)]
                for i in np.flatnonzero(np.diff(cut)):
                    a, b = cut[i], cut[i + 1]
                    parts = segments(at[a:b] - bound[i], points[a:b] - DRIFT, DRIFT)
                    seen[i] = evidence(parts, int(bound[i + 1] - bound[i]), model.lam, model.k)
                    passages[i] = [{"first": x, "end": y, "score": s} for x, y, s in parts]
                yield row, end, (seen, sigmoid(np.c_[np.ones(len(seen)), seen] @ model.weights), passages)

        return score

    return make


def score_texts(rows: DataFrame, model: ToxicModel, first: str) -> DataFrame:
    """The first column of ``rows`` (first, text), with sum_, best, words and score of each text and its passages (first word, end word, score)."""
    name = first.split()[0].strip("`")
    scorer = scorer_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            for row, end, (seen, p, passages) in score(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(row, end - row), *(pa.array(seen[:, c]) for c in range(3)), pa.array(p), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], [name, "sum_", "best", "words", "score", "passages"])

    return rows.mapInArrow(run, f"{first}, sum_ double, best double, words double, score double, passages array<struct<first: bigint, end: bigint, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, model: ToxicModel | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted and the passages (words as runs of letters).

    The score is a function of the text alone and of the labelled rows, whatever the
    partitions. Null and empty texts have no passage; every text is read whole, in time
    linear in its words. Repeated rows each give their own. Of equal segments the first
    is kept apart, as Ruzzo and Tompa define. Without training rows of both classes
    every score is 0. Null ids are kept and count as held out or not by the text ''.
    Other columns are ignored.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        scored = rows.select("id", F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<first: bigint, end: bigint, score: double>>)").alias("passages"))
    else:
        scored = score_texts(rows, model, "id long")
    held = remainder("id", HELD_OUT_PARTS) == HELD_OUT
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay, and nothing is shuffled."""
    model = train(docs, labels, id_col, text_col, label_col)
    if model is None:
        return docs
    at = docs.columns.index(text_col)
    scorer = scorer_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            for row, end, p in ((r, e, s[1]) for r, e, s in score(batch.column(at))):
                yield batch.slice(row, end - row).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
