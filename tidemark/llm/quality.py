"""Document quality from a conditional random field over lines.

Every line is good or bad, judged by its own features and those of the lines beside it;
neighbouring labels influence each other. A document's quality is the length-weighted
mean of its lines' probabilities of being good (forward-backward), on a logistic curve
fitted on training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .arrays import ByteHash, byte_table, per_text, runs, text_slices, white_space
from .crf import Chain, logistic, marginals, sigmoid, train
from .labelled import remainder, training_rows

HELD_OUT_PARTS, HELD_OUT = 4, 2
#: The most labelled rows of a model and the most lines in them; a text is used with all its lines or not at all.
TRAINING_ROWS, TRAINING_LINES = 6000, 200_000
#: The field is trained on pieces of this many lines, so that one long text does not pad all others.
PIECE = 64
THRESHOLD = 0.7
OWN = 14


class LineFeatures:
    """Features of every line that is not blank; sizes in bytes."""

    def __init__(self):
        self.hash, self.white = ByteHash(), white_space()
        upper, lower, digit = byte_table(range(65, 91)), byte_table(range(97, 123)), byte_table(range(48, 58))
        plain = upper | lower | digit | byte_table(range(128, 256)) | self.white | byte_table(*b".,;:'\"-()?")
        self.kinds = np.stack([upper, lower, digit, ~plain, byte_table(ord("!")), byte_table(ord("|"))])
        self.end = byte_table(*b".!?:;\"')")

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, line sizes, bounds of each text's lines)."""
        starts, stops = runs(data != 10, ends)
        self.hash.load(data)
        word_start, word_stop = runs(~self.white[data], ends)
        word = self.hash.of(word_start, word_stop)
        cut = np.searchsorted(word_start, starts)
        cut_end = np.searchsorted(word_start, stops)
        there = cut_end > cut
        starts, stops, cut, cut_end = starts[there], stops[there], cut[there], cut_end[there]
        n = len(starts)
        if not n:
            return np.zeros((0, OWN)), np.zeros(0), np.zeros(len(ends), np.int64)
        size, words = (stops - starts).astype(float), (cut_end - cut).astype(float)
        sums = np.zeros((len(self.kinds), len(data) + 1), np.int32)
        for k, kind in enumerate(self.kinds):
            np.cumsum(kind[data], out=sums[k, 1:])
        upper, lower, digit, odd, shout, pipe = (sums[:, stops] - sums[:, starts]).astype(float)
        again = np.zeros(len(word) + 1, np.int64)
        again[2:] = np.cumsum(word[1:] == word[:-1])
        letters_ = np.maximum(1, upper + lower)
        # Distinct words of a line: its first word of each hash.
        line_of = np.repeat(np.arange(n), cut_end - cut)
        inside = np.repeat(cut - np.r_[0, np.cumsum(cut_end - cut)[:-1]], cut_end - cut) + np.arange(len(line_of))
        pair = word[inside] ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(pair, return_index=True)
        distinct = np.bincount(line_of[first], minlength=n)
        bound = per_text(starts, ends)
        text_of = np.repeat(np.arange(len(ends) - 1), np.diff(bound))
        line = self.hash.of(starts, stops) ^ (text_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, back, count = np.unique(line, return_inverse=True, return_counts=True)
        first_word = data[word_start[cut]]
        f = np.stack(
            [
                np.log1p(size) / 5,
                upper / letters_,
                digit / size,
                odd / size,
                shout / words,
                pipe / words,
                distinct / words,
                np.maximum(0, again[cut_end] - again[np.minimum(cut + 1, cut_end)]) / words,
                np.minimum(size / words, 30) / 10,
                self.end[data[stops - 1]].astype(float),
                (count[back] > 1).astype(float),
                ((first_word >= 65) & (first_word <= 90)).astype(float),
                np.log1p(words) / 5,
                (words < 3).astype(float),
            ],
            axis=1,
        )
        return f, size, bound


def with_neighbours(f: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it (0 at a text's ends) and a constant."""
    n = len(f)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    has = bound[:-1] < bound[1:]
    before[bound[:-1][has]] = 0
    after[bound[1:][has] - 1] = 0
    return np.concatenate([np.ones((n, 1)), f, before, after], axis=1)


@dataclass
class QualityModel:
    chain: Chain
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def lines(self, f: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        x = with_neighbours((f - self.mean) / self.scale, bound)
        emit_all = x @ self.chain.features
        length = np.diff(bound)
        good = np.zeros(len(f))
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        at = 0
        while at < len(order):
            longest = length[order[at]]
            # Texts of like length go together, in batches of bounded size.
            k = max(1, min(int(np.searchsorted(-length[order[at:]], -(longest // 2), "right")), (1 << 18) // longest))
            some = order[at : at + k]
            own = length[some]
            emit = np.zeros((k, longest, 2))
            on = np.arange(longest)[None] < own[:, None]
            place = bound[some][:, None] + np.arange(longest)[None]
            emit[on] = emit_all[place[on]]
            p, _, _ = marginals(emit, own, self.chain)
            good[place[on]] = p[on][:, 0]
            at += k
        return good


def document_features(good: np.ndarray, size: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Length-weighted mean goodness of each text as log-odds, and whether it has any line."""
    add = lambda x: np.r_[0, np.cumsum(x)][bound[1:]] - np.r_[0, np.cumsum(x)][bound[:-1]]
    total = add(size)
    share = np.where(total > 0, add(good * size) / np.maximum(total, 1), 0.5)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.c_[np.log(share / (1 - share)) / 3, total == 0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = HELD_OUT_PARTS, held_out: int = HELD_OUT, most: int = TRAINING_ROWS, most_lines: int = TRAINING_LINES) -> QualityModel | None:
    """A model from at most ``most`` labelled rows with ``most_lines`` lines; None when they are not of both classes.

    Rows are taken in the order of a hash of the id, with all their lines; one that would
    exceed ``most_lines`` is passed over. Only documents are labelled. Lines of bad
    documents begin as bad; a line that a logistic regression over all lines calls good
    becomes good, while the worst line of each bad document stays bad; twice, then the
    field is trained on these line labels, and the document's curve on whole documents.
    """
    rows = training_rows(docs, labels, label_col, id_col, text_col, parts, held_out, most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = LineFeatures()
        for batch in batches:
            for row, end, data, ends in text_slices(batch.column(2)):
                f, size, bound = make.of(data, ends)
                f = np.c_[f, size].astype(np.float32)
                lines = [f[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                part = batch.slice(row, end - row)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(bound), pa.int64()), pa.array(lines, pa.binary())], ["turn", "label", "n", "lines"])

    turn = F.xxhash64("id", F.lit(5)).alias("turn")
    made = settle(rows.select(turn, "label", "text").mapInArrow(features, "turn long, label int, n long, lines binary").where("n > 0"))
    room = most_lines
    taken = []
    for r in made.select("turn", "label", "n").distinct().orderBy("turn", "label", "n").collect():
        if r.n <= room:
            room -= r.n
            taken.append((r.turn, r.label, r.n))
    chosen = made.sparkSession.createDataFrame(taken, "turn long, label int, n long")
    # At most ``most`` rows of three numbers.
    fetched = made.join(F.broadcast(chosen), ["turn", "label", "n"]).dropDuplicates(["turn", "label", "lines"]).orderBy("turn", "label", "lines").collect()
    found = [(r.label == 1, np.frombuffer(r.lines, np.float32).reshape(-1, OWN + 1).astype(float)) for r in fetched]
    if len({y for y, _ in found}) < 2:
        return None
    good_text = np.array([y for y, _ in found])
    length = np.array([len(f) for _, f in found])
    bound = np.r_[0, np.cumsum(length)]
    f = np.concatenate([x[:, :-1] for _, x in found])
    size = np.concatenate([x[:, -1] for _, x in found])
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    x = with_neighbours((f - mean) / scale, bound)
    of = np.repeat(np.arange(len(found)), length)
    bad = ~good_text[of]
    for _ in range(2):
        p = sigmoid(np.c_[np.ones(len(f)), (f - mean) / scale] @ logistic((f - mean) / scale, bad.astype(float)))
        worst = np.zeros(len(f), bool)
        order = np.lexsort((p, of))
        worst[order[bound[1:] - 1]] = True
        bad = ~good_text[of] & ((p > 0.5) | worst)
    # Pieces keep their lines' neighbours as features; only steps from piece to piece are left out.
    starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(bound[:-1], bound[1:], strict=True)])
    sizes = np.minimum(np.r_[starts[1:], bound[-1]] - starts, PIECE)
    on = np.arange(sizes.max())[None] < sizes[:, None]
    padded, y = np.zeros((*on.shape, x.shape[1]), np.float32), np.zeros(on.shape, np.int64)
    padded[on], y[on] = x, bad
    model = QualityModel(train(padded, y, sizes, 2), mean, scale, np.array([0.0, 1.0, 0.0]))
    model.weights = logistic(document_features(model.lines(f, bound), size, bound), good_text.astype(float), ridge=0.1)
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, model: QualityModel | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (of label 1), predicted and good_share.

    The score is a function of the text alone and of the labelled rows, whatever the
    partitions; every text is read whole, in memory that grows with its lines. Repeated
    rows each give their own. A text without a line (null, empty, white space) counts as
    half good. Without training rows of both classes every score is
    0.5. Null ids are kept. Other columns are ignored.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = LineFeatures()
        for batch in batches:
            for row, end, data, ends in text_slices(batch.column(1)):
                f, size, bound = make.of(data, ends)
                d = document_features(model.lines(f, bound), size, bound)
                p = sigmoid(np.c_[np.ones(len(d)), d] @ model.weights)
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(p), pa.array(sigmoid(3 * d[:, 0]))], ["id", "score", "good_share"])

    if model is None:
        scored = rows.select("id", F.lit(0.5).alias("score"), F.lit(0.5).alias("good_share"))
    else:
        scored = rows.mapInArrow(run, "id long, score double, good_share double")
    held = remainder("id", HELD_OUT_PARTS) == HELD_OUT
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share")
