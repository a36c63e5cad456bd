"""Benchmark decontamination by greedy string tiling.

Words of a benchmark item and a text are matched as tiles: seeds (windows of
``least`` equal words, found by rolling Karp-Rabin hashes) grow to maximal matches, the
longest unmarked match is marked, and so on until none of ``least`` words is left. The
share of the item's words in tiles is its coverage, whatever order the tiles have in the
text, so reordered passages are caught.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrays import Shingler, gram_hashes, text_slices

LEAST_WORDS, COVERAGE = 5, 0.8
#: Bytes of benchmark texts that a task holds; a larger benchmark is applied part by part.
BENCHMARK_BYTES = 32 << 20
#: Pairs of equal windows that are listed at a time.
PAIRS = 1 << 18


class SeedIndex:
    """The items' seed windows by hash; items shorter than ``least`` words are one window."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.ids = least, [i for i, _ in items]
        shingler = Shingler(least)
        self.words: list[np.ndarray] = []
        for _, _, data, ends in text_slices(pa.array([t for _, t in items], pa.string())):
            word, _, _, bound = shingler.words(data, ends)
            self.words += [word[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(len(w), least) for w in self.words if len(w)}):
            own = [(k, gram_hashes(w, n)) for k, w in enumerate(self.words) if min(len(w), least) == n]
            gram = np.concatenate([g for _, g in own])
            item = np.concatenate([np.full(len(g), k) for k, g in own])
            at = np.concatenate([np.arange(len(g)) for _, g in own])
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            maybe = np.zeros(1 << 20, bool)
            maybe[(gram >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = (gram, item[order], at[order], maybe)

    def seeds(self, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, positions in ``word``, first and last index entry) of the windows that some item has."""
        for n, (gram, _, _, maybe) in self.by_length.items():
            own = gram_hashes(word, n)
            at = np.flatnonzero(maybe[(own >> np.uint64(44)).astype(np.int64)])
            if len(at):
                a = np.searchsorted(gram, own[at], "left")
                b = np.searchsorted(gram, own[at], "right")
                found = b > a
                if found.any():
                    yield n, at[found], a[found], b[found]


def seed_runs(index: SeedIndex, n: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start in item, start in text, words) of the maximal runs of equal words, by item.

    The seeds of a run lie on one diagonal. Pairs of a text's and an item's positions are
    listed for PAIRS at a time and joined to runs at once, because words that repeat
    make as many pairs as the lengths' product, but few runs.
    """
    _, item, place, _ = index.by_length[n]
    count = b - a
    before = np.r_[0, np.cumsum(count)]
    parts: list[tuple[np.ndarray, ...]] = []

    def joined(of: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((i, j - i, of))
        of, i, j, size = of[order], i[order], j[order], size[order]
        first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(j - i) != 0) | (i[1:] != i[:-1] + size[:-1])])
        return of[first], i[first], j[first], np.add.reduceat(size, first)

    x = 0
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(before, before[x] + PAIRS, "right")) - 1)
        own = count[x:y]
        entry = np.repeat(a[x:y] - (before[x:y] - before[x]), own) + np.arange(own.sum())
        parts.append(joined(item[entry], place[entry], np.repeat(at[x:y], own), np.ones(len(entry), np.int64)))
        x = y
    of, i, j, size = joined(*(np.concatenate(c) for c in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
    return of, i, j, size + (n - 1)


def tiles(words: int, start_item: np.ndarray, start_text: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, words) from maximal runs: the longest unmarked match first; of equals the first in the item, then in the text."""
    low = int(start_text.min())
    free_item, free_text = np.ones(words, bool), np.ones(int((start_text + size).max()) - low, bool)
    order = np.lexsort((start_text, start_item, -size))
    at = 0
    rest: list[tuple[int, int, int]] = []  # what marks have left of runs
    found = []
    while at < len(order) or rest:
        k = order[at] if at < len(order) else -1
        if k >= 0 and (not rest or (-size[k], start_item[k], start_text[k]) <= rest[0]):
            n, a, b = int(size[k]), int(start_item[k]), int(start_text[k]) - low
            at += 1
        else:
            n, a, b = heapq.heappop(rest)
            n, b = -n, b - low
        free = free_item[a : a + n] & free_text[b : b + n]
        if free.all():
            found.append((a, b + low, n))
            free_item[a : a + n] = False
            free_text[b : b + n] = False
            edge = np.flatnonzero(np.diff(np.r_[False, free_item, False].astype(np.int8)))
            if not len(edge) or (edge[1::2] - edge[::2]).max() < least:
                break  # no room for another tile
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for x, y in zip(edge[::2], edge[1::2], strict=True):
            if y - x >= least:
                heapq.heappush(rest, (-int(y - x), a + int(x), b + int(x) + low))
    return found


def overlaps_of(index: SeedIndex, word: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item number, its words, words in tiles) for each item with a seed in the text."""
    for n, at, a, b in index.seeds(word):
        of, i, j, size = seed_runs(index, n, at, a, b)
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            words = len(index.words[of[x]])
            yield int(of[x]), words, sum(t[2] for t in tiles(words, i[x:y], j[x:y], size[x:y], n))


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(doc id, item id, item_words, covered_words, coverage) of each text and item with at least ``coverage`` of the item's words in tiles.

    Words: A-Z lower-cased, between white space. Items under ``least_words`` words must
    occur whole. Of equally long matches the first in the item, then in the text, is
    marked. Texts are read whole, and memory does not grow with how often words repeat,
    but with the text and its runs of equal words. Null and empty texts and items match
    nothing. Repeated rows each give their own; null ids are kept as null. Other columns
    are ignored.

    The benchmark is read in parts of BENCHMARK_BYTES. One part is planned lazily; of
    several, each is applied and its result written before the next one is fetched, so
    neither the driver nor a task holds more than one; each costs a scan of the texts.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("passage"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("passage") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // BENCHMARK_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` long, `{item_col}` long, item_words long, covered_words long, coverage double"
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(parts)) == part) if parts > 1 else items
        one = texts.mapInArrow(tiler([(r.item, r.passage) for r in own.collect()], id_col, item_col, least_words, coverage), schema)
        one = stored(one) if parts > 1 else one
        found = one if found is None else found.unionByName(one)
    return found


def tiler(items: list[tuple[int, str]], id_col: str, item_col: str, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shingler = SeedIndex(items, least), Shingler(least)
        for batch in batches:
            for row, _, data, ends in text_slices(batch.column(1)):
                word, _, _, bound = shingler.words(data, ends)
                # One look at all texts of the slice; those without a seed are done.
                seeded = np.zeros(len(bound) - 1, bool)
                for n, at, _, _ in index.seeds(word):
                    of = np.searchsorted(bound, at, "right") - 1
                    seeded[of[at + n <= bound[of + 1]]] = True
                found = []
                for k in np.flatnonzero(seeded):
                    for item, size, covered in overlaps_of(index, word[bound[k] : bound[k + 1]]):
                        if covered >= coverage * size:
                            found.append((batch.column(0)[row + int(k)].as_py(), index.ids[item], size, covered, covered / size))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], [id_col, item_col, "item_words", "covered_words", "coverage"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose id has a benchmark overlap; rows with a null id stay."""
    hit = stored(benchmark_overlaps(docs, benchmark, id_col, text_col, **options).select(id_col).distinct())
    return docs.join(hit, id_col, "left_anti")
