"""Whole texts as numpy byte arrays: words, hashes and runs without a Python loop per character.

Arrow hands a batch of strings over as one UTF-8 buffer with offsets. The functions
here work on that buffer in slices of about ``SLICE`` bytes (always whole texts), so
memory does not depend on the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of whole texts of about ``most`` bytes; a longer text comes alone."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def byte_table(*members: int | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for m in members:
        table[m if isinstance(m, int) else list(m)] = True
    return table


def white_space() -> np.ndarray:
    """The bytes 0x20 and 0x09 to 0x0D."""
    return byte_table(0x20, range(0x09, 0x0E))


def letters() -> np.ndarray:
    """ASCII letters and every byte of a longer UTF-8 sequence."""
    return byte_table(range(65, 91), range(97, 123), range(128, 256))


def runs(mask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a text ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    last = np.zeros(n + 1, bool)
    first[:n] = mask
    first[1:n] &= ~mask[:-1]
    last[1:] = mask
    last[1:n] &= ~mask[1:]
    inner = ends[(ends > 0) & (ends < n)]
    both = inner[mask[inner] & mask[inner - 1]]
    first[both] = True
    last[both] = True
    return np.flatnonzero(first), np.flatnonzero(last)


def owner(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(ends, starts, "right") - 1


def per_text(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bounds of each text's share of sorted ``starts``."""
    return np.searchsorted(starts, ends, "left")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class ByteHash:
    """Hashes of any spans of a byte array from one running sum.

    The sum of table[byte] * base^position modulo 2^64, divided by base^start.
    ``fold`` gives A-Z the values of a-z.
    """

    BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8

    def __init__(self, fold: bool = True):
        self.table = odd_numbers(256, 11)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.grow(SLICE + (SLICE >> 2))

    def grow(self, n: int) -> None:
        self.power = np.full(n, self.BASE, np.uint64)
        self.power[0] = 1
        self.inverse = np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def load(self, data: np.ndarray) -> None:
        if len(data) + 1 > len(self.power):
            self.grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes."""
    by = odd_numbers(n, 23)
    count = max(0, len(word) - n + 1)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h += word[i : i + count] * by[i]
    return mix(h)


def short_hash(word: np.ndarray) -> np.uint64:
    """Hash of a whole sequence that is shorter than a gram; the length enters, so it never equals a longer one's."""
    by = odd_numbers(len(word) + 1, 29)
    return mix((word * by[:-1]).sum(keepdims=True, dtype=np.uint64) + by[-1:] * np.uint64(len(word)))[0]


class Shingler:
    """Distinct word-gram hashes of each text: A-Z lower-cased, words between white space."""

    def __init__(self, n: int = 5):
        self.n, self.hash, self.white = n, ByteHash(), white_space()

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, their starts and ends, and the bounds of each text's words."""
        self.hash.load(data)
        starts, stops = runs(~self.white[data], ends)
        return self.hash.of(starts, stops), starts, stops, per_text(starts, ends)

    def sets(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        word, _, _, bound = self.words(data, ends)
        gram = gram_hashes(word, self.n)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= self.n:
                yield np.unique(gram[a : b - self.n + 1])
            elif b > a:
                yield short_hash(word[a:b]).reshape(1)
            else:
                yield np.zeros(0, np.uint64)


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes (sorted)."""
    a = int((mix(hashes ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64))
    b = int((mix(hashes * np.uint64(0xDA942042E4DD58B5))).sum(dtype=np.uint64))
    return signed(a), signed(b)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components_of(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.full(n, -1)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(adjacent[front].any(axis=0) & (label < 0))
            label[front] = first
    return label
