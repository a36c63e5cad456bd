"""Fill-in-the-middle by a distinct-text index.

Identical texts are grouped by their SHA-256, and each group's contents are compared: its
set of texts must have one member. Each distinct text is cut into
tokens once; the ends of its tokens (in code points) are kept as an Elias-Fano list. The
index (digest, n, marked, ends) is joined back to the documents, each selects the two
ends of its seeded cut from the list, and the cut meets the one stored text of its group,
so a text is sent once however many copies it has, and no document's text is moved
beside that. A group with very many documents is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..session import settle
from .arrays import runs, text_slices, white_space

#: Documents of one text that a task takes; a larger group goes to several.
GROUP = 1024
#: Every so many values the place of the set bit is kept.
SAMPLE = 256
MARKS = ("<P>", "<S>", "<M>")


def encode(ends: np.ndarray) -> bytes:
    """An Elias-Fano list of rising numbers: their lower bits packed, and bit (upper part + i) set for the i-th."""
    n = len(ends)
    if not n:
        return b""
    low = max(0, int(ends[-1]) // n).bit_length() - 1
    low = max(0, low)
    bits = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    high = (ends >> low) + np.arange(n)
    upper = np.zeros(int(high[-1]) + 1, np.uint8)
    upper[high] = 1
    lower = np.packbits(bits.ravel(), bitorder="little").tobytes()
    head = np.array([n, low, len(lower)], "<u4").tobytes()
    return head + high[::SAMPLE].astype("<u4").tobytes() + lower + np.packbits(upper, bitorder="little").tobytes()


def select(code: bytes, i: int) -> int:
    """The i-th number of a list: from the nearest kept place on, bytes are counted until the i-th set bit."""
    n, low, size = (int(v) for v in np.frombuffer(code, "<u4", 3))
    first = 12 + 4 * (-(-n // SAMPLE))
    place = int(np.frombuffer(code, "<u4", 1, 12 + 4 * (i // SAMPLE))[0])
    left = i % SAMPLE
    upper = np.frombuffer(code, np.uint8, offset=first + size)
    start = place >> 3
    while True:
        bits = np.unpackbits(upper[start : start + 64], bitorder="little")
        if start == place >> 3:
            bits[: place & 7] = 0
        ones = np.flatnonzero(bits)
        if left < len(ones):
            high = 8 * start + int(ones[left]) - i
            break
        left -= len(ones)
        start += 64
    bit = i * low
    chunk = int.from_bytes(code[first + (bit >> 3) : first + (bit + low + 7 >> 3)], "little") >> (bit & 7)
    return (high << low) | (chunk & ((1 << low) - 1))


def token_ends(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the ends of its tokens, in code points: words with the white space before them, and white space at the end."""
    white = white_space()
    for _, _, data, ends in text_slices(column):
        _, stops = runs(~white[data], ends)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owned = np.searchsorted(stops, ends, "right")
        for k in range(len(ends) - 1):
            own = stops[owned[k] : owned[k + 1]]
            if ends[k + 1] > ends[k] and (not len(own) or own[-1] < ends[k + 1]):
                own = np.append(own, ends[k + 1])
            yield points[own] - points[ends[k]]


@arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("ends", T.BinaryType())]))
def boundaries(texts: pa.Array) -> pa.Array:
    lists = list(token_ends(texts))
    return pa.StructArray.from_arrays([pa.array([len(e) for e in lists], pa.int64()), pa.array([encode(e) for e in lists], pa.binary())], ["n", "ends"])


@arrow_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def cut_at(ends: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Where prefix and middle of so many units end."""
    pick = lambda code, units: select(code.as_buffer(), units - 1) if units else 0
    rows = list(zip(ends, first.to_pylist(), second.to_pylist(), strict=True))
    return pa.StructArray.from_arrays([pa.array([pick(c, i) for c, i, _ in rows], pa.int64()), pa.array([pick(c, j) for c, _, j in rows], pa.int64())], ["a", "b"])


def rearranged(text: Column, form: Column, a: Column, b: Column) -> Column:
    """The text as it is, or its parts, each after its mark."""
    prefix, suffix = F.concat(F.lit("<P>"), F.substring(text, F.lit(1), a)), F.concat(F.lit("<S>"), F.substring(text, b + 1, F.length(text)))
    middle = F.concat(F.lit("<M>"), F.substring(text, a + 1, b - a))
    return F.when(form == "psm", F.concat(prefix, suffix, middle)).when(form == "spm", F.concat(suffix, prefix, middle)).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: no part holds a mark, so the first of each kind is where it was put."""
    middle = F.substring_index(output, "<M>", -1)
    front = F.substring_index(output, "<M>", 1)
    psm = F.concat(F.substring_index(F.substring_index(front, "<S>", 1), "<P>", -1), middle, F.substring_index(front, "<S>", -1))
    spm = F.concat(F.substring_index(front, "<P>", -1), middle, F.substring_index(F.substring_index(front, "<P>", 1), "<S>", -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def draws(id_col: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the SHA-256 of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars and output.

    n is the number of tokens (words with the white space before them; white space at
    the end). Prefix and middle end after the smaller and the larger of two draws of 0
    to n units. form is plain if the text is empty or holds a mark, and in 100 - ``rate``
    of 100 cases; else spm in ``spm`` of 100, psm in the others. prefix_chars and
    middle_chars count code points and are null if plain. A null text is empty, a null
    id draws as the text '' does. Texts are whole, however long; rows that repeat an id
    draw alike; repeated rows each have their row. No rows give no rows. Other columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    own = texts.groupBy("digest", "id").agg(F.count("*").alias("rows"))
    # Like all tables by digest this is written without texts.
    own = settle(own)
    many = own.groupBy("digest").agg(F.count("*").alias("asks"), F.sum("rows").alias("copies"))
    many = settle(many.where(F.col("copies") > GROUP).select("digest", "copies"))
    grouped = texts.groupBy("digest").agg(F.collect_set("text").alias("texts"), F.count("*").alias("copies"))
    same = F.when(F.size("texts") == 1, F.element_at("texts", 1)).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    distinct = grouped.select("digest", same.alias("text"), "copies")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("text").contains(mark)
    index = distinct.select("digest", "copies", marked.alias("marked"), boundaries("text").alias("found")).select("digest", "copies", "marked", "found.n", "found.ends")
    parts = lambda: F.ceil(F.col("copies") / GROUP).cast("int")
    dealt = lambda rows: rows.where(F.col("copies") > GROUP).withColumn("part", F.explode(F.sequence(F.lit(0), parts() - 1))).drop("copies")
    few = lambda rows: rows.where(F.col("copies") <= GROUP).drop("copies")
    h1, h2, h3, h4 = (f"h{i}" for i in range(1, 5))

    def cut(rows: DataFrame) -> DataFrame:
        """Rows with their text's entry of the index: the seeded cut."""
        drawn = rows.select("*", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("id"), seed), 1)])
        plain = (F.col("n") == 0) | F.col("marked") | (F.col(h3) % 100 >= rate)
        form = F.when(plain, "plain").when(F.col(h4) % 100 < spm, "spm").otherwise("psm")
        i, j = F.col(h1) % (F.col("n") + 1), F.col(h2) % (F.col("n") + 1)
        chosen = drawn.withColumn("form", form).withColumn("i", F.least(i, j)).withColumn("j", F.greatest(i, j))
        return chosen.withColumn("at", cut_at("ends", "i", "j")).drop("ends", "marked", "i", "j", h1, h2, h3, h4)

    lone = cut(own.join(many.select("digest"), "digest", "left_anti").join(few(index), "digest"))
    out = lone.join(few(distinct), "digest")
    if not many.isEmpty():
        salted = own.join(many, "digest").withColumn("part", F.pmod(F.xxhash64("id"), parts())).drop("copies")
        out = out.unionByName(cut(salted.join(dealt(index), ["digest", "part"])).join(dealt(distinct), ["digest", "part"]).drop("part"))
    out = out.select("*", rearranged(F.col("text"), F.col("form"), F.col("at.a").cast("int"), F.col("at.b").cast("int")).alias("output"))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    named = out.select(F.col("id").alias(id_col), "n", "form", chars(F.col("at.a")).alias("prefix_chars"), chars(F.col("at.b") - F.col("at.a")).alias("middle_chars"), "output", "rows")
    return named.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")
