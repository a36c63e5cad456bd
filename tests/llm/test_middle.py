"""Fill-in-the-middle against a plain version, and its boundary lists against the numbers they hold."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tidemark.llm.middle as module
from tidemark.llm.middle import encode, fill_in_middle, restored, select

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, digest string, rows int, n int, form string, part int"


def plain(doc_id, text):
    text = text or ""
    parts = TOKEN.findall(text)
    assert "".join(parts) == text
    n = len(parts)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(parts[:i]), "".join(parts[i:j]), "".join(parts[j:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=900), st.sampled_from([1, 7, 256, 4096]))
def test_boundary_lists(gaps, sample):
    module.SAMPLE, kept = sample, module.SAMPLE
    try:
        ends = np.cumsum(gaps)
        code = encode(ends)
        assert [select(code, i) for i in range(len(ends))] == ends.tolist()
    finally:
        module.SAMPLE = kept


def test_lists_are_small():
    """A token of 6 code points takes about 5 bits; one far gap does not spoil it."""
    ends = np.cumsum(np.random.default_rng(0).integers(2, 11, 20000))
    assert len(encode(ends)) < 20000 * 5 / 8 + 500
    far = np.r_[np.arange(1, 5000), 10**7]
    assert [select(encode(far), i) for i in (0, 4998, 4999)] == [1, 4999, 10**7]


@pytest.mark.parametrize("group", [1024, 3])
def test_like_the_plain_version(spark, monkeypatch, group):
    """All shapes of texts; groups of copies in one task and in several."""
    monkeypatch.setattr(module, "GROUP", group)
    r = random.Random(1)
    texts = ["", None, " ", "\n\t ", "a", " a ", "a b c", "é 𝒳y  z w v", "x<", "<P>", "a <S> b", "M> < M>", "a<P b", "word " * 30000, "x" * 100_000, "a\x0bb\x0cc\rd", "<<P", "S><M"]
    texts += ["".join(r.choice(["ab", "é", "𝒳", " ", "  ", "\n", "<", ">", "P>", "<S", "\x1f"]) for _ in range(r.randint(1, 80))) for _ in range(250)]
    rows = [(k, t) for k, t in enumerate(texts * 2)] + [(1000 + k, "copied text, many times over") for k in range(60)] + [(None, "a b"), (None, "a b"), (None, "c"), (5, "other text of the same id"), (5, "other text of the same id")]
    frame = spark.createDataFrame([(i, t, "clash", 9, 9, "clash", 9) for i, t in rows], SCHEMA).repartition(5)
    found = fill_in_middle(frame)
    got = sorted(map(repr, (tuple(x) for x in found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())))
    assert got == sorted(repr((i, *plain(i, t))) for i, t in rows)
    back = found.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(repr((b.doc_id, b.text)) for b in back) == sorted(repr((i, t or "")) for i, t in rows)


def test_each_text_is_cut_once(spark, monkeypatch):
    """The index has a row for each distinct text, however many copies there are."""
    seen = []
    real = module.boundaries
    monkeypatch.setattr(module, "boundaries", lambda c: seen.append(c) or real(c))
    frame = spark.createDataFrame([(k, f"text {k % 4}") for k in range(400)], "doc_id long, text string")
    found = fill_in_middle(frame)
    assert found.count() == 400 and len(seen) == 1 and found.select("n").distinct().count() == 1


def test_no_rows(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
