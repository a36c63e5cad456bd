"""Text functions against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import pytext as pt
from tidemark.functions import text as tx

SAMPLES = [
    "", " ", "Retries and BACKOFF in v3.2: set max_retries=5, see client.dlq.replay --legacy-ack", "naïve façade ½ Ⅳ ß œ ﬁne x² ①", "a.b.c the-of-and 429 v2 classes address status analysis",
    "One. Two! Three? four. 5 is next.\n\nSix (7). v3.2 Has e.g. This.", "nb sp tab\tnew\r\nline", "x" * 300, "configuring acknowledged jobs bus is thesis running used", "An AN the; queue/worker_pool",
]


def fold(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def stem(t):
    if len(t) <= 3 or re.search(r"[0-9._\-/]", t):
        return t
    for end, cut, add, least in (("ies", 3, "y", 5), ("sses", 2, "", 0), ("ss", 0, "", 0), ("us", 0, "", 0), ("is", 0, "", 0), ("s", 1, "", 0), ("ing", 3, "", 7), ("ed", 2, "", 6)):
        if t.endswith(end) and len(t) >= least:
            return t[: len(t) - cut] + add
    return t


def tokens(s):
    out = []
    for t in re.findall(r"[a-z0-9]+(?:[._\-/][a-z0-9]+)*", fold(s).lower()):
        if t in tx.STOP_WORDS:
            continue
        version = re.fullmatch(r"v?[0-9]+(\.[0-9]+)*", t)
        out.append(t if version or re.search(r"[._\-/]", t) else stem(t))
        if not version and re.search(r"[._\-/]", t):
            out += [stem(p) for p in re.split(r"[._\-/]", t) if len(p) >= 2 and p not in tx.STOP_WORDS and not re.fullmatch(r"v?[0-9]+(\.[0-9]+)*", p)]
    return out


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def samples(seed=0, n=60):
    r = random.Random(seed)
    alphabet = "abcdeS sTing.ed -_/3é½.\n!? Aß"
    return SAMPLES + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_tokenize(spark):
    assert column(spark, samples(), tx.tokenize) == [tokens(s) for s in samples()]
    assert column(spark, ["Keep v3.2 whole", "dead-letter-queue", "the of and"], tx.tokenize) == [["keep", "v3.2", "whole"], ["dead-letter-queue", "dead", "letter", "queue"], []]
    assert column(spark, [None], tx.tokenize) == [[]]
    assert [pt.tokens(s) for s in samples()] == [tokens(s) for s in samples()]


def test_estimate_sentences_slug(spark):
    assert column(spark, samples(1), tx.estimate_tokens) == [pt.estimate_tokens(s) for s in samples(1)]
    assert column(spark, samples(2), tx.sentences) == [pt.sentences(s) for s in samples(2)]
    long = ["A very long heading that goes on and on until it is over sixty characters wide", "é" * 80, "a" * 80]
    assert column(spark, samples(3) + long, tx.slugify) == [pt.slugify(s) for s in samples(3) + long]


def test_small_functions(spark):
    assert column(spark, ["256 KiB", "1 MB", "1,000 bytes", "2.5kb", "none"], tx.size_in_bytes) == ["262144", "1000000", "1000", "2500", "none"]
    assert column(spark, ["hi there", "hey, why 429", "", "Thanks!"], tx.is_small_talk) == [True, False, False, True]
    assert [str(d) for d in column(spark, ["2025-01-02T03", "bad", "2025-13-01"], tx.iso_date)] == ["2025-01-02", "None", "None"]
    assert column(spark, ["3.10.x", None], tx.version_parts) == [[3, 10], [0]]
    assert column(spark, ["> q\nkept\n\n\n\nend"], tx.strip_quotes) == ["kept\n\nend"]
    assert column(spark, ["# T `x` ```code``` y"], tx.strip_blocks) == ["T x y"]
    assert column(spark, ["a\n```\nb\n```\nc"], tx.fenced_lines) == [[False, True, True, True, False]]
    slugs = spark.range(1).select(tx.dedupe_slugs(F.array(*map(F.lit, ("a", "a-2", "a", "b", "a")))).alias("s")).first().s
    assert slugs == ["a", "a-2", "a-3", "b", "a-4"]
    row = spark.range(1).select(tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), tx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j")).first()
    assert abs(row.c - 2**-0.5) < 1e-12 and row.z == 0.0 and row.j == 0.5


def test_chunks_leave_a_worker_in_slices(spark, monkeypatch):
    """a worker holds no more than a slice of chunks, however many rows an Arrow batch has; the chunks are the same."""
    from tidemark.config import EngineConfig
    from tidemark.operators import chunking

    d = spark.createDataFrame([(str(i), "T", "One two three. " * (i % 5) + "End.", i) for i in range(300)], "doc_id string, title string, body string, doc_pos long").coalesce(1)
    rows = lambda: sorted(map(str, chunking.chunk(d, "blog", EngineConfig()).collect()))
    whole = rows()
    monkeypatch.setattr(chunking, "SLICE", 50)
    assert len(whole) == 300 and rows() == whole


def test_a_text_is_hashed_once_for_its_digits(spark):
    """likeness, cosine and names take tokens and hashes that are columns, not made again in each lambda."""
    from tidemark.plans.more_rows import text_values

    plan = text_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2
