"""Claims of texts (CON-10): as plain patterns find them, and in time that grows with a text's length."""

import random
import re
import time

import pyarrow as pa

from tidemark.functions import pytext
from tidemark.operators import conflicts as con
from tidemark.plans import branch_rows, engine_rows

LIKE = {"i": "İı", "s": "ſ", "k": "K"}


def plain(text):
    """(attribute, value, evidence), by every pattern over the whole text."""
    for attribute, patterns in con.CLAIMS.items():
        for pattern, value in patterns:
            if at := re.search(pattern.replace("{brand}", branch_rows.BRAND).replace(r"\s", f"[{pytext.WHITE}]"), text, re.IGNORECASE):
                start, stop = text.rfind(".", 0, at.start()) + 1, text.find(".", at.end()) + 1 or at.end() + 120
                yield attribute, at[1] if value in (None, "bytes") else value.replace("{brand}", branch_rows.BRAND.lower()), text[start:stop].strip(pytext.WHITE)
                break


def odd(text, rng):
    """Other letters that patterns take for ASCII ones, other white space, longer numbers, other case."""
    swap = lambda c: rng.choice(LIKE.get(c.lower(), c)) if rng.random() < 0.05 else rng.choice("  \n　") if c == " " and rng.random() < 0.1 else c * 3 if c.isdigit() else c.swapcase() if rng.random() < 0.1 else c
    return "".join(map(swap, text))


def test_claims_are_those_of_every_pattern_over_the_whole_text():
    """what is not searched has no match."""
    rng = random.Random(4)
    said = [*branch_rows.CLAIMED, *engine_rows.SAID, "\U0001f600 é. ", "no claim", "by default", "12", "limit"]
    texts = [rng.choice(("", " ", ". ")).join(odd(rng.choice(said), rng) for _ in range(rng.randint(0, 5))) for _ in range(3000)] + [None]
    found = con.finder(branch_rows.BRAND)(pa.array(texts)).to_pylist()
    assert [[(c["attribute"], c["value"], c["evidence"]) for c in own] for own in found] == [list(plain(t or "")) for t in texts]
    assert {c["attribute"] for own in found for c in own} == set(con.CLAIMS) and not all(found)


def test_what_a_pattern_needs():
    need = lambda pattern: pytext.searched(pattern)[0]
    assert need(r"(\d+)\s*Seconds?\s+by default(?=[^.]*visibility)") == [("by default",), ("visibility",), ("second",)]
    assert need(r"(?:ignored|not being read)") == [("ignored", "not being read")]
    assert need(r"(?:the\s+)?(\d+)") == need(r"(?:a|\d)") == need(r"(?!no)[a-z]*") == [("",)]


def test_characters_of_two_units_do_not_move_the_sentence(spark):
    """a position was counted in units of UTF-16 and used in characters."""
    rows = spark.createDataFrame([(1, "\U0001f600\U0001f600\U0001f600 Hi. Here replay is manual. More.")], "i int, display_text string")
    assert [(r.value, r.evidence) for r in con.claims(rows, "Product").collect()] == [("no", "Here replay is manual.")]


def test_time_grows_with_the_length_of_a_sentence(spark):
    """the start of the sentence was sought from every place before the claim, and numbers from each of their digits."""
    n = 400_000
    texts = [("a " * n + ". Replay is manual.", "no"), ("1" * n + " by default, second, visibility. Replay is manual.", "no"), ("x " * n, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, display_text string")
    began = time.time()
    found = {r.i: (r.value, r.evidence) for r in con.claims(rows, "Product").select("i", "value", "evidence").collect()}
    assert found == {i: (v, "Replay is manual.") for i, (_, v) in enumerate(texts) if v} and time.time() - began < 30
