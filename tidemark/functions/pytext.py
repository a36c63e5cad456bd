"""The text functions that chunkers need inside a worker, in plain Python. Same results as ``functions.text``."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from re import _constants as op
from re import _parser as parser

from .text import FOLD_FROM, FOLD_MORE, FOLD_TO, STOP_WORDS, TOKEN, VERSION

SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
TOKENS = re.compile(TOKEN)
#: ``text.ascii_fold`` character by character.
FOLDED = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | dict(FOLD_MORE))
#: White space of ``(?U)\\s``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Other letters that patterns without regard to case take for ASCII ones: both Turkish i, the long s, the Kelvin sign.
LIKE_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
#: Words whose terms a worker remembers.
KNOWN = 1 << 17
#: Characters of a text from which its words are not held all at once.
LONG = 1 << 22


def lower(text: str) -> str:
    """Lower case as patterns without regard to case see it; a character stays one."""
    if not text.isascii():
        for c, plain in LIKE_ASCII.items():
            text = text.replace(c, plain)
    return text.lower()


def fold(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def estimate_tokens(text: str) -> int:
    return max(1, round(max(len(text) / 4, len(text.split()) * 1.3))) if text else 0


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in SENTENCE_END.split(text.strip())) if s]


def slugify(text: str) -> str:
    slug = "-".join(re.findall("[a-z0-9]+", fold(text).lower()))
    if len(slug) <= 60:
        return slug
    head = slug[:60]
    return head.rpartition("-")[0] or head


def first_free(slug: str, taken: set[str]) -> str:
    """The slug, or it with the first number from 2 that is free."""
    name, n = slug, 1
    while name in taken:
        n += 1
        name = f"{slug}-{n}"
    taken.add(name)
    return name


def fenced(lines: list[str]) -> list[bool]:
    inside, mask = False, []
    for line in lines:
        mark = line.lstrip().startswith(("```", "~~~"))
        mask.append(inside or mark)
        inside ^= mark
    return mask


def stem(token: str) -> str:
    if len(token) <= 3 or re.search(r"[0-9._\-/]", token):
        return token
    if token.endswith("s"):
        return token[:-3] + "y" if token.endswith("ies") and len(token) > 4 else token[:-2] if token.endswith("sses") else token if token.endswith(("ss", "us", "is")) else token[:-1]
    return token[:-3] if token.endswith("ing") and len(token) > 6 else token[:-2] if token.endswith("ed") and len(token) > 5 else token


def terms_of(t: str) -> list[str]:
    """The terms of a word: none of a stop word, a compound and its usable parts."""
    if t in STOP_WORDS:
        return []
    parts = re.split(r"[._\-/]", t)
    if len(parts) == 1 or re.match(VERSION, t):
        return [stem(t)]
    return [t, *(stem(p) for p in parts if len(p) >= 2 and p not in STOP_WORDS and not re.match(VERSION, p))]


def tokens(text: str) -> list[str]:
    return [x for t in TOKENS.findall(fold(text).lower()) for x in terms_of(t)]


def term_counts(text: str, known: dict[str, list[str]]) -> dict[str, int]:
    """The distinct terms of ``text.tokenize`` with their numbers; ``known`` holds the terms of words met before."""
    plain = (text if text.isascii() else text.translate(FOLDED).encode("ascii", "ignore").decode()).lower()
    found: dict[str, int] = {}
    for word, n in Counter(TOKENS.findall(plain) if len(plain) < LONG else (m[0] for m in TOKENS.finditer(plain))).items():
        terms = known.get(word)
        if terms is None:
            if len(known) >= KNOWN:
                known.clear()
            terms = known[word] = terms_of(word)
        for term in terms:
            found[term] = found.get(term, 0) + n
    return found


def required(parts) -> list[tuple[str, ...]]:
    """What a text needs for a match of a parsed pattern, the longest first: of each tuple one text at least."""
    found, run = [], ""
    for kind, given in [*parts, (None, None)]:
        if kind is op.LITERAL:
            run += chr(given)
            continue
        found += [(run,)] if run else []
        run = ""
        if kind is op.SUBPATTERN:
            found += required(given[3])
        elif kind is op.ASSERT or (kind is op.MAX_REPEAT and given[0] > 0):
            found += required(given[-1])
        elif kind is op.BRANCH and all(each := [required(x) for x in given[1]]):
            found.append(tuple(t for x in each for t in x[0]))
    return sorted(found, key=lambda texts: -min(map(len, texts)))


def searched(pattern: str, **names: str) -> tuple[list[tuple[str, ...]], re.Pattern]:
    """(``required``, the pattern) for texts in ``lower`` case; {name} stands for a text of ``names``. Digits are tried from their first alone: a match from a later one is a match from there too."""
    plain = pattern.lower().replace(r"\s", f"[{WHITE}]").replace(r"(\d+", r"(?<!\d)(\d+")
    for name, text in names.items():
        plain = plain.replace(f"{{{name}}}", re.escape(lower(text)))
    return required(parser.parse(plain)) or [("",)], re.compile(plain)
