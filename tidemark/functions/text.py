"""Text functions as Column expressions (TXT-1 to TXT-17). All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words. "no", "not", "all" and "off" are kept as terms.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by",
    "can", "did", "do", "does", "for", "from", "had", "has", "have",
    "i", "if", "in", "into", "is", "it", "its", "just", "me", "my",
    "of", "on", "or", "our", "should", "so", "some", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this",
    "to", "was", "we", "were", "what", "when", "where", "which", "who",
    "why", "will", "with", "would", "you", "your",
)

# Words of greetings that need no retrieval.
SMALL_TALK = (
    "hi", "hii", "hiya", "hey", "heya", "hello", "helo", "yo", "sup", "greetings",
    "good", "morning", "afternoon", "evening", "night",
    "thanks", "thank", "thx", "ty", "cheers", "appreciated",
    "ok", "okay", "cool", "nice", "great", "awesome", "lol", "haha",
    "bye", "goodbye", "cya", "later",
    "test", "testing", "ping", "hola", "namaste",
    "you", "u", "there", "how", "are", "doing", "whats", "up", "a", "the", "is", "it",
)

TOKEN = r"[a-z0-9]+(?:[._\-/][a-z0-9]+)*"
JOINT_OR_DIGIT = r"[0-9._\-/]"
VERSION = r"^v?[0-9]+(?:\.[0-9]+)*$"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
BLANKS = r"(?U)^\s+|\s+$"


def fold_pairs() -> tuple[str, str, list[tuple[str, str]]]:
    """(single characters, their ASCII letters, characters with several) by compatibility decomposition, without marks."""
    one_from, one_to, more = [], [], []
    for code in [*range(0x80, 0x2190), *range(0x2460, 0x24FF), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one_from.append(c), one_to.append(plain)
        elif plain:
            more.append((c, plain))
    return "".join(one_from), "".join(one_to), more


FOLD_FROM, FOLD_TO, FOLD_MORE = fold_pairs()


def ranges(characters: list[str]) -> str:
    """A character class of runs of code points; outside U+00BC to U+FFFF one comparison decides."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[\\x{BC}-\\x{FFFF}&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"


def ascii_fold(text: Column) -> Column:
    """TXT-1: compatibility decomposition, then ASCII only. ASCII texts are done at once; characters that become several are rare, so they are looked for first."""
    spelled = text
    for c, plain in FOLD_MORE:
        spelled = F.replace(spelled, F.lit(c), F.lit(plain))
    opened = F.when(text.rlike(ranges([c for c, _ in FOLD_MORE])), spelled).otherwise(text)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(F.translate(opened, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]+", ""))


def plain_stem(t: Column) -> Column:
    """``stem`` of a token without a digit or joint."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(n <= 3, t)
        .when(t.endswith("s"), F.when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(t.endswith("sses"), cut(2)).when(t.endswith("ss") | t.endswith("us") | t.endswith("is"), t).otherwise(cut(1)))
        .when(t.endswith("ing") & (n > 6), cut(3))
        .when(t.endswith("ed") & (n > 5), cut(2))
        .otherwise(t)
    )


def stem(t: Column) -> Column:
    """TXT-2: the first suffix rule that applies; short tokens and those with a digit or a joint stay."""
    return F.when(t.rlike(JOINT_OR_DIGIT), t).otherwise(plain_stem(t))


def tokenize(text: Column) -> Column:
    """TXT-3: tokens in order; a compound stays whole and is followed by its usable parts; versions are never split.

    Most tokens are plain, so they are told apart first: a set look-up and one pattern.
    """
    whole = F.regexp_extract_all(F.lower(ascii_fold(text)), F.lit(TOKEN), F.lit(0))
    usable = lambda t: F.filter(F.split(t, r"[._\-/]"), lambda p: (F.length(p) >= 2) & ~p.isin(*STOP_WORDS) & ~p.rlike(VERSION))

    def expand(t: Column) -> Column:
        return (
            F.when(t.isin(*STOP_WORDS), F.array().cast("array<string>"))
            .when(~t.rlike(JOINT_OR_DIGIT), F.array(plain_stem(t)))
            .when(~t.rlike(r"[._\-/]") | t.rlike(VERSION), F.array(t))
            .otherwise(F.concat(F.array(t), F.transform(usable(t), stem)))
        )

    return F.coalesce(F.flatten(F.transform(whole, expand)), F.array().cast("array<string>"))


def slugify(text: Column) -> Column:
    """TXT-5: folded, lower-case, words joined by dashes; over 60 characters cut before the last dash within 60."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(slug, 1, 60)
    shorter = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(slug) <= 60, slug).otherwise(F.when(F.length(shorter) > 0, shorter).otherwise(head))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def estimate_tokens(text: Column) -> Column:
    """TXT-6: the larger of a quarter of the characters and 1.3 a word, rounded half to even; 0 for an empty text."""
    size = F.greatest(F.length(text) / F.lit(4.0), F.size(words(text)) * F.lit(1.3))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(size).cast("int"))).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def sentences(text: Column) -> Column:
    """TXT-7: cut after terminal punctuation before a capital or digit; blank parts go."""
    parts = F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: F.length(s) > 0)
    return F.coalesce(parts, F.array().cast("array<string>"))


def strip_quotes(text: Column) -> Column:
    """TXT-8: without quoted lines; runs of blank lines become one."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*>.*$", ""), r"\n{3,}", "\n\n"))


def strip_blocks(text: Column) -> Column:
    """TXT-9: without fenced code, code marks and heading marks, white space collapsed."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", " ")
    plain = F.regexp_replace(plain, r"`{1,2}([^`]*)`{1,2}", "$1")
    plain = F.regexp_replace(plain, r"(?mU)^\s*#+\s*", "")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def fenced_lines(text: Column) -> Column:
    """TXT-10: for each line, whether it is in or on a code fence."""
    marks = F.transform(F.split(text, "\n"), lambda line: F.ltrim(line).rlike("^(```|~~~)"))
    state = F.aggregate(
        marks,
        F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("mask")),
        lambda s, m: F.struct(F.when(m, ~s["on"]).otherwise(s["on"]).alias("on"), F.concat(s["mask"], F.array(s["on"] | m)).alias("mask")),
    )
    return state["mask"]


def size_in_bytes(text: Column) -> Column:
    """TXT-11: a number with an optional unit as whole bytes; anything else unchanged."""
    plain = F.regexp_replace(F.lower(text), "[,_]", "")
    pattern = r"(\d+(?:\.\d+)?)\s*(kib|kb|mib|mb|bytes|b)?"
    number, unit = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
    factor = F.when(unit == "kib", 1024).when(unit == "kb", 1000).when(unit == "mib", 1048576).when(unit == "mb", 1000000).otherwise(1)
    return F.when(number == "", text).otherwise((number.cast("double") * factor).cast("long").cast("string"))


def jaccard(a: Column, b: Column) -> Column:
    """TXT-12: 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """TXT-13: 0 when a vector is degenerate."""
    size = norm(a) * norm(b)
    return F.when(size <= 1e-12, F.lit(0.0)).otherwise(dot(a, b) / size)


def dedupe_slugs(slugs: Column) -> Column:
    """TXT-14: the first free of s, s-2, s-3, ... within the array, in order."""

    def place(done: Column, s: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.when(k == 1, s).otherwise(F.concat(s, F.lit("-"), k.cast("string"))))
        return F.concat(done, F.array(F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t)), 1)))

    return F.aggregate(slugs, F.array().cast("array<string>"), place)


def is_small_talk(text: Column) -> Column:
    """TXT-15: one to six words, all of them of greetings."""
    own = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 0)
    known = F.array(*[F.lit(w) for w in SMALL_TALK])
    return F.size(own).between(1, 6) & F.forall(own, lambda t: F.array_contains(known, t))


def iso_date(text: Column) -> Column:
    """TXT-16: the date in the first ten characters, else null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def version_parts(text: Column) -> Column:
    """TXT-17: the numeric parts between dots."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("0")), r"\."), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))
