"""Personal data by a linear-chain CRF over word shapes.

Words near a digit or an at sign are labelled O, or the beginning or inside of an e-mail
address, IP address, card or phone number. Features are shapes of a word and of the
words beside it; the weights come from a small labelled table made by rule
(``labelled_windows``), and decoding is Viterbi in numpy batches. Rule-based (base)
spans always stay; the field adds those that the rules miss.

A word with neither digit nor at sign is always O, and features reach two words, so the
words farther from such a word than that need no decoding: the best path has O there.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices
from .crf import Chain, train, viterbi
from .spans import Span, addresses, any_in_text, apart, digest, digits_of, luhn, personal_base, sha256, small_parts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The characters of items in a word of more than LONGEST characters, such as a line of JSON or a list of links; the others separate its pieces.
PIECE = re.compile(r"[\w.%+@()-]+")
ONE_SCRIPT = re.compile(r"[\x00-\x7F]+|[^\x00-\x7F]+")
REACH, LONGEST, PADDED = 2, 320, 1 << 15
TRAINING_WINDOWS = 1500


def shape(word: str) -> str:
    """Letters to x or X, digits to d; three or more of a kind to one with a plus sign."""
    s = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{2,}", r"\1+", s)


def word_features(words: list[str], i: int) -> list[str]:
    word = words[i]
    digits = sum("0" <= c <= "9" for c in word)
    found = ["1", f"s={shape(word)}", f"d={min(digits, 20)}", f"n={min(len(word), 24) // 2}"]
    found += [f"has={c}" for c in "@+()-./%#=$&*:" if c in word]
    found.append(f"dots={min(word.count('.'), 4)}")
    core = word.strip(".,;:!?\"'()[]<>*#$%&")
    found.append(f"core={shape(core)}")
    if re.fullmatch(r"[0-9]{12,19}", core):
        found.append("luhn" if luhn(core) else "long")
    parts = core.split(".")
    if len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) < 256 for p in parts):
        found.append("quad")
    for step in (-2, -1, 1, 2):
        j = i + step
        found.append(f"{step}:" + (shape(words[j]) if 0 <= j < len(words) and any(c.isdigit() or c in "@+(" for c in words[j]) else "-" if 0 <= j < len(words) else "|"))
    return found


def labelled_windows(count: int = TRAINING_WINDOWS, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """The labelled table: windows of words and labels, made by rule from a seed."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + number(r.choice([13, 14, 14, 14]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def one() -> tuple[list[str], str]:
        kind = r.choice([*KINDS, *KINDS, "O", "O", "O", "O"])
        if kind == "email":
            user = r.choice(["{a}", "{a}.{b}", "{a}{n}", "{a}_{b}", "{a}.{n}"]).format(a=name(), b=name(), n=number(2))
            return [f"{user}@{r.choice(['mail{}.{}.com', '{1}.org', '{1}.co.uk', '{1}.net']).format(number(1), name())}"], kind
        if kind == "ip":
            return [".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", ":8080"])], kind
        if kind == "card":
            c = card()
            return r.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join([c[:4], c[4:8], c[8:12], c[12:]])]]), kind
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            return r.choice([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{number(2)}", number(3), number(4), number(3)], [f"{a}-{b}-{c}"], [f"+{number(11)}"], [f"{a}.{b}.{c}"]]), kind
        return r.choice([[str(r.randint(0, 3000))], [f"{r.randint(1, 12)}.{r.randint(0, 99)}"], [f"20{number(2)}-{number(2)}-{number(2)}"], [number(5)], [f"{number(2)}:{number(2)}"], [f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}"], [f"{name()}{number(2)}"], [f"@{name()}"], ["".join(r.choice("0123456789abcdef") for _ in range(40))], [f"${number(3)},{number(3)}.00"], [f"{number(3)}-{number(2)}"], [number(r.choice([8, 9, 10, 16]))], [f"{number(2)}/{number(2)}/{number(4)}"], [f"({number(2)})"], [f"{r.randint(300, 999)}.{number(1)}.{number(3)}.{number(3)}"]]), "O"

    table = []
    for _ in range(count):
        words, labels = [], []
        for _ in range(r.randint(1, 2)):
            fill = [name() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(0, 3))]
            words, labels = words + fill, labels + ["O"] * len(fill)
            own, kind = one()
            if r.random() < 0.3:
                own = [*own[:-1], own[-1] + r.choice([".", ",", "***", "!!", "###", ";", "%%%", "$$$"])]
            words += own
            labels += ["O"] * len(own) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(own) - 1)]
        fill = [name() for _ in range(r.randint(0, 3))]
        table.append((words + fill, labels + ["O"] * len(fill)))
    return table


class Field:
    """The trained field: feature numbers and weights."""

    def __init__(self, table: list[tuple[list[str], list[str]]]):
        counts: dict[str, int] = {}
        rows = [[word_features(words, i) for i in range(len(words))] for words, _ in table]
        for f in (f for row in rows for word in row for f in word):
            counts[f] = counts.get(f, 0) + 1
        self.number = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 2))}
        length = np.array([len(words) for words, _ in table])
        x = np.zeros((len(table), length.max(), len(self.number)), np.float32)
        y = np.zeros((len(table), length.max()), np.int64)
        for a, (row, (_, labels)) in enumerate(zip(rows, table, strict=True)):
            for b, (word, label) in enumerate(zip(row, labels, strict=True)):
                y[a, b] = LABELS.index(label)
                for f in word:
                    if f in self.number:
                        x[a, b, self.number[f]] = 1
        self.chain: Chain = train(x, y, length, len(LABELS), rounds=80, rate=0.2)
        # An inside label only follows its own beginning or inside.
        for i, to in enumerate(LABELS):
            if to[0] == "I":
                self.chain.first[i] -= 1e3
                for j, come in enumerate(LABELS):
                    if come[1:] != to[1:]:
                        self.chain.steps[j, i] -= 1e3

    def decode(self, windows: list[list[str]]) -> list[list[str]]:
        """The best labels of each window, in batches of windows."""
        found: list[list[str]] = [[] for _ in windows]
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            # Windows of like length, PADDED words at most.
            n = 1
            while at + n < len(order) and (n + 1) * len(windows[order[at + n]]) <= PADDED:
                n += 1
            some = [windows[i] for i in order[at : at + n]]
            length = np.array([len(w) for w in some])
            emit = np.zeros((n, length.max(), len(LABELS)))
            emit[:, :, 1:] = -1e3
            for a, words in enumerate(some):
                for b, word in enumerate(words):
                    if has_sign(word):
                        own = [self.number[f] for f in word_features(words, b) if f in self.number]
                        emit[a, b] = self.chain.features[own].sum(axis=0)
            path = viterbi(emit, length, self.chain)
            for a, i in enumerate(order[at : at + n]):
                found[i] = [LABELS[k] for k in path[a, : length[a]]]
            at += n
        return found


def has_sign(word: str) -> bool:
    """Whether the word may be part of an item."""
    return "@" in word or any("0" <= c <= "9" for c in word)


def several(word: str) -> bool:
    """Whether a list without white space has two parts that may be whole items: an at sign or the digits of a phone number."""
    return ("," in word or ";" in word or "|" in word) and sum("@" in p or len(digits_of(p)) >= 9 for p in re.split("[,;|]", word)) > 1


def words_of(text: str) -> Iterator[tuple[int, int, str]]:
    """The words of a text; those longer than LONGEST or with several items in pieces at separators, and pieces still longer where ASCII begins or ends."""
    for m in WORD.finditer(text):
        if m.end() - m.start() <= LONGEST and not several(m[0]):
            yield m.start(), m.end(), m[0]
            continue
        for p in PIECE.finditer(text, *m.span()):
            if p.end() - p.start() <= LONGEST:
                yield p.start(), p.end(), p[0]
            else:
                yield from ((q.start(), q.end(), q[0]) for q in ONE_SCRIPT.finditer(text, *p.span()))


def windows_of(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of words that lie within REACH words of one with a digit or at sign."""
    words = list(words_of(text))
    signs = [i for i, w in enumerate(words) if has_sign(w[2])]
    at = 0
    while at < len(signs):
        first = last = signs[at]
        while at + 1 < len(signs) and signs[at + 1] - last <= 2 * REACH:
            at += 1
            last = signs[at]
        yield words[max(0, first - REACH) : last + REACH + 1]
        at += 1


#: Where a labelled run of words holds the items themselves; e-mail addresses lie in runs of their characters.
MAIL_PART, MAIL_DOMAIN = re.compile(r"[^\s<>()\[\],;:\"'*#$%&!]+"), re.compile(r"[\w-]+(?:\.[\w-]+)+")
CORES = {
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\s.-]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9](?:[\s().-]*[0-9])+"),
}


def cores(kind: str, run: str) -> list[tuple[int, int]]:
    """All items in a labelled run, in linear time."""
    if kind == "email":
        return [(m.start() + a, m.start() + b) for m in MAIL_PART.finditer(run) if "@" in m[0] for a, b in addresses(m[0], MAIL_DOMAIN)]
    return [m.span() for m in CORES[kind].finditer(run)]


def sound(kind: str, text: str) -> bool:
    digits = digits_of(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return kind == "email" or small_parts(text)


def added_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the field labels in each text, narrowed to the item and checked for its number of digits."""
    windows, of = [], []
    for i, text in enumerate(texts):
        for w in windows_of(text):
            windows.append(w)
            of.append(i)
    found: list[list[Span]] = [[] for _ in texts]
    for i, window, labels in zip(of, windows, field.decode([[w[2] for w in x] for x in windows]), strict=True):
        at = 0
        while at < len(labels):
            if labels[at][0] == "B":
                kind, end = labels[at][2:], at + 1
                while end < len(labels) and labels[end] == f"I-{kind}":
                    end += 1
                a, b = window[at][0], window[end - 1][1]
                found[i] += [(a + x, a + y, kind) for x, y in cores(kind, texts[i][a:b]) if sound(kind, texts[i][a + x : a + y])]
                at = end
            else:
                at += 1
    return found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all) and found (kind, start, end; code points).

    Base spans are leftmost and non-overlapping in each kind. Added ones overlap no other
    span. Null and empty texts have none; every text is read whole. Null ids and repeated
    rows are kept; other columns are ignored.
    """
    field = Field(labelled_windows())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    none = sha256("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for row, end, data, ends in text_slices(column):
                sign = (data == 64) | ((data >= 48) & (data <= 57))
                some = np.flatnonzero(any_in_text(sign, ends))
                texts = [column[row + int(i)].as_py() for i in some]
                base = {int(i): personal_base(t) for i, t in zip(some, texts, strict=True)}
                more = {int(i): apart(base[int(i)], x) for i, x in zip(some, added_spans(field, texts), strict=True)}
                out = []
                for i in range(end - row):
                    own = base.get(i, [])
                    every = own + more.get(i, [])
                    out.append((*(sum(s[2] == k for s in own) for k in KINDS), sha256(digest(own, KINDS)) if own else none, digest(every, KINDS), [{"kind": k, "start": a, "end": b} for a, b, k in sorted(every)]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.record_batch([batch.column(0).slice(row, end - row), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])

    found = rows.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint>>")
    return found.withColumnRenamed("id", id_col)
