"""Secrets by rule and by inferred formats.

Grammar inference: the labelled credentials of a format make a prefix tree. As long as
few characters follow a state they are told apart (``ghp_``); from the first state that
any character may follow, letters and digits are one symbol with a distribution of
classes, and only joints are told apart. States that are statistically compatible
(Hoeffding bound, as in ALERGIA) in ends, symbols, classes and all that follows are
merged to a deterministic probabilistic automaton, the nearest in depth first, so fixed
lengths stay and free ones become loops. Every run of credential characters, and every
part of it between slashes and equal signs, is a candidate; its score is the largest
log-likelihood of a format less that of ordinary strings (a smoothed chain of character
classes). Base spans always stay.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import byte_table, runs, text_slices
from .spans import Span, any_in_text, apart, digest, longest_runs, secret_base, sha256

KINDS = ("assign", "access", "hex")
EVERY = (*KINDS, "format")
SAMPLES = 400
#: A state's next characters are told apart while at most FEW of them follow and at least SEEN strings do.
FEW, SEEN = 6, 25
ALPHA = 0.05
MARGIN = 3.0
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
CHARACTERS = "".join(CLASSES)
#: The class of each character, how many classes are of letters and digits, and the symbol of any of those.
CLASS = np.repeat(np.arange(len(CLASSES)), [len(c) for c in CLASSES])
PLAIN_CLASSES, ANY = 5, len(CHARACTERS)
ORDINARY = ("", "ids")
OTHER = "[redacted]"


def labelled_strings(seed: int = 7, samples: int = SAMPLES) -> dict[str, list[str]]:
    """The labelled table, made by rule from a seed: strings of public credential formats, and ordinary ones under '' (words and numbers) and 'ids' (random identifiers).

    Lengths vary about those that are in use, as they have over the years, and prefixes
    come with their siblings, so the automata's ends merge to loops. A credential without
    a fixed part, such as 40 random characters, is not in it: nothing but its context
    tells it from an identifier.
    """
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digit, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    every = digit + low + up
    make = {
        "hex": lambda: some("0123456789abcdef", r.choice([32, 40, 64])),
        "access": lambda: "AKIA" + some(up + digit, 16),
        "prefixed": lambda: r.choice(["ghp_", "gho_", "ghs_", "ghu_", "ghr_"]) + some(every, r.randint(20, 60)),
        "live": lambda: r.choice(["sk_live_", "rk_live_", "pk_live_", "sk_test_", "rk_test_"]) + some(every, r.randint(20, 110)),
        "chat": lambda: f"xox{r.choice('baprs')}-{some(digit, r.randint(9, 14))}-{some(digit, r.randint(9, 14))}-{some(every, r.randint(20, 40))}",
        "signed": lambda: f"eyJ{some(every, r.randint(17, 40))}.eyJ{some(every + '_-', r.randint(30, 90))}.{some(every + '_-', 43)}",
        "maps": lambda: "AIza" + some(every + "_-", r.randint(28, 48)),
        "forge": lambda: r.choice(["glpat-", "gldt-", "glrt-"]) + some(every + "_-", r.randint(18, 32)),
        "package": lambda: "npm_" + some(every, r.randint(24, 64)),
        "fine": lambda: "github_pat_" + some(every, 22) + "_" + some(every, 59),
        "mail": lambda: "SG." + some(every + "_-", 22) + "." + some(every + "_-", 43),
        "index": lambda: "pypi-AgEIcHlwaS5vcmc" + some(every + "_-", r.randint(60, 150)),
    }
    word = lambda: some(low, r.randint(2, 12))
    plain = [
        lambda: some(low, r.randint(16, 40)),
        lambda: some(low, r.randint(16, 40)).capitalize(),
        lambda: some(up, r.randint(16, 40)),
        lambda: r.choice("_-./").join(word() for _ in range(r.randint(3, 7))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))),
        lambda: f"www.{word()}.{r.choice(['com', 'org', 'net'])}/{word()}/{word()}-{some(digit, r.randint(1, 4))}.html",
        lambda: some(digit, r.randint(16, 24)),
        lambda: f"{word()}{word()}_{some(digit, r.randint(1, 6))}_{word()}",
        lambda: r.choice(".=-_") * r.randint(16, 60),
        lambda: f"20{some(digit, 2)}-{some(digit, 2)}-{some(digit, 2)}-{some(digit, 6)}",
        lambda: f"{some(digit, 3)}.{some(digit, 3)}.{some(digit, 3)}.{some(digit, 3)}-{some(digit, 3)}",
    ]
    ids = [
        lambda: some(every, r.randint(16, 64)),
        lambda: some(low + digit, r.randint(16, 48)),
        lambda: some(up + digit, r.randint(16, 48)),
        lambda: "-".join(some(low + digit, r.choice([4, 8, 12])) for _ in range(r.randint(3, 5))),
        lambda: r.choice("_-").join(some(every, r.randint(6, 24)) for _ in range(r.randint(2, 3))),
        lambda: some(every + "+/", r.randint(5, 40) * 4),
    ]
    table = {name: [f() for _ in range(samples)] for name, f in make.items()}
    return table | {"": [r.choice(plain)() for _ in range(samples * 6)], "ids": [r.choice(ids)() for _ in range(samples * 6)]}


class Automaton:
    """A probabilistic automaton: next state (-1: none) and log-probability of each state and character, and of ending in each state."""

    def __init__(self, strings: list[np.ndarray], alpha: float = ALPHA):
        self.counts: list[dict[int, int]] = []
        self.after: list[dict[int, int]] = []
        self.ends: list[int] = []
        self.kinds: list[list[int]] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        self.plant(strings)
        bound = np.sqrt(0.5 * np.log(2 / alpha))
        red = [0]
        while blue := {to: (r, c) for r in red for c, to in self.after[r].items() if to not in red}:
            # The state that most strings reach is decided first.
            b = max(blue, key=lambda x: (self.size[x], -x))
            for r in sorted(red, key=lambda x: (abs(self.depth[x] - self.depth[b]), x)):
                if self.alike(r, b, bound):
                    source, c = blue[b]
                    self.after[source][c] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
        number = {r: i for i, r in enumerate(red)}
        self.next = np.full((len(red), ANY), -1)
        self.log = np.full((len(red), ANY + 1), -np.inf)
        within = np.array([len(c) for c in CLASSES])[CLASS]
        for r, i in number.items():
            total = self.size[r]
            if ANY in self.after[r]:
                plain = CLASS < PLAIN_CLASSES
                share = np.array(self.kinds[r]) + 1e-3
                share /= share.sum()
                self.next[i, plain] = number[self.after[r][ANY]]
                self.log[i, :-1][plain] = np.log(self.counts[r][ANY] / total * share[CLASS[plain]] / within[plain])
            for c, to in self.after[r].items():
                if c != ANY:
                    self.next[i, c], self.log[i, c] = number[to], np.log(self.counts[r][c] / total)
            if self.ends[r]:
                self.log[i, ANY] = np.log(self.ends[r] / total)
        self.steps, self.costs = self.next.tolist(), self.log.tolist()

    def node(self, depth: int) -> int:
        self.counts.append({}), self.after.append({}), self.ends.append(0), self.kinds.append([0] * PLAIN_CLASSES), self.depth.append(depth), self.size.append(0)
        return len(self.ends) - 1

    def plant(self, strings: list[np.ndarray]) -> None:
        """The prefix tree of the strings."""
        waiting = [(self.node(0), 0, [s.tolist() for s in strings], True)]
        while waiting:
            at, t, own, exact = waiting.pop()
            self.size[at] = len(own)
            exact = exact and len(own) >= SEEN and len({s[t] for s in own if len(s) > t}) <= FEW
            below: dict[int, list[list[int]]] = {}
            for s in own:
                if len(s) == t:
                    self.ends[at] += 1
                    continue
                c = s[t]
                if not exact and CLASS[c] < PLAIN_CLASSES:
                    self.kinds[at][CLASS[c]] += 1
                    c = ANY
                below.setdefault(c, []).append(s)
            for c, some in sorted(below.items()):
                to = self.node(t + 1)
                self.counts[at][c], self.after[at][c] = len(some), to
                waiting.append((to, t + 1, some, exact))

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether the rates of ends, symbols and classes of both states, and of the states below the second, are within the Hoeffding bound."""
        waiting = [(a, b)]
        while waiting:
            x, y = waiting.pop()
            n, m = self.size[x], self.size[y]
            room = bound * (n**-0.5 + m**-0.5)
            if abs(self.ends[x] / n - self.ends[y] / m) > room:
                return False
            for c in self.counts[x].keys() | self.counts[y].keys():
                if abs(self.counts[x].get(c, 0) / n - self.counts[y].get(c, 0) / m) > room:
                    return False
            p, q = sum(self.kinds[x]), sum(self.kinds[y])
            if p and q and max(abs(i / p - j / q) for i, j in zip(self.kinds[x], self.kinds[y], strict=True)) > bound * (p**-0.5 + q**-0.5):
                return False
            waiting += [(self.after[x][c], to) for c, to in self.after[y].items() if c in self.after[x]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        waiting = [(a, b)]
        while waiting:
            x, y = waiting.pop()
            self.size[x] += self.size[y]
            self.ends[x] += self.ends[y]
            self.kinds[x] = [i + j for i, j in zip(self.kinds[x], self.kinds[y], strict=True)]
            for c, n in self.counts[y].items():
                self.counts[x][c] = self.counts[x].get(c, 0) + n
            for c, to in self.after[y].items():
                if c in self.after[x]:
                    waiting.append((self.after[x][c], to))
                else:
                    self.after[x][c] = to

    def likelihood(self, characters: list[int]) -> float:
        """The log-likelihood of a string; it is left at the first character that cannot follow."""
        state, total = 0, 0.0
        for c in characters:
            total += self.costs[state][c]
            state = self.steps[state][c]
            if state < 0:
                return -np.inf
        return total + self.costs[state][ANY]


class Ordinary:
    """A chain over the classes of a string's characters that looks two classes back; a character is as likely as others of its class."""

    def __init__(self, strings: list[np.ndarray]):
        self.n = len(CLASSES) + 1  # the last one stands before a string and after it
        self.within = np.log([len(c) for c in CLASSES])[CLASS]
        counts = np.full((self.n**2, self.n), 0.5)
        for s in strings:
            np.add.at(counts, self.steps(s), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def steps(self, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = self.n - 1
        kind = np.r_[edge, edge, CLASS[characters], edge]
        return kind[:-2] * self.n + kind[1:-1], kind[2:]

    def likelihood(self, characters: np.ndarray) -> float:
        return float(self.log[self.steps(characters)].sum() - self.within[characters].sum())


class Formats:
    """The formats' automata and the chain of ordinary strings, with the score from which a candidate is a secret."""

    def __init__(self, table: dict[str, list[str]]):
        self.of_byte = np.full(256, -1)
        self.of_byte[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(ANY)
        coded = {name: [self.symbols(np.frombuffer(s.encode(), np.uint8)) for s in strings] for name, strings in table.items()}
        self.formats = [Automaton(strings) for name, strings in coded.items() if name not in ORDINARY]
        self.chains = [Ordinary(coded[name]) for name in ORDINARY]
        #: No format accepts a string that is shorter than all labelled ones.
        self.shortest = min(len(s) for name, strings in coded.items() if name not in ORDINARY for s in strings)
        # Ordinary strings of the table score below it, with a margin for those that are not in the table.
        self.least = max(0.0, *(float(self.scores(coded[name]).max()) for name in ORDINARY)) + MARGIN

    def symbols(self, data: np.ndarray) -> np.ndarray:
        return self.of_byte[data]

    def score(self, characters: np.ndarray) -> float:
        plain = characters.tolist()
        best = max(a.likelihood(plain) for a in self.formats)
        return best - self.plain(characters) if best > -np.inf else -np.inf

    def plain(self, characters: np.ndarray) -> float:
        """The log-likelihood of an ordinary string of any kind."""
        return float(np.logaddexp.reduce([c.likelihood(characters) for c in self.chains]) - np.log(len(self.chains)))

    def scores(self, strings: list[np.ndarray]) -> np.ndarray:
        return np.array([self.score(s) for s in strings])


@lru_cache(maxsize=1)
def known_formats() -> Formats:
    return Formats(labelled_strings())


def format_spans(formats: Formats, data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Spans (code points) in each text of the candidates that score as a format. A candidate is a run of credential characters without dots, dashes and equal signs around it, else any of its parts between slashes and equal signs."""
    starts, stops = runs(table[data], ends)
    long = stops - starts >= formats.shortest
    starts, stops = starts[long], stops[long]
    found: dict[int, list[tuple[int, int]]] = {}
    loose, cut = byte_table(*b".-="), byte_table(*b"/=")
    # Code points before each byte: bytes that do not continue one.
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(starts) else None

    def inner(a: int, b: int) -> tuple[int, int]:
        """Without loose characters at the ends."""
        firm = np.flatnonzero(~loose[data[a:b]])
        return (a + int(firm[0]), a + int(firm[-1]) + 1) if len(firm) else (a, a)

    def hit(a: int, b: int) -> bool:
        if b - a < formats.shortest or formats.score(formats.symbols(data[a:b])) < formats.least:
            return False
        i = int(np.searchsorted(ends, a, "right")) - 1
        found.setdefault(i, []).append((int(points[a] - points[ends[i]]), int(points[b] - points[ends[i]])))
        return True

    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if hit(*inner(a, b)):
            continue
        edge = np.flatnonzero(cut[data[a:b]]) + a
        if len(edge):
            for x, y in zip([a, *(edge + 1).tolist()], [*edge.tolist(), b], strict=True):
                if y - x >= formats.shortest:
                    hit(*inner(x, y))
    return found


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: _id, _text, the ``keep`` columns as _0, _1, ..., n_assign, n_access, n_hex and base_sha256 of the base spans, spans (all) and found (kind, start, end; code points).

    Base spans are leftmost and non-overlapping in each kind; added ones (``format``)
    overlap no other span. Null and empty texts have none; every text is read whole. Null
    ids and repeated rows are kept; other columns are ignored.
    """
    formats = known_formats()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    schema = T.StructType(rows.schema.fields + T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint>>").fields)
    none = sha256("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(*CHARACTERS.encode())
        hexes, joins, upper = byte_table(*b"0123456789abcdef"), byte_table(*b":="), byte_table(range(65, 91), range(48, 58))
        for batch in batches:
            column = batch.column(1)
            for row, end, data, ends in text_slices(column):
                more = format_spans(formats, data, ends, table)
                maybe = (any_in_text(joins[data], ends) > 0) | (longest_runs(hexes[data], ends) >= 16) | (longest_runs(upper[data], ends) >= 18)
                out = []
                for i in range(end - row):
                    own: list[Span] = []
                    added: list[Span] = []
                    if maybe[i] or i in more:
                        text = column[row + i].as_py()
                        if maybe[i]:
                            own = secret_base(text)
                        if i in more:
                            added = apart(own, [(a, b, "format") for a, b in more[i]])
                    every = sorted(own + added)
                    out.append((*(sum(s[2] == k for s in own) for k in KINDS), sha256(digest(own, EVERY)) if own else none, digest(every, EVERY), [{"kind": k, "start": a, "end": b} for a, b, k in every]))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
                part = batch.slice(row, end - row)
                yield pa.record_batch([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [*part.schema.names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, schema)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``secret_spans`` without the texts."""
    found = secret_spans(docs, id_col, text_col)
    return found.select(F.col("_id").alias(id_col), *found.columns[2:])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in a text replaced by ``[redacted]``; rows and other columns stay."""
    clear = F.col("_text")
    # Overlapping spans become one; the pieces between them are kept.
    spans = F.aggregate(
        F.col("found"),
        F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)"),
        lambda got, s: F.when((F.size(got) > 0) & (F.element_at(got, -1)["b"] > s["start"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["a"].alias("a"), F.greatest(F.element_at(got, -1)["b"], s["end"]).alias("b"))))).otherwise(F.concat(got, F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"))))),
    )
    joined = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda got, s: F.struct(F.concat(got["done"], F.substring(clear, (got["at"] + 1).cast("int"), (s["a"] - got["at"]).cast("int")), F.lit(OTHER)).alias("done"), s["b"].alias("at")),
        lambda got: F.concat(got["done"], F.substring(clear, (got["at"] + 1).cast("int"), F.length(clear))),
    )
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = secret_spans(docs, id_col, text_col, tuple(others))
    cleaned = F.when(F.size("found") > 0, joined).otherwise(clear)
    of = {c: f"_{i}" for i, c in enumerate(others)}
    return found.select(*[F.col("_id").alias(id_col) if c == id_col else cleaned.alias(text_col) if c == text_col else F.col(of[c]).alias(c) for c in docs.columns])
