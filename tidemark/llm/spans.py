"""Base spans by rule, and the digests of spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np

from .arrays import owner, runs

Span = tuple[int, int, str]


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no match of their own

MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number that does not match from its first digit does not match from a later one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small_parts(ip: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in ip.split(".")))


def addresses(run: str, domain: re.Pattern = DOMAIN) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL@DOMAIN in a run of their characters, in linear time: the local part is all that stands between the last match or at sign and this one."""
    found, start, at = [], 0, run.find("@")
    while at >= 0:
        end = at + 1
        if at > start and (m := domain.match(run, end)):
            found.append((start, m.end()))
            end = m.end()
        start, at = end, run.find("@", end)
    return found


def secret_base(text: str) -> list[Span]:
    """Base spans of secrets. ASSIGN's span is the whole match."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def personal_base(text: str) -> list[Span]:
    """Base spans of personal data."""
    found: list[Span] = []
    if "@" in text:
        for run in MAIL_RUN.finditer(text):
            if "@" in run[0]:
                found += [(run.start() + a, run.start() + b, "email") for a, b in addresses(run[0])]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def apart(spans: list[Span], extra: list[Span]) -> list[Span]:
    """Those of ``extra`` that overlap neither ``spans`` nor an earlier one of ``extra``."""
    taken = sorted((a, b) for a, b, _ in spans)
    kept: list[Span] = []
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    last = -1
    for a, b, k in sorted(extra):
        i = int(np.searchsorted(starts, b)) - 1 if taken else -1
        if a >= last and (i < 0 or ends[i] <= a):
            kept.append((a, b, k))
            last = b
    return kept


def longest_runs(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The longest run of True in each text."""
    n = len(ends) - 1
    longest = np.zeros(n, np.int64)
    start, stop = runs(mask, ends)
    np.maximum.at(longest, owner(start, ends), stop - start)
    return longest


def any_in_text(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many True bytes each text has."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


Finder = Callable[[str], list[Span]]
