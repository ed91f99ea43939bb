"""Operator 10: secret scans by sliding-window Shannon entropy.

What the entropy scan leaves out: strings under 20 characters; letters of one case without a digit (of random
20-character keys, 0.15 % in base36 and 1.6 % in base32); strings on the allow list, among them paths of words
with at most four digits at the end (NAME=letters is one), and in lower or upper case with digits also paths of words and numbers;
letters of both cases without a digit whose lower-case runs all have two or more letters, as in CamelCase.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brightfield.llm.common import map_texts, quoted

#: Kinds in the order that breaks ties of equal starts. The first three are the base patterns.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidate strings of the entropy scan: long runs.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9]+")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
#: Strings that look random and are none: identifiers with hyphens (UUID), digits only, paths of words.
ALLOWED = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9_=+/-]+|(?:[A-Za-z]+[/_=+-])+[A-Za-z]*[0-9]{0,4}|[=_+/-]+|(?:example|sample|dummy|placeholder|xxxx).*", re.IGNORECASE)
#: Paths of words (up to four digits at the end of each) and numbers, and letters that read as words and acronyms.
SLUG = re.compile(r"(?:(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)[/_=+-]+)+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)?")
CAMEL = re.compile(r"[A-Z]*+(?:[a-z]{2,}+[A-Z]*+)*+")
#: Characters in the window, and the share of random keys of that length that an entropy bound may miss.
WINDOW, MISS = 20, 0.005


def _partitions(n: int, most: int):
    if n == 0:
        yield ()
    for c in range(min(n, most), 0, -1):
        yield from ((c, *rest) for rest in _partitions(n - c, c))


@functools.cache
def least_bits(symbols: int, window: int = WINDOW, miss: float = MISS) -> float:
    """The largest bound that at most a share `miss` of random strings of `window` characters out of `symbols` stays under; exact, over all multisets of counts."""
    levels: dict[float, float] = {}
    for counts in _partitions(window, window):
        if len(counts) <= symbols:
            ways = math.perm(symbols, len(counts)) * math.factorial(window) // math.prod(map(math.factorial, [*counts, *Counter(counts).values()]))
            bits = round(math.log2(window) - sum(c * math.log2(c) for c in counts) / window, 9)
            levels[bits] = levels.get(bits, 0.0) + ways / symbols**window
    under = 0.0
    for bits in sorted(levels):
        under += levels[bits]
        if under > miss:
            return bits
    return max(levels)


#: Symbols of the kinds' alphabets: hexadecimal, base62, base36, base32, and letters of both cases for strings without a digit.
SYMBOLS = {"entropy_hex": 16, "entropy_mixed": 62, "entropy_lower": 36, "entropy_upper": 32, "letters": 52}


def bounds(window: int = WINDOW, **given: float | None) -> dict[str, float]:
    """Least entropy in bits by kind; those not given come from MISS."""
    return {kind: least_bits(n, window) if given.get(kind) is None else given[kind] for kind, n in SYMBOLS.items()}


def _entropy_table(window: int) -> list[float]:
    """c * log2(c) by count."""
    return [0.0] + [c * math.log2(c) for c in range(1, window + 1)]


def high_entropy(text: str, window: int, bits: float, table: list[float]) -> tuple[int, int] | None:
    """From the start of the first to the end of the last window with at least `bits`; counts change by one character a step."""
    if len(text) < window:
        return None
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    first = last = -1
    log_n = math.log2(window)
    for i, ch in enumerate(text):
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += table[c - 1] - table[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += table[c + 1] - table[c]
        if i >= window - 1 and log_n - total / window >= bits - 1e-9:
            if first < 0:
                first = i - window + 1
            last = i + 1
    return None if first < 0 else (first, last)


def classify(s: str, bits: dict[str, float]) -> tuple[int, float] | None:
    """Kind number and bound of a candidate string; None if it is allowed or of no class."""
    if ALLOWED.fullmatch(s):
        return None
    digit, upper, lower = any(c.isdigit() for c in s), any(c.isupper() for c in s), any(c.islower() for c in s)
    if HEX_RUN.fullmatch(s):
        return 3, bits["entropy_hex"]
    if upper and lower:
        if digit:
            return 4, bits["entropy_mixed"]
        return None if all(CAMEL.fullmatch(part) for part in PART.findall(s)) else (4, bits["letters"])
    if not digit or SLUG.fullmatch(s):
        return None
    return (5, bits["entropy_lower"]) if lower else (6, bits["entropy_upper"])


def find_secrets(text: str | None, window: int, bits: dict[str, float], table: list[float]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, sorted."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        whole = classify(s, bits)
        span = whole and high_entropy(s, window, whole[1], table)
        if span:
            found.append((at + span[0], whole[0], at + span[1]))
        # a key behind NAME= or a prefix can be of another class than the whole
        for part in PART.finditer(s) if whole else ():
            if window <= len(part.group()) < len(s) and (own := classify(part.group(), bits)) and own[0] != whole[0]:
                inner = high_entropy(part.group(), window, own[1], table)
                if inner and not (span and span[0] <= part.start() + inner[0] and part.start() + inner[1] <= span[1]):
                    found.append((at + part.start() + inner[0], own[0], at + part.start() + inner[1]))
    found.sort()
    return found


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, hex_bits: float | None = None, mixed_bits: float | None = None, lower_bits: float | None = None, upper_bits: float | None = None) -> DataFrame:
    """Adds secrets: array of (kind, start, end) in code points, end exclusive, by start, then kind as in KINDS.

    Base kinds: assign (keyword, separator and a value of 12 or more characters), access (key ids of 18
    or more) and hex (runs of 16 or more). Kinds of the method: windows of `window` characters inside
    candidate strings whose Shannon entropy reaches the bound of their character class (hexadecimal; both
    cases; lower case and digits; upper case and digits), unless the string is on the allow list. Bounds
    not given miss a share MISS of random keys of `window` characters at most. Null and empty texts have no spans; rows are independent, repeated
    rows give equal results, other columns pass through and one named secrets is replaced.
    """

    bits = bounds(window, entropy_hex=hex_bits, entropy_mixed=mixed_bits, entropy_lower=lower_bits, entropy_upper=upper_bits)

    def kernel():
        table = _entropy_table(window)

        def apply(texts):
            return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_secrets(t, window, bits, table)] for t in texts]]

        return apply

    return map_texts(df, text, kernel, T.StructType([T.StructField("secrets", SPAN)]), keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every maximal run of overlapping spans of its text replaced by `mark`; texts without spans, null and empty ones stay as they are."""

    bits = bounds()

    def kernel():
        table = _entropy_table(WINDOW)

        def clean(t):
            spans = find_secrets(t, WINDOW, bits, table)
            if not spans:
                return t
            out, end = [], 0
            for s, _, e in spans:
                if s >= end:
                    out += [t[end:s], mark]
                end = max(end, e)
            return "".join(out) + t[end:]

        return lambda texts: [[clean(t) for t in texts]]

    made = map_texts(df, text, kernel, T.StructType([T.StructField(text, T.StringType())]))
    return made.select(*(quoted(c) for c in df.columns))
