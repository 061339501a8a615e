"""Secrets in texts: fixed patterns, and values in a credential context that cost many guesses.

The guess cost of a value is the cheapest way to split it into common words, dates, repeats, sequences, keyboard walks and brute-force
spans; the guesses of the parts multiply. A dynamic program over the value finds it. A value that nobody guesses soon is a secret, a
placeholder such as ``password: changeme`` is not.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.words import bounded_batches

KINDS = ("assign", "access", "hex", "cost")     # in the order that spans with the same start take
LEAST_COST = 10.0                               # decimal logarithm of the guesses that make a value a secret

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private)[_-]?key)"""
    r"""["']?(?:[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*|\x20+is\x20+)["'`]?([^\s"'`,;<>]+)""", re.I | re.A)
# what each pattern cannot match without, in lower case
_ASSIGN_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_MARKS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

# Common words of passwords, the most common first
COMMON = (
    "password 123456 qwerty admin welcome login letmein secret test changeme default user root master hello world love "
    "monkey dragon sunshine princess football baseball shadow superman batman computer internet service server "
    "database summer winter spring autumn monday friday sunday january march april june july august december orange "
    "apple banana cookie pepper ginger tiger lion horse eagle star silver gold black white green blue purple happy "
    "lucky angel killer soccer hockey guitar music coffee cheese freedom trust please access system example sample "
    "token key code your the and for with this that none null true false guest demo temp backup public private "
    "foo bar baz pass word house river mountain battery staple correct").split()
_RANKS = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
_LONGEST = max(map(len, COMMON))
_PLAIN = str.maketrans("013457@$!", "oieastasi")          # letters that digits and signs stand for
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|"
                   r"(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_DATE_GUESSES = math.log10(365 * 120)
_YEAR_GUESSES = math.log10(120)


def _neighbours() -> set[tuple[str, str]]:
    pairs = set()
    for y, row in enumerate(_ROWS):
        for x, c in enumerate(row):
            around = [(x + 1, y), (x, y + 1), (x - 1, y + 1)]
            for nx, ny in around:
                if ny < len(_ROWS) and 0 <= nx < len(_ROWS[ny]):
                    pairs |= {(c, _ROWS[ny][nx]), (_ROWS[ny][nx], c)}
    return pairs


_BESIDE = _neighbours()


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _runs(value: str) -> list[tuple[int, int, float]]:
    """Spans of one repeated character, of neighbouring codes (abc, 321) and of keyboard walks, with their cost."""
    lower, found = value.lower(), []
    steps = {
        "repeat": lambda a, b: a == b, "up": lambda a, b: ord(b) - ord(a) == 1, "down": lambda a, b: ord(a) - ord(b) == 1,
        "walk": lambda a, b: (a, b) in _BESIDE}
    for kind, follows in steps.items():
        begin = 0
        for i in range(1, len(lower) + 1):
            if i == len(lower) or not follows(lower[i - 1], lower[i]):
                if i - begin >= 3:
                    turns = 0.45 * (i - begin) if kind == "walk" else math.log10(i - begin)
                    found.append((begin, i, _alphabet(value[begin]) + turns))
                begin = i
    return found


def _repeated_blocks(value: str) -> list[tuple[int, int, int]]:
    """Spans that are one block of 2 to 8 characters over and over: begin, end, block size."""
    found = []
    for size in range(2, min(8, len(value) // 2) + 1):
        begin = 0
        for i in range(size, len(value) + 1):
            if i == len(value) or value[i] != value[i - size]:
                if i - begin >= 2 * size:
                    found.append((begin, i, size))
                begin = i - size + 1
    return found


def guess_cost(value: str) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs; 0 for an empty one."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    lower = value.lower()
    plain = lower.translate(_PLAIN)
    spans: dict[int, list[tuple[int, float]]] = defaultdict(list)          # by their end: begin, cost
    for begin, end, cost in _runs(value):
        spans[end].append((begin, cost))
    for begin, end, size in _repeated_blocks(value):
        spans[end].append((begin, sum(map(_alphabet, value[begin:begin + size])) + math.log10((end - begin) / size)))
    for begin in range(n):
        if match := _DATE.match(value, begin):
            spans[match.end()].append((begin, _YEAR_GUESSES if match.end() - begin == 4 else _DATE_GUESSES))
        for end in range(begin + 3, min(n, begin + _LONGEST) + 1):
            rank = _RANKS.get(lower[begin:end])
            cost = 0.0
            if rank is None and (rank := _RANKS.get(plain[begin:end])):
                cost = math.log10(4)                                       # for the signs in place of letters
            if rank:
                capitals = value[begin:end] != lower[begin:end]
                spans[end].append((begin, math.log10(rank + 1) + cost + capitals * math.log10(3)))
    for end in range(1, n + 1):
        best[end] = best[end - 1] + _alphabet(value[end - 1])              # brute force, one character more
        for begin, cost in spans.get(end, ()):
            best[end] = min(best[end], best[begin] + cost + 0.3)           # 0.3: where the parts meet
    return best[n]


def find_secrets(text: str | None, least_cost: float = LEAST_COST, inside: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then by kind in the order of ``KINDS``. A costly value that a span of another
    kind holds whole has a span of its own only if ``inside``."""
    if not text:
        return []
    lower = text.lower()
    found = [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] \
        if "AKIA" in text else []
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if any(m in lower for m in _ASSIGN_MARKS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if any(m in lower for m in _CONTEXT_MARKS):
        base = [(start, end) for _, start, end in found]
        for m in _CONTEXT.finditer(text):
            start, end = m.span(1)
            if guess_cost(m[1]) >= least_cost and (inside or not any(a <= start and end <= b for a, b in base)):
                found.append(("cost", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(text, least_cost: float = LEAST_COST):
    """A column with all spans of a text column. A null or empty text has none; texts are scanned whole, and a span never
    depends on another row. The kinds but ``cost`` are fixed patterns; every value in a credential context is scored, whatever
    spans it meets, and a costly one has a ``cost`` span beside theirs."""
    @F.arrow_udf(_SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t.as_py(), least_cost, inside=True)] for t in texts]
        return pa.array(rows, _SPANS_ARROW)

    return spans(text)


def joined(spans):
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns but ``secrets``; repeated rows each get theirs) with the array of spans."""
    return bounded_batches(docs).withColumn("secrets", secret_spans(F.col("text")))
