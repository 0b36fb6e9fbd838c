"""Growing a place in LaTeX to whole syntax, and finding the part of a formula that says what a source says."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .latex import analyse

# Commands that wrap one group; how far boundaries lie from a place, and how many spans are tried.
WRAPPERS = {"bar", "boldsymbol", "hat", "mathbb", "mathbf", "mathcal", "mathit", "mathrm", "mathsf", "mathtt", "overline", "text", "underline", "vec"}
RADIUS, MOST = 128, 512
_LEXEME = re.compile(r"\\(?:[A-Za-z]+|.)|.", re.DOTALL)


@lru_cache(maxsize=256)
def lexemes(latex: str) -> tuple[tuple[int, int, str], ...]:
    return tuple((m.start(), m.end(), m[0]) for m in _LEXEME.finditer(latex))


@lru_cache(maxsize=256)
def groups(latex: str) -> tuple[tuple[int, int], ...]:
    """Start and end of each closed group in braces, the inner ones first."""
    stack, out = [], []
    for a, b, x in lexemes(latex):
        if x == "{":
            stack.append(a)
        elif x == "}" and stack:
            out.append((stack.pop(), b))
    return tuple(out)


@lru_cache(maxsize=256)
def units(latex: str) -> tuple[tuple[int, int], ...]:
    """Spans that belong together: commands, commands with the groups that they wrap, scripts with what they hold, left-right pairs."""
    closes = dict(groups(latex))
    lex = lexemes(latex)
    out = [(a, b) for a, b, x in lex if len(x) > 1]
    fences = []
    for i, (a, b, x) in enumerate(lex):
        end = b
        if x[1:] in WRAPPERS or x in (r"\frac", r"\sqrt", r"\stackrel", r"\text", r"\operatorname"):
            need = 2 if x in (r"\frac", r"\stackrel") else 1
            while need and end in closes:
                end, need = closes[end], need - 1
            out.append((a, end))
        elif x in ("_", "^") and i + 1 < len(lex):
            out.append((a, closes.get(b, lex[i + 1][1])))
        elif x == r"\left":
            fences.append(a)
        elif x == r"\right" and fences:
            out.append((fences.pop(), lex[i + 1][1] if i + 1 < len(lex) else b))
    return tuple(out)


def _crosses(a: int, b: int, x: int, y: int) -> bool:
    """Whether each of two spans reaches out of the other."""
    return a < x < b < y or x < a < y < b


def expanded(latex: str, start: int, end: int) -> tuple[int, int]:
    """The least span around [start, end) that cuts no command, unit or group, with the scripts, wrappers and dollars that hang on it."""
    wraps = {b: a for a, b, x in lexemes(latex) if x[1:] in WRAPPERS}  # where a wrapper ends, and so its group begins
    commands = [(a, b) for a, b, x in lexemes(latex) if len(x) > 1]
    while True:
        a, b = start, end
        for x, y in commands:
            if x < b and a < y:
                a, b = min(a, x), max(b, y)
        for x, y in (*units(latex), *groups(latex)):
            if _crosses(a, b, x, y):
                a, b = min(a, x), max(b, y)
        for x, y in groups(latex):
            if x in wraps and (a, b) in ((x, y), (x + 1, y - 1)):
                a, b = wraps[x], y
            if a <= x < b < y or (x < a and a < y <= b):  # one brace of two
                a, b = min(a, x), max(b, y)
        for x, y in units(latex):
            if x == b and latex[x] in "_^":
                b = y
            if a <= x < b < y:  # a command without all that it takes
                b = y
        if a > 0 and b < len(latex) and latex[a - 1] == latex[b] == "$":
            a, b = a - 1, b + 1
        if (a, b) == (start, end):
            return a, b
        start, end = a, b


def intervals(latex: str, start: int, end: int) -> list[tuple[int, int]]:
    """Candidate spans between syntax boundaries near a place, the nearest and shortest first."""
    marks = sorted({0, len(latex), *[x for pair in units(latex) for x in pair], *[x for pair in groups(latex) for x in (pair[0], pair[0] + 1, pair[1] - 1, pair[1])], *[a for a, _, _ in lexemes(latex)]})
    near = [m for m in marks if start - RADIUS <= m <= end + RADIUS]
    found = [(abs(a - start) + abs(b - end), b - a, a, b) for a in near for b in near if a < b and a < end and b > start]
    return [(a, b) for _, _, a, b in sorted(found)[:MOST]]


def locus(latex: str, start: int, end: int, tokens: list[str], signature: list[str]) -> tuple[int, int] | None:
    """The best span whose analysis gives the source's tokens and signature."""
    for a, b in intervals(latex, start, end):
        got = analyse(latex[a:b])
        if got[0] == tokens and got[1] == signature:
            return a, b
    return None


def marker(document: str, stem: str = "ATTESTA") -> str:
    """A text that the document doesn't hold."""
    n = 0
    while f"{stem}{n}X" in document:
        n += 1
    return f"{stem}{n}X"


def with_markers(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """Each span, taken from the right, replaced by the marker and its number."""
    for i, (a, b) in sorted(enumerate(spans), key=lambda x: x[1], reverse=True):
        text = f"{text[:a]}{mark}{i}Z{text[b:]}"
    return text


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def expanded_udf(latex: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([expanded(x or "", a, b) for x, a, b in zip(latex, starts, ends, strict=True)], columns=["start", "end"]).astype("int32")
