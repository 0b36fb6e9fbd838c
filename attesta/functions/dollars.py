"""Inline mathematics between dollars: two tokenizers, which differ on purpose.

``paired_spans`` takes runs of dollars without a backslash before them, two by two. ``math_spans`` takes single dollars with
an even number of backslashes before them, leaves out those that stand for money, and then pairs the rest.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Signs of relations and of mathematical syntax, what stands behind an amount, and amounts after a dollar.
_RELATIONS = "<>="
_syntax = re.compile(r"[+*/^_{}()\[\]\\]")
_SCALES = "kKmMbB"
_AMOUNT_AFTER = re.compile(r"\d+(?:[.,]\d+)?(?:\b|\Z)")


def unescaped(text: str, character: str) -> list[int]:
    """Places of a character that no odd run of backslashes escapes."""
    out, at = [], text.find(character)
    while at >= 0:
        slash = at
        while slash > 0 and text[slash - 1] == "\\":
            slash -= 1
        if (at - slash) % 2 == 0:
            out.append(at)
        at = text.find(character, at + 1)
    return out


def _is_relation(bare: str) -> bool:
    """Two texts without blanks, and one sign between them, next to blanks or not."""
    parts = bare.split()
    if len(parts) == 1:
        return any(c in bare[1:-1] for c in _RELATIONS)
    if len(parts) == 2:
        a, b = parts
        return len(a) > 1 and a[-1] in _RELATIONS or len(b) > 1 and b[0] in _RELATIONS
    return len(parts) == 3 and len(parts[1]) == 1 and parts[1] in _RELATIONS


def _amount_before(text: str, place: int) -> bool:
    """Whether an amount ends at a place: a number, a sign of scale, or both, behind a blank or at the start of the line.

    It is read backwards: what stands before it in the line costs nothing.
    """

    def free(i: int) -> bool:
        return i == 0 or text[i - 1].isspace()

    def digits(i: int) -> int:
        while i > 0 and text[i - 1].isdecimal():
            i -= 1
        return i

    i = place
    if i > 0 and text[i - 1] in _SCALES:
        i -= 1
        if free(i):
            return True
    while i > 0 and text[i - 1] != "\n" and text[i - 1].isspace():
        i -= 1
    whole = digits(i)
    if whole == i:
        return False
    if free(whole):
        return True
    part = whole - 1
    first = digits(part) if text[part] in ".," else part
    return first < part and free(first)


def is_math(latex: str) -> bool:
    bare = latex.strip()
    if not bare:
        return False
    if bare[0] in "\\{" or _syntax.search(bare) or _is_relation(bare):
        return True
    word = len(bare) > 1 and all(c.isalpha() for c in bare)
    return not word and not any(map(str.isspace, bare))


def _formula(text: str, a: int, b: int) -> bool:
    inner = text[a + 1 : b]
    return not ("\n" in inner or "\r" in inner) and is_math(inner)


def delimiters(text: str) -> list[int]:
    """Unescaped dollars but for amounts; a dollar next to a formula is never an amount."""
    at = unescaped(text, "$")
    formulas = [_formula(text, a, b) for a, b in zip(at, at[1:], strict=False)]
    kept = []
    for i, place in enumerate(at):
        beside = (i > 0 and formulas[i - 1]) or (i < len(formulas) and formulas[i])
        amount = _amount_before(text, place) or _AMOUNT_AFTER.match(text, place + 1)
        if beside or not amount:
            kept.append(place)
    return kept


def _between(text: str, at: list[int]) -> list[tuple[int, int, str]]:
    found = [(a, b + 1, text[a + 1 : b]) for a, b in zip(at[0::2], at[1::2], strict=False)]
    return [f for f in found if f[2] and "\n" not in f[2] and "\r" not in f[2]]


def math_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end (after the closing dollar) and the text between."""
    return _between(text, delimiters(text))


def paired_spans(text: str) -> list[tuple[int, int, str | None]]:
    """start, end and a reason code: spans of two runs of dollars, and an unpaired run up to the text's end."""
    marks = [m.span() for m in re.finditer(r"(?<!\\)\$+", text)]
    out: list[tuple[int, int, str | None]] = []
    while len(marks) > 1:
        (a, b), (c, d) = marks[:2]
        out.append((a, d, None if b - a == d - c == 1 else "inline_math_delimiter_unsupported"))
        marks = marks[2:]
    return out + [(a, len(text), "inline_math_delimiter_unpaired") for a, _ in marks]


def _spans(third: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField(third, T.StringType())]))


@F.pandas_udf(_spans("latex"))
def math_spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "latex": x} for a, b, x in math_spans(t or "")])


@F.pandas_udf(_spans("reason"))
def paired_spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "reason": r} for a, b, r in paired_spans(t or "")])


@F.pandas_udf(T.StructType([T.StructField("balanced", T.BooleanType()), T.StructField("spans", _spans("latex"))]))
def balanced_spans_udf(texts: pd.Series) -> pd.DataFrame:
    """Whether the delimiters come in pairs, and the spans: the text is read once for both."""
    rows = []
    for text in texts:
        at = delimiters(text or "")
        rows.append((len(at) % 2 == 0, [{"start": a, "end": b, "latex": x} for a, b, x in _between(text or "", at)]))
    return pd.DataFrame(rows, columns=["balanced", "spans"])


@F.pandas_udf(T.BooleanType())
def delimiters_balanced_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(delimiters(t or "")) % 2 == 0)
