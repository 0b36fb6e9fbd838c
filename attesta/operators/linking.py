"""Linking of source regions to places in candidate texts by sequence alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EQUIVALENTS, IGNORED


class _Counted(dict):
    """By character: its equivalent, or None for one that doesn't count."""

    def __missing__(self, c: str) -> str | None:
        self[c] = found = None if c.isspace() or c in IGNORED else EQUIVALENTS.get(c, c)
        return found


_counted = _Counted()


def characters(text: str) -> list[tuple[str, int]]:
    """Characters that count in an alignment, as their equivalents, with their places."""
    return [(e, i) for i, c in enumerate(text) if (e := _counted[c]) is not None]


def _common(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def longest_match(a: str, b: str) -> tuple[int, int, int]:
    """Where the longest text that both hold stands in each, the first in a and then the first in b, and its length.

    A length is tried by looking for the parts of a in b. What both begin or end with is a first bound, so texts that hardly differ
    have few parts to look for.
    """

    def first(size: int) -> int:
        return next((i for i in range(len(a) - size + 1) if a[i : i + size] in b), -1)

    size = max(_common(a, b), _common(a[::-1], b[::-1]))
    step, beyond, bounded = 1, min(len(a), len(b)) + 1, False
    while size + 1 < beyond:
        probe = min(size + step, beyond - 1)
        if first(probe) >= 0:
            size = probe
        else:
            beyond, bounded = probe, True
        step = max(1, (beyond - size) // 2) if bounded else step * 2
    if not size:
        return 0, 0, 0
    i = first(size)
    return i, b.index(a[i : i + size]), size


def aligned(document: str, source: str) -> dict[int, int]:
    """Places in the source to places in the document, by longest matching blocks first."""
    out, open_ = {}, [(0, len(document), 0, len(source))]
    while open_:
        alow, ahigh, blow, bhigh = open_.pop()
        if alow == ahigh or blow == bhigh:
            continue
        i, j, size = longest_match(document[alow:ahigh], source[blow:bhigh])
        if size:
            i, j = i + alow, j + blow
            out.update(zip(range(j, j + size), range(i, i + size), strict=True))
            open_ += [(alow, i, blow, j), (i + size, ahigh, j + size, bhigh)]
    return out


def locate(document: str, source: str, wanted: list[int], formula: bool) -> tuple[int, int, str] | None:
    """start, end in the document of the wanted places of the source, and the method; null if they aren't proven.

    Text needs all wanted places, in one piece. Or, anchored: first and last match, the span between them is as long as the
    source's, and most of it matches. A formula needs any match.
    """
    doc, src = characters(document), characters(source)
    place = {i: k for k, (_, i) in enumerate(src)}
    targets = [place[w] for w in wanted if w in place]
    if not targets:
        return None
    found = aligned("".join(c for c, _ in doc), "".join(c for c, _ in src))
    hits = [found[t] for t in targets if t in found]
    whole = len(hits) == len(targets) and targets[-1] - targets[0] + 1 == len(targets)
    method = "glyph_alignment"
    if not whole and not formula:
        ends = targets[0] in found and targets[-1] in found
        if not ends or found[targets[-1]] - found[targets[0]] + 1 != len(targets) or 2 * len(hits) <= len(targets):
            return None
        hits, method = [found[targets[0]], found[targets[-1]]], "boundary_anchored_alignment"
    if not hits:
        return None
    return doc[min(hits)][1], doc[max(hits)][1] + 1, method


LOCATED = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("method", T.StringType())])


@F.pandas_udf(LOCATED)
def locate_udf(documents: pd.Series, sources: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    """The place of source[start : start + length] in the document."""
    rows = [locate(d, s, list(range(a, a + n)), False) or (None, None, None) for d, s, a, n in zip(documents, sources, starts, lengths, strict=True)]
    return pd.DataFrame(rows, columns=["start", "end", "method"]).astype({"start": "Int32", "end": "Int32"})


def unique_context(text: str, start: int, end: int, most: int = 128) -> tuple[int, int] | None:
    """The shortest context around a span that stands only once in the text; it grows by a character, right before left."""
    left, right = 0, 0
    while left <= most:
        a, b = max(0, start - left), min(len(text), end + right)
        part = text[a:b]
        if part and text.find(part) == a and text.find(part, a + 1) < 0:
            return a, b
        if a == 0 and b == len(text):
            return None
        if right <= left:
            right += 1
        else:
            left += 1
    return None
