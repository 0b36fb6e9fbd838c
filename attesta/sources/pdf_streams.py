"""Decoded PDF content streams and ToUnicode maps: what can be read without a renderer.

Streams come as bytes, fonts as maps from codes to characters; the readers are row functions for a grouped or mapped call. Failures
are rows with a reason, never exceptions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cmaps import INVALID, UNSUPPORTED

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\](){}/%]*|\(|[^\s<>\[\](){}/%]+")
_MARK = re.compile(rb"[\\()]")
# Escapes in literal strings, and rendering modes that show nothing.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
INVISIBLE = {3, 7}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from the byte after the opening one, and the place behind it."""
    out, depth = bytearray(), 1
    while m := _MARK.search(data, at):
        out += data[at : m.start()]
        at, c = m.end(), m[0]
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                if e not in b"\r\n":
                    out += _ESCAPES.get(e, e)
                at += 1
            continue
        depth += 1 if c == b"(" else -1
        if not depth:
            return bytes(out), at
        out += c
    raise ValueError("string_unterminated")


def tokens(data: bytes) -> Iterator[Any]:
    """Operands as numbers, bytes, names (with their slash) and lists; operators as text."""
    at, stack = 0, []
    while m := _TOKEN.search(data, at):
        at, word = m.end(), m[0]
        if word[:1] == b"%":
            continue
        if word == b"[":
            stack.append([])
            continue
        if word == b"]":
            if not stack:
                raise ValueError("array_unbalanced")
            value: Any = stack.pop()
        elif word == b"(":
            value, at = _literal(data, at)
        elif word[:1] == b"<" and word != b"<<":
            digits = re.sub(rb"\s", b"", word[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            value = float(word)
        else:
            value = word.decode("latin-1")
        if stack:
            stack[-1].append(value)
        else:
            yield value
    if stack:
        raise ValueError("array_unbalanced")


def times(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """Affine product: first m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def chunks(data: bytes, fonts: dict[str, dict[str, Any]], height: float) -> tuple[list[tuple], list[dict[str, Any]], str | None]:
    """What is shown, string by string: font, codes, texts, size, x, y and operation; boxes of objects drawn with Do, and a reason where reading stopped.

    ``fonts``: by resource, ``width`` (bytes of a code) and ``map`` (code to text). A font in which one code can't be read is left out
    as a whole, what came before included.
    """
    found, boxes, operands = [], [], []
    state = {"ctm": IDENTITY, "font": None, "size": 0.0, "mode": 0}
    saved: list[dict[str, Any]] = []
    matrix = line = IDENTITY
    limited: dict[str, str] = {}
    operation = 0

    def show(text: bytes) -> None:
        font = fonts.get(state["font"])
        if state["mode"] in INVISIBLE:
            return
        if font is None:
            limited.setdefault(str(state["font"]), "font_missing")
            return
        x, y = times(matrix, state["ctm"])[4:]
        if not isinstance(text, bytes) and len(text):
            raise TypeError("no string")
        width = font["width"]
        codes = list(text) if width == 1 else [int.from_bytes(text[k : k + width], "big") for k in range(0, len(text), width)]
        us = [*map(font["map"].get, codes)]
        if None in us or len(text) % width:
            limited.setdefault(state["font"], "glyph_undecodable")
        found.append((state["font"], codes, us, state["size"], x, height - y, operation))

    try:
        for value in tokens(data):
            if not isinstance(value, str) or value.startswith("/"):
                operands.append(value)
                continue
            operation += 1
            if value == "q":
                saved.append(dict(state))
            elif value == "Q" and saved:
                state = saved.pop()
            elif value == "cm":
                state["ctm"] = times(tuple(operands[-6:]), state["ctm"])
            elif value == "BT":
                matrix = line = IDENTITY
            elif value == "Tf":
                state["font"], state["size"] = operands[-2], operands[-1]
            elif value == "Tr":
                state["mode"] = int(operands[-1])
            elif value == "Tm":
                matrix = line = tuple(operands[-6:])
            elif value in ("Td", "TD"):
                matrix = line = times((1.0, 0.0, 0.0, 1.0, operands[-2], operands[-1]), line)
            elif value in ("Tj", "'"):
                show(operands[-1])
            elif value == "TJ":
                for part in operands[-1]:
                    if isinstance(part, bytes):
                        show(part)
            elif value == "Do":
                corners = [times((1.0, 0.0, 0.0, 1.0, x, y), state["ctm"])[4:] for x in (0.0, 1.0) for y in (0.0, 1.0)]
                xs, ys = [c[0] for c in corners], [height - c[1] for c in corners]
                boxes.append({"name": operands[-1], "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys)})
            operands = []
    except (ValueError, IndexError, TypeError) as e:
        return [], boxes, str(e) if str(e) in ("string_unterminated", "array_unbalanced") else "content_stream_invalid"
    return [c for c in found if c[0] not in limited], boxes, ",".join(f"{f}:{r}" for f, r in sorted(limited.items())) or None


def shown(data: bytes, fonts: dict[str, dict[str, Any]], height: float) -> tuple[list[dict[str, Any]], list[dict[str, Any]], str | None]:
    """Glyphs, boxes of objects drawn with Do, and a reason where reading stopped (see ``chunks``)."""
    found, boxes, reason = chunks(data, fonts, height)
    return [{"font": f, "code": c, "u": u or "", "size": size, "x": x, "y": y, "operation": op} for f, codes, us, size, x, y, op in found for c, u in zip(codes, us, strict=True)], boxes, reason


#: Glyphs that a task holds as rows at once.
GLYPHS = 65_536
SHOWN = "sequence int, font string, code int, u string, size double, x double, y double, operation int, reason string"


def glyph_rows(pages: DataFrame, keys: list[str], fonts: dict[str, dict[str, Any]], height: float) -> DataFrame:
    """A row per glyph of each page (keys, content); a page that gives none keeps one row with its reason."""
    schema = ", ".join([f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys] + [SHOWN])

    kinds = {"sequence": pa.int32(), "font": pa.string(), "code": pa.int32(), "u": pa.string(), "size": pa.float64(), "x": pa.float64(), "y": pa.float64(), "operation": pa.int32(), "reason": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for k in range(len(batch)):
                # Few glyphs are held at once: a long string is cut, short ones are put together.
                for part in _rows(k, batch["content"][k].as_py() or b"", fonts, height):
                    held.append(part)
                    n += len(part[1])
                    if n >= GLYPHS:
                        yield _batch(batch, held, keys, kinds)
                        held, n = [], 0
            if held:
                yield _batch(batch, held, keys, kinds)

    return pages.select(*keys, "content").mapInArrow(run, schema)


def _rows(k: int, content: bytes, fonts: dict[str, dict[str, Any]], height: float) -> Iterator[tuple]:
    """Runs of rows of page ``k``: their sequences, fonts, codes, texts, and what all of a run share."""
    found, _, reason = chunks(content, fonts, height)
    at = 0
    for font, codes, us, *rest in found:
        for i in range(0, len(codes), GLYPHS):
            some = codes[i : i + GLYPHS]
            yield k, range(at, at + len(some)), font, some, us[i : i + GLYPHS], (*rest, reason)
            at += len(some)
    if not at:
        yield k, [None], None, [None], [None], (None, None, None, None, reason or "no_glyphs")


def _batch(batch: pa.RecordBatch, held: list[tuple], keys: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    at = pa.array(np.repeat([h[0] for h in held], [len(h[1]) for h in held]), pa.int32())
    run = pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held]), pa.int32())
    each = {"sequence": pa.array([x for h in held for x in h[1]], pa.int32()), "code": pa.array([x for h in held for x in h[3]], pa.int32()), "u": pa.array([x for h in held for x in h[4]], pa.string())}
    each["font"] = pa.array([h[2] for h in held], pa.string()).take(run)
    for i, c in enumerate(("size", "x", "y", "operation", "reason")):
        each[c] = pa.array([h[5][i] for h in held], kinds[c]).take(run)
    return pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keys], *[each[c] for c in kinds]], [*keys, *kinds])


def to_unicode(cmap: bytes, code_bytes: int, simple: bool = False) -> tuple[dict[int, str] | None, str | None]:
    """A ToUnicode map by code, or a reason. A ``simple`` font of one byte may declare spaces of two.

    Invalid: sections of wrong counts, codes outside of the spaces, where any are declared, mapped twice or to nothing. Unsupported:
    sources of another width, targets as arrays. ``cmaps.checked`` tells the same of many maps at once.
    """
    out: dict[int, str] = {}
    spaces: list[tuple[int, int]] = []
    wide: set[int] = set()

    def sections(name: bytes) -> Iterator[list[Any]]:
        for m in re.finditer(rb"(\d+)\s+begin" + name + rb"\b(.*?)\bend" + name + rb"\b", cmap, re.DOTALL):
            found, each = list(tokens(m[2])), 2 if name != b"bfrange" else 3
            if len(found) != each * int(m[1]):
                raise ValueError(INVALID)
            yield [found[i : i + each] for i in range(0, len(found), each)]

    def put(code: int, text: bytes) -> None:
        if code in out:
            raise ValueError(INVALID)
        u = text.decode("utf-16-be")
        if not u:
            raise ValueError(INVALID)
        if spaces and not any(a <= code <= b for a, b in spaces):
            raise ValueError(INVALID)
        out[code] = u

    try:
        for section in sections(b"codespacerange"):
            for low, high in section:
                wide.add(len(low) if len(low) == len(high) else 0)
                spaces.append((int.from_bytes(low, "big"), int.from_bytes(high, "big")))
        if wide and wide != {code_bytes} and not (simple and code_bytes == 1 and wide == {2}):
            raise ValueError(UNSUPPORTED)
        for section in sections(b"bfchar"):
            for code, text in section:
                if len(code) != code_bytes:
                    raise ValueError(UNSUPPORTED)
                put(int.from_bytes(code, "big"), text)
        for section in sections(b"bfrange"):
            for low, high, target in section:
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                if isinstance(target, list) or not len(low) == len(high) == code_bytes:
                    raise ValueError(UNSUPPORTED)
                if b < a:
                    raise ValueError(INVALID)
                for k in range(b - a + 1):
                    put(a + k, target[:-2] + (int.from_bytes(target[-2:], "big") + k).to_bytes(2, "big"))
    except (ValueError, OverflowError, TypeError) as e:
        return None, UNSUPPORTED if str(e) == UNSUPPORTED else INVALID
    return out, None


def encoding(base: dict[int, str], differences: list[Any]) -> dict[int, str]:
    """Glyph names by code: a base table overlaid with runs, each an integer and the names from there on."""
    out, at = dict(base), 0
    for x in differences:
        if isinstance(x, str):
            out[at] = x
            at += 1
        else:
            at = int(x)
    return out


def horizontal_rules(strokes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Single segments that run level: x0, x1, y and width, the ends in order."""
    level = (F.col("segments") == 1) & (F.abs(F.col("y0") - F.col("y1")) <= tolerance)
    return strokes.where(level).withColumns({"left": F.least("x0", "x1"), "right": F.greatest("x0", "x1"), "y": (F.col("y0") + F.col("y1")) / 2}).drop("x0", "x1", "y0", "y1")


def without_synthetic_twins(chars: DataFrame, reach: float = 0.01) -> DataFrame:
    """Rendered characters without those of no glyph (gid -1) that stand on exactly one real twin of the same font, text, origin and size."""
    key = ["page", "font", "seqno", "u", "origin_x", "origin_y", "size"]
    made = chars.where("gid = -1")
    real = chars.where("gid <> -1").select(*key, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = [F.abs(F.col(c) - F.col(f"r_{c}")) <= reach for c in ("x0", "y0", "x1", "y1")]
    twins = made.join(real, key).where(near[0] & near[1] & near[2] & near[3]).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")
    return chars.join(twins, "id", "left_anti")
