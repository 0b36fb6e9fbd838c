"""Embedded font programs as rows: what an sfnt's or a CFF's tables say of codes, glyphs and names.

The readers decode one program's binary layout and judge nothing: which glyph a code has follows in ``operators.font_codes``.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf_streams import to_unicode

INVALID = "embedded_font_program_invalid"
# Names of the characters of the Latin encodings that are neither letters nor follow from a rule.
_DIGITS = "zero one two three four five six seven eight nine".split()
_ASCII = dict(zip(" !\"#$%&()*+,-./:;<=>?@[\\]^_{|}~", "space exclam quotedbl numbersign dollar percent ampersand parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore braceleft bar braceright asciitilde".split(), strict=True))
_OTHERS = dict(zip("’‘¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß", "quoteright quoteleft exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls".split(), strict=True))
_MORE = dict(zip("€™©®¬±µ×÷°¦¹²³¼½¾ÐðÞþ≠∞≤≥∂∑∏π∫Ω√≈∆◊", "Euro trademark copyright registered logicalnot plusminus mu multiply divide degree brokenbar onesuperior twosuperior threesuperior onequarter onehalf threequarters Eth eth Thorn thorn notequal infinity lessequal greaterequal partialdiff summation product pi integral Omega radical approxequal Delta lozenge".split(), strict=True))
# The accents in glyph names.
_ACCENTS = dict(zip("̧̀́̂̃̈̊̌", "grave acute circumflex tilde dieresis ring cedilla caron".split(), strict=True))
#: Codes of the standard encoding, in the order of its glyphs' numbers from 1 on.
_STANDARD_CODES = [*range(32, 127), *range(161, 176), *range(177, 181), *range(182, 190), 191, *range(193, 201), 202, 203, *range(205, 209), 225, 227, *range(232, 236), 241, 245, *range(248, 252)]


def glyph_name(char: str) -> str | None:
    """The usual name of a character's glyph, if this table has it."""
    if char.isascii() and char.isalpha():
        return char
    if char.isascii() and char.isdigit():
        return _DIGITS[int(char)]
    found = _ASCII.get(char) or _OTHERS.get(char) or _MORE.get(char)
    if found:
        return found
    parts = unicodedata.normalize("NFD", char)
    if len(parts) == 2 and parts[0].isascii() and parts[1] in _ACCENTS:
        return parts[0] + _ACCENTS[parts[1]]
    words = unicodedata.name(char, "").split()
    if len(words) == 4 and words[0] == "GREEK" and words[2] == "LETTER":
        return words[3].lower() if words[1] == "SMALL" else words[3].capitalize()
    return None


def standard_names() -> list[str]:
    """The names of the numbers 1 to 149: the standard encoding's glyphs, whose ASCII quotes are curly."""
    ascii_ = [glyph_name({"'": "’", "`": "‘"}.get(chr(c), chr(c))) for c in range(32, 127)]
    return ascii_ + [n for n in _OTHERS.values() if n not in ("quoteright", "quoteleft")]


def base_encodings() -> dict[str, dict[int, str]]:
    """The names of codes by the encodings that are read; other codes have none."""
    codec = lambda name, **own: {c: n for c in range(32, 256) if (n := own.get(f"c{c}") or glyph_name(bytes([c]).decode(name, "replace")))}
    unused = {f"c{c}": "bullet" for c in (127, 129, 141, 143, 144, 157)}
    return {
        "/StandardEncoding": dict(zip(_STANDARD_CODES, standard_names(), strict=True)),
        "/WinAnsiEncoding": codec("cp1252", c160="space", c173="hyphen", **unused),
        "/MacRomanEncoding": codec("mac_roman", c202="space", c219="currency"),
    }


def glyph_names() -> dict[str, str]:
    """Characters by the names of their glyphs."""
    chars = [chr(c) for c in [*range(32, 256), *range(0x152, 0x193), *range(0x391, 0x3CA)]] + [*_OTHERS, *_MORE]
    return {n: c for c in reversed(chars) if (n := glyph_name(c))}


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from(">H", data, at)[0]


def _subtable(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Codes and glyphs of one subtable of a cmap, by its format; other formats give none."""
    kind = _u16(data, at)
    if kind == 0:
        yield from enumerate(data[at + 6 : at + 262])
    elif kind == 4:
        n = _u16(data, at + 6) // 2
        ends, starts, deltas, offsets = (at + 14 + 2 * n * k + (2 if k else 0) for k in range(4))
        for i in range(n):
            low, high, offset = _u16(data, starts + 2 * i), _u16(data, ends + 2 * i), _u16(data, offsets + 2 * i)
            for code in range(low, min(high, 0xFFFE) + 1):
                gid = code if not offset else _u16(data, offsets + 2 * i + offset + 2 * (code - low))
                yield code, (gid + _u16(data, deltas + 2 * i)) & 0xFFFF if gid or not offset else 0
    elif kind == 6:
        first, n = struct.unpack_from(">HH", data, at + 6)
        yield from ((first + i, _u16(data, at + 10 + 2 * i)) for i in range(n))
    elif kind == 12:
        for i in range(struct.unpack_from(">I", data, at + 12)[0]):
            low, high, gid = struct.unpack_from(">III", data, at + 16 + 12 * i)
            if high - low > 0x10FFFF:
                raise ValueError(INVALID)
            yield from ((code, gid + code - low) for code in range(low, high + 1))


def sfnt(data: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The number of glyphs, and (platform, encoding, code, glyph) of all subtables."""
    tables = {data[at : at + 4]: struct.unpack_from(">II", data, at + 8)[0] for at in range(12, 12 + 16 * _u16(data, 4), 16)}
    glyphs, start = _u16(data, tables[b"maxp"] + 4), tables.get(b"cmap")
    rows = []
    for k in range(_u16(data, start + 2) if start is not None else 0):
        platform, encoding, offset = struct.unpack_from(">HHI", data, start + 4 + 8 * k)
        rows += [(platform, encoding, code, gid) for code, gid in _subtable(data, start + offset) if gid]
    return glyphs, rows


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The items of an INDEX, and the place behind it."""
    n = _u16(data, at)
    if not n:
        return [], at + 2
    size = data[at + 2]
    places = [int.from_bytes(data[at + 3 + size * i : at + 3 + size * (i + 1)], "big") for i in range(n + 1)]
    base = at + 2 + size * (n + 1)
    if places[0] != 1 or sorted(places) != places or base + places[-1] > len(data):
        raise ValueError(INVALID)
    return [data[base + a : base + b] for a, b in zip(places, places[1:])], base + places[-1]


def _dict(data: bytes) -> dict[int, list[int]]:
    """Operands by operator (12 n: 1200 + n); real numbers are left out."""
    out, operands, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12:
                b, at = 1200 + data[at], at + 1
            out[b], operands = operands, []
        elif b == 28:
            operands.append(struct.unpack_from(">h", data, at)[0])
            at += 2
        elif b == 29:
            operands.append(struct.unpack_from(">i", data, at)[0])
            at += 4
        elif b == 30:
            while data[at] & 15 != 15 and data[at] >> 4 != 15:
                at += 1
            at += 1
        elif b <= 246:
            operands.append(b - 139)
        elif b <= 254:
            operands.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


def cff(data: bytes, standard: list[str] | None = None) -> list[str | None]:
    """The names of the glyphs in order; None where a name is one of the standard strings and ``standard`` (from number 1 on) hasn't it."""
    standard = standard_names() if standard is None else standard
    names, at = _index(data, data[2])
    tops, at = _index(data, at)
    strings, _ = _index(data, at)
    top = _dict(tops[0])
    if len(names) != 1 or 17 not in top or 1230 in top:
        raise ValueError(INVALID)
    many = len(_index(data, top[17][0])[0])
    start = top.get(15, [0])[0]
    if start in (1, 2):
        raise ValueError(INVALID)
    numbers = list(range(1, min(many, 229)))
    if start:
        kind, at, numbers = data[start], start + 1, []
        while len(numbers) < many - 1:
            first = _u16(data, at)
            left = 0 if kind == 0 else data[at + 2] if kind == 1 else _u16(data, at + 2)
            numbers += range(first, first + left + 1)
            at += 2 + min(kind, 2)
    told = lambda n: strings[n - 391].decode("latin-1") if n >= 391 else standard[n - 1] if n <= len(standard) else None
    return [".notdef", *map(told, numbers[: many - 1])]


_FAULTS = (ValueError, IndexError, KeyError, struct.error)
PROGRAM = "source {key}, font long, what string, platform int, encoding int, code int, gid int, name string, reason string"


def _rows(fonts: DataFrame, read: Callable[[dict], list[tuple]]) -> DataFrame:
    """Rows of each font: what, platform, encoding, code, gid, name and reason."""
    kinds = [pa.string()] + [pa.int32()] * 4 + [pa.string()] * 2
    names = ["what", "platform", "encoding", "code", "gid", "name", "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, font in enumerate(batch.to_pylist()):
                found = read(font)
                at = pa.array([k] * len(found), pa.int32())
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch["source"].take(at), batch["font"].take(at), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["source", "font", *names])

    return fonts.mapInArrow(run, PROGRAM.format(key=fonts.schema["source"].dataType.simpleString()))


def programs(fonts: DataFrame) -> DataFrame:
    """What each embedded program says: a row ``program`` (gid: the number of glyphs, or a reason), rows ``cmap`` (a code's glyph in a
    subtable) of sfnt programs, and rows ``glyph`` (a glyph's name) of CFF ones.

    ``fonts``: source, font, file (FontFile2 or FontFile3), program (bytes).
    """

    def read(font: dict) -> list[tuple]:
        try:
            if font["file"] == "FontFile2":
                many, rows = sfnt(font["program"])
                return [("program", None, None, None, many, None, None), *[("cmap", p, e, c, g, None, None) for p, e, c, g in rows]]
            names = cff(font["program"])
            return [("program", None, None, None, len(names), None, None), *[("glyph", None, None, None, g, n, None) for g, n in enumerate(names) if n]]
        except _FAULTS:
            return [("program", None, None, None, None, None, INVALID)]

    return _rows(fonts.where("file IN ('FontFile2', 'FontFile3') AND program IS NOT NULL").select("source", F.col("font").cast("long"), "file", "program"), read)


def maps(fonts: DataFrame) -> DataFrame:
    """The ToUnicode map of each font that has one: rows ``map`` (code, name: its text), and a row ``maps`` (gid: the number of codes, or a reason).

    ``fonts``: source, font, subtype, to_unicode (bytes). Codes of a Type0 font have two bytes; other fonts may declare spaces of two.
    """

    def read(font: dict) -> list[tuple]:
        two = font["subtype"] == "/Type0"
        told, reason = to_unicode(font["to_unicode"], 2 if two else 1, simple=not two)
        told = told or {}
        return [("maps", None, None, None, len(told), None, reason), *[("map", None, None, c, None, u, None) for c, u in told.items()]]

    return _rows(fonts.where("to_unicode IS NOT NULL").select("source", F.col("font").cast("long"), "subtype", "to_unicode"), read)
