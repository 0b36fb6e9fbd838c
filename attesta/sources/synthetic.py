"""Documents made from the rows of a table, whose contents follow from a number by rules that SQL can state as well.

A document has a page, a chain of forms that it draws, an image, and three fonts with embedded programs. The rules cover what readers
have to tell apart: forms with and without resources of their own, cycles, unknown names, codes without glyphs, and fonts that break
each of the conditions that are put to them. All rows come from Spark's own functions; font programs are laid out byte by byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE, FONT1, FONT2, FONT3 = 100, 201, 202, 203
HEIGHT = 800.0
#: The first text that a font gives: the Greek small letters from alpha on.
ALPHA = 0x3B1


def forms_of(n: Column) -> Column:
    """How many forms document n has: 1 to 4."""
    return (n % 4 + 1).cast("int")


def streams(rows: DataFrame, text: Column) -> DataFrame:
    """source, stream, kind, own, content, bbox, matrix, height, from rows with ``n``, the number that the rules go by.

    The page (0) draws form 1 at twice its size, then the image, then shows the text. Form k saves the state, draws the image, draws form k + 1,
    and shows two digits of n in two bytes a code where n + k is divisible by 3. The last form draws form 1 where n % 7 is 3. Even forms
    have resources of their own. Where n % 13 is 5 the page's text is in the font that lacks a code.
    """
    n = F.col("n")
    head = rows.select("source", "n", text.alias("text"))
    plain = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))
    page = head.select(
        "source", F.lit(0).cast("long").alias("stream"), F.lit("page").alias("kind"), F.lit(True).alias("own"),
        F.concat(F.lit("q 2 0 0 2 10 20 cm /X1 Do Q /Im Do BT "), F.when(n % 13 == 5, "/F3").otherwise("/F1"), F.lit(" 10 Tf 1 0 0 1 5 6 Tm ("), F.col("text"), F.lit(") Tj 3 Tr (hidden) Tj ET")).cast("binary").alias("content"),
        F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<double>").alias("matrix"), F.lit(HEIGHT).alias("height"),
    )
    k = F.col("k")
    digits = F.upper(F.concat(F.lpad(F.hex((n % 10 + 1).cast("long")), 4, "0"), F.lpad(F.hex((k % 10 + 1).cast("long")), 4, "0")))
    last = k == forms_of(n)
    draw = F.when(~last, F.concat(F.lit("/X"), (k + 1).cast("string"), F.lit(" Do "))).when(n % 7 == 3, "/X1 Do ").otherwise("")
    shown = F.when((n + k) % 3 == 0, F.concat(F.lit("BT /F2 9 Tf [<"), digits, F.lit("> -20 <"), digits, F.lit(">] TJ ET"))).otherwise("")
    form = head.select("source", "n", F.explode(F.sequence(F.lit(1), forms_of(n))).alias("k")).select(
        "source", k.cast("long").alias("stream"), F.lit("form").alias("kind"), (k % 2 == 0).alias("own"), F.concat(F.lit("q 1 0 0 1 "), k.cast("string"), F.lit(" 0 cm /Im Do Q "), draw, shown).cast("binary").alias("content"),
        F.array(F.lit(0.0), F.lit(0.0), (k * 10).cast("double"), F.lit(5.0)).alias("bbox"), plain.alias("matrix"), F.lit(None).cast("double").alias("height"),
    )
    image = head.select("source", F.lit(IMAGE).cast("long").alias("stream"), F.lit("image").alias("kind"), F.lit(False).alias("own"), *[F.lit(None).cast(t).alias(c) for c, t in (("content", "binary"), ("bbox", "array<double>"), ("matrix", "array<double>"), ("height", "double"))])
    return page.unionAll(form).unionAll(image)


def entries(rows: DataFrame) -> DataFrame:
    """source, owner, kind, name, target: the page's names and those of even forms; where n % 11 is 6 these forms lack the last form's name."""
    n = F.col("n")
    owners = rows.select("source", "n", F.explode(F.filter(F.sequence(F.lit(0), forms_of(n)), lambda k: k % 2 == 0)).alias("o"))
    own = F.transform(F.filter(F.sequence(F.lit(1), forms_of(n)), lambda k: ~((n % 11 == 6) & (F.col("o") > 0) & (k == forms_of(n)))), lambda k: F.struct(F.lit("XObject").alias("kind"), F.concat(F.lit("/X"), k.cast("string")).alias("name"), k.alias("target")))
    given = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(target).alias("target")) for kind, name, target in (("XObject", "/Im", IMAGE), ("Font", "/F1", FONT1), ("Font", "/F2", FONT2), ("Font", "/F3", FONT3))])
    return owners.select("source", F.col("o").cast("long").alias("owner"), F.explode(F.concat(own, given)).alias("e")).select("source", "owner", "e.kind", "e.name", F.col("e.target").cast("long").alias("target"))


def sfnt(glyphs: int, cmaps: list[tuple[int, int, int, dict[int, int]]]) -> bytes:
    """A program with so many glyphs and the subtables given: (platform, encoding, format, glyphs by code)."""
    bodies = []
    for _, _, kind, table in cmaps:
        if kind == 0:
            body = struct.pack(">HHH", 0, 262, 0) + bytes(table.get(c, 0) for c in range(256))
        elif kind == 6:
            first, many = min(table), max(table) - min(table) + 1
            body = struct.pack(">HHHHH", 6, 10 + 2 * many, 0, first, many) + b"".join(struct.pack(">H", table.get(first + i, 0)) for i in range(many))
        elif kind == 12:
            body = struct.pack(">HHIII", 12, 0, 16 + 12 * len(table), 0, len(table)) + b"".join(struct.pack(">III", c, c, g) for c, g in sorted(table.items()))
        else:
            runs = [*sorted(table.items()), (0xFFFF, 0)]
            n = len(runs)
            parts = [[c for c, _ in runs], [0], [c for c, _ in runs], [(g - c) & 0xFFFF for c, g in runs[:-1]] + [1], [0] * n]
            body = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(f">{len(p)}H", *p) for p in parts)
        bodies.append(body)
    cmap, at = struct.pack(">HH", 0, len(cmaps)), 4 + 8 * len(cmaps)
    for (platform, encoding, _, _), body in zip(cmaps, bodies, strict=True):
        cmap += struct.pack(">HHI", platform, encoding, at)
        at += len(body)
    tables = {b"cmap": cmap + b"".join(bodies), b"maxp": struct.pack(">IH", 0x5000, glyphs)}
    out, at, data = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, body in tables.items():
        out += tag + struct.pack(">III", 0, at, len(body))
        data += body
        at += len(body)
    return out + data


def _index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    places = [1]
    for item in items:
        places.append(places[-1] + len(item))
    return struct.pack(">HB", len(items), 4) + b"".join(struct.pack(">I", p) for p in places) + b"".join(items)


def cff(numbers: list[int], strings: list[str], kind: int = 0) -> bytes:
    """A program whose glyphs, behind .notdef, have the names of these numbers; those from 391 on are in ``strings``."""
    head = bytes([1, 0, 4, 4]) + _index([b"Made"])
    number = lambda x: b"\x1d" + struct.pack(">i", x)
    top = lambda a, b: _index([number(a) + b"\x0f" + number(b) + b"\x11"])
    rest = _index([s.encode() for s in strings]) + _index([])
    start = len(head) + len(top(0, 0)) + len(rest)
    if kind == 0:
        charset = b"\0" + b"".join(struct.pack(">H", n) for n in numbers)
    else:
        charset = bytes([kind]) + b"".join(struct.pack(">HB" if kind == 1 else ">HH", n, 0) for n in numbers)
    return head + top(start, start + len(charset)) + rest + charset + _index([b"\x0e"] * (len(numbers) + 1))


def to_unicode(codes: dict[int, str], width: int) -> bytes:
    rows = " ".join(f"<{c:0{2 * width}x}> <{u.encode('utf-16-be').hex()}>" for c, u in codes.items())
    return f"1 begincodespacerange <{'00' * width}> <{'ff' * width}> endcodespacerange {len(codes)} beginbfchar {rows} endbfchar".encode()


FONTS = "source long, font long, n long, subtype string, base_font string, encoding string, base_encoding string, differences array<string>, descendants int, descendant_subtype string, cid_to_gid string, descriptor boolean, file string, file_subtype string, program binary, to_unicode binary"


def _font(source: int, font: int, n: int) -> tuple:
    """One font by the rules that ``fonts`` states: they go by the remainders of n by 2, 3, 5 and 6."""
    return source, font, n, *_made(font, n % 30)


@lru_cache(maxsize=90)
def _made(font: int, n: int) -> tuple:
    many, fault = n % 5 + 2, n % 6
    texts = [chr(ALPHA + i) for i in range(many)]
    if font == FONT1 and fault != 5:
        encoding = "/MacExpertEncoding" if fault == 1 else ("/StandardEncoding", "/WinAnsiEncoding", "/MacRomanEncoding")[n % 3]
        differences = ["/alpha"] if fault == 2 else ["1", "/alpha", "/uni03B2", "9", "/absent"]
        program = b"\1\0" if fault == 4 else cff([*range(1, 96), 391, 392], ["alpha", "uni03B2"], n % 3)
        return ("/Type1", "/ABCDEF+Made+One", None, encoding, differences, None, None, None, fault != 3, "FontFile3", "/Type1C", program, None)
    if font == FONT1:
        return ("/Type3", "/Other", None, None, [], None, None, None, False, None, None, None, None)
    if font == FONT2:
        codes = dict(enumerate(["0", *texts, "x", "y", "z", "v", "w", "q", "r", "s"][:11], 1))
        program = sfnt(12 if fault != 1 else 11, [(3, 1, 4, {ord(u): c for c, u in codes.items()})])
        return ("/Type0", "/Made-Two", "/Identity-V" if fault == 2 else "/Identity-H", None, [], 2 if fault == 3 else 1, "/CIDFontType2", "Stream" if fault == 4 else "/Identity" if n % 2 else None, True, "FontFile2", None, program, None if fault == 5 else to_unicode(codes, 2))
    by_code, by_text = {65 + i: i + 1 for i in range(many)}, {ALPHA + i: i + 1 for i in range(many)}
    tables = [(1, 0, 0, by_code), (3, 1, (4, 12)[n % 2], by_text)]
    if fault == 1:
        tables.append((3, 0, 6, {65: many}))
    if fault == 2:
        tables[0] = (1, 0, 0, {c: g for c, g in by_code.items() if c > 65})
    if fault == 3:
        tables = [(1, 0, 0, {65: 1}), (3, 1, 4, {ALPHA: 1})]
    program = b"\0" * 5 if fault == 4 else sfnt(many + 1, tables)
    return ("/TrueType", "/Made-Three", None, None, [], None, None, None, True, "FontFile2", None, program, None if fault == 5 else to_unicode({65 + i: u for i, u in enumerate(texts)}, 1))


def fonts(rows: DataFrame) -> DataFrame:
    """The three fonts of each document, with their programs; ``n`` says by its remainder by 6 which condition each of them breaks.

    The first is a Type1 font with the ASCII glyphs, alpha and beta (1: its encoding isn't read, 2: a name without a code, 3: no descriptor, 4: its
    program is cut, 5: another type); the second a Type0 font of eleven codes (1: a code without a glyph, 2: another encoding, 3: two descendants, 4: glyphs
    by a stream, 5: no texts); the third a TrueType font of n % 5 + 2 codes from 65 on (1: subtables differ, 2: the first code's glyph is found by its text,
    3: codes without glyphs, 4: its program is cut, 5: no texts).
    """

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FONTS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([_font(int(s), f, int(n)) for s, n in zip(frame["source"], frame["n"], strict=True) for f in (FONT1, FONT2, FONT3)], columns=names)

    return rows.select(F.col("source").cast("long"), F.col("n").cast("long")).mapInPandas(make, FONTS)
