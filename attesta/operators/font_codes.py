"""Which glyph and which text a font's codes have, by its encoding, its program and its ToUnicode map.

``fonts``: source, font, subtype, encoding, base_encoding, differences (numbers and names as text, in order), descendants,
descendant_subtype, cid_to_gid, descriptor (whether there is one), file (FontFile2 or FontFile3), file_subtype, program, to_unicode.
Each subtype has rules of its own; the first one that a font breaks is its reason. Fonts of a reason have no codes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import font_programs, pdf_streams

# Reasons, and the order in which the Unicode subtables of an sfnt are asked: (platform, encoding).
TYPE, TYPE1C, ENCODING = "embedded_font_type_unsupported", "embedded_type1c_font_required", "font_encoding_unsupported"
IDENTITY, CID, CID_MAP, CID_GLYPHS = "type0_identity_h_required", "embedded_cidfonttype2_required", "cid_to_gid_stream_not_qualified", "cid_to_gid_map_required"
TYPE0_MAP, TRUETYPE, TRUETYPE_MAP = "type0_to_unicode_required", "embedded_truetype_font_required", "truetype_to_unicode_required"
AMBIGUOUS, INCOMPLETE = "truetype_code_to_gid_ambiguous", "truetype_code_to_gid_required"
UNICODE_TABLES = [(3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0)]
FONT = ["source", "font"]


#: Small fonts (by bytes of program and map) that a worker keeps the codes of, as they may be embedded again; rows of codes that leave a task at once.
KEPT, SMALL, ROWS = 256, 16_384, 50_000
CODES = "code int, name string, gid int, u string, method string"
_BASES, _NAMES = font_programs.base_encodings(), font_programs.glyph_names()
_NUMBER, _SPELT = re.compile(r"^-?[0-9]+$"), re.compile(r"^uni((?:[0-9A-F]{4})+)$|^u([0-9A-F]{4,6})$")


def names_table(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """name, u: the text of usual glyph names, a constant table, and others given."""
    return F.broadcast(spark.createDataFrame(sorted((font_programs.glyph_names() | (extra or {})).items()), "name string, u string"))


def named_text(glyphs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``u``: what a glyph's name says, before its first full stop, from the table or as uniXXXX or uXXXXXX; else null."""
    stem = F.substring_index("name", ".", 1)
    digits = F.coalesce(F.nullif(F.regexp_extract(stem, "^uni((?:[0-9A-F]{4})+)$", 1), F.lit("")), F.nullif(F.regexp_extract(stem, "^u([0-9A-F]{4,6})$", 1), F.lit("")))
    units = F.when(stem.startswith("uni"), F.regexp_extract_all(digits, F.lit("([0-9A-F]{4})"), F.lit(1))).otherwise(F.array(digits))
    # Code points, four bytes each.
    spelt = F.when(digits.isNotNull(), F.decode(F.unhex(F.array_join(F.transform(units, lambda d: F.lpad(d, 8, "0")), "")), "UTF-32"))
    table = names_table(glyphs.sparkSession, extra).withColumnsRenamed({"name": "__name", "u": "__u"})
    return glyphs.join(table, stem == F.col("__name"), "left").withColumn("u", F.coalesce("__u", spelt)).drop("__name", "__u")


def encodings(fonts: DataFrame) -> DataFrame:
    """source, font, code, name of each font's base encoding overlaid with its differences, and ``bad`` where a name has no code from 0 to 255."""
    spark = fonts.sparkSession
    rows = [(base, code, name) for base, table in font_programs.base_encodings().items() for code, name in table.items()]
    bases = F.broadcast(spark.createDataFrame(rows, "base string, code int, name string"))
    base = fonts.select(*FONT, "base_encoding").join(bases, F.col("base_encoding") == F.col("base")).select(*FONT, "code", F.lit(-1).alias("k"), "name")
    # A number sets the code of the next name; each name after it takes the next one.
    of = F.posexplode("differences").alias("k", "x")
    each = fonts.select(*FONT, "differences", of)
    since = F.aggregate(F.slice("differences", F.lit(1), F.col("k") + 1), F.struct(F.lit(None).cast("int").alias("code"), F.lit(0).alias("n")), lambda s, x: F.when(x.rlike("^-?[0-9]+$"), F.struct(x.try_cast("int").alias("code"), F.lit(0).alias("n"))).otherwise(F.struct(s["code"].alias("code"), (s["n"] + 1).alias("n"))))
    over = each.where("NOT x RLIKE '^-?[0-9]+$'").select(*FONT, (since["code"] + since["n"] - 1).alias("code"), "k", F.regexp_replace("x", "^/", "").alias("name"))
    last = base.unionAll(over).groupBy(*FONT, "code").agg(F.max_by("name", "k").alias("name"))
    return last.withColumn("bad", F.coalesce(~F.col("code").between(0, 255), F.lit(True)))


def _overlaid(base: str | None, differences: list[str | None]) -> tuple[dict[int, str], bool]:
    """The names of a font's codes, and whether a name has no code from 0 to 255 (see ``encodings``)."""
    out, wrong, at = dict(_BASES.get(base, {})), False, None
    for x in differences:
        if x is not None and _NUMBER.search(x):
            at = int(x) if -(2**31) <= int(x) < 2**31 else None
            continue
        if x is not None:
            if at is not None and 0 <= at <= 255:
                out[at] = x.removeprefix("/")
            else:
                wrong = True
        at = None if at is None else at + 1
    return out, wrong


def _text(name: str, names: dict[str, str]) -> str | None:
    """What a glyph's name says (see ``named_text``)."""
    stem = name.split(".")[0]
    if stem in names:
        return names[stem]
    found = _SPELT.search(stem)
    points = [int(d, 16) for d in (re.findall("....", found[1]) if found[1] else [found[2]])] if found else []
    return "".join(map(chr, points)) if points and all(p < 0x110000 and not 0xD800 <= p < 0xE000 for p in points) else None


def _true_type(texts: dict[int, str], rows: list[tuple]) -> tuple[dict[int, int | None], bool]:
    """The glyph of each code, and whether subtables differ: the one that all agree on, else that of its text in the first Unicode subtable that is there."""
    rank = {key: k for k, key in enumerate(UNICODE_TABLES)}
    direct, ranked = {}, {}
    for platform, encoding, code, gid in rows:
        direct.setdefault(code, set()).add(gid)
        if (platform, encoding) in rank:
            by_text = ranked.setdefault(rank[platform, encoding], {})
            by_text[code] = min(gid, by_text.get(code, gid))
    unicode_gids = ranked[min(ranked)] if ranked else {}
    out = {c: min(direct[c]) if c in direct else unicode_gids.get(ord(u)) if len(u) == 1 else None for c, u in texts.items()}
    return out, any(len(direct.get(c, ())) > 1 for c in texts)


def _resolved(extra: tuple, subtype: str | None, encoding: str | None, base: str | None, differences: tuple, descendants: int | None, descendant: str | None, cid_to_gid: str | None, descriptor: bool | None, file: str | None, file_subtype: str | None, program: bytes | None, to_unicode: bytes | None) -> tuple[str | None, list[tuple]]:
    """A font's reason, or its codes as (code, name, gid, u, method)."""
    n_glyphs, program_reason, rows, names = None, font_programs.INVALID, [], []
    if file in ("FontFile2", "FontFile3") and program is not None:
        try:
            if file == "FontFile2":
                n_glyphs, rows = font_programs.sfnt(program)
            else:
                names = font_programs.cff(program)
                n_glyphs = len(names)
            program_reason = None
        except font_programs._FAULTS:
            n_glyphs, rows, names = None, [], []
    texts, map_reason = ({}, None) if to_unicode is None else pdf_streams.to_unicode(to_unicode, 2 if subtype == "/Type0" else 1, simple=subtype != "/Type0")
    texts = texts or {}
    first = lambda *rules: next((reason for broken, reason in rules if broken), None)
    if subtype == "/Type1":
        overlaid, wrong = _overlaid(base, differences)
        reason = first((not descriptor, TYPE1C), (file != "FontFile3", TYPE1C), (file_subtype != "/Type1C", TYPE1C), (program_reason, program_reason), (base not in _BASES, ENCODING), (wrong, ENCODING), (map_reason, map_reason))
        gids = {n: g for g, n in enumerate(names) if n}
        texts_of = _NAMES | dict(extra)
        return reason, [(c, n, gids[n], _text(n, texts_of), "agl") for c, n in overlaid.items() if n in gids] if not reason else []
    if subtype == "/Type0":
        beyond = n_glyphs is not None and any(not 0 < c < n_glyphs for c in texts)
        reason = first(
            (encoding != "/Identity-H", IDENTITY), (descendants != 1, CID), (descendant != "/CIDFontType2", CID), (not descriptor, CID), (file != "FontFile2", CID), (program_reason, program_reason), (map_reason, map_reason),
            (not texts, TYPE0_MAP), (cid_to_gid is not None and cid_to_gid != "/Identity", CID_MAP), (beyond, CID_GLYPHS),
        )
        return reason, [(c, f"gid{c}", c, u, "to_unicode") for c, u in texts.items()] if not reason else []
    if subtype == "/TrueType":
        gids, ambiguous = _true_type(texts, rows)
        reason = first((not descriptor, TRUETYPE), (file != "FontFile2", TRUETYPE), (map_reason, map_reason), (not texts, TRUETYPE_MAP), (program_reason, program_reason), (ambiguous, AMBIGUOUS), (None in gids.values(), INCOMPLETE))
        return reason, [(c, f"gid{gids[c]}", gids[c], u, "to_unicode") for c, u in texts.items()] if not reason else []
    return TYPE, []


@lru_cache(maxsize=KEPT)
def _kept(*font) -> tuple[str | None, list[tuple]]:
    return _resolved(*font)


_OF = ["subtype", "encoding", "base_encoding", "differences", "descendants", "descendant_subtype", "cid_to_gid", "descriptor", "file", "file_subtype", "program", "to_unicode"]


def loaded(fonts: DataFrame, extra_names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """source, font, code_bytes, trace_font and reason of each font, and source, font, code, name, gid, u, method of the codes of sound ones.

    All that a font's codes depend on is in its own row: each font is read by itself, and nothing is shuffled, broadcast or kept.
    """
    extra = tuple(sorted((extra_names or {}).items()))
    kind = {c: fonts.schema[c].dataType.simpleString() for c in FONT}
    keys = f"source {kind['source']}, font {kind['font']}"
    own = fonts.select(*FONT, *_OF)

    def each(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[str | None, list[tuple]]]]:
        columns = [batch[c].to_pylist() for c in _OF]
        for k, values in enumerate(zip(*columns, strict=True)):
            subtype, encoding, base, differences, *rest = values
            small = sum(len(x) for x in rest[-2:] if x is not None) <= SMALL
            yield k, (_kept if small else _resolved)(extra, subtype, encoding, base, tuple(differences or ()), *rest)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in (*FONT, "subtype", "base_font")], pa.array([r for _, (r, _) in each(batch)], pa.string())], [*FONT, "subtype", "base_font", "reason"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (_, codes) in each(batch):
                at += [k] * len(codes)
                rows += codes
                if len(rows) >= ROWS:
                    yield _coded(batch, at, rows)
                    at, rows = [], []
            yield _coded(batch, at, rows)

    trace = F.substring(F.regexp_replace("base_font", r"^/?(?:[^+]*\+)?", ""), 1, 24)
    told = fonts.select(*FONT, "base_font", *_OF).mapInArrow(tell, f"{keys}, subtype string, base_font string, reason string")
    out = told.select(*FONT, F.when(F.col("subtype") == "/Type0", 2).otherwise(1).alias("code_bytes"), trace.alias("trace_font"), "reason")
    return out, own.mapInArrow(spell, f"{keys}, {CODES}")


def _coded(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    taken, names = pa.array(at, pa.int32()), [c.split()[0] for c in CODES.split(", ")]
    columns = [pa.array(c, pa.int32() if n in ("code", "gid") else pa.string()) for c, n in zip(list(zip(*rows, strict=True)) or [()] * len(names), names, strict=True)]
    return pa.RecordBatch.from_arrays([*[batch[c].take(taken) for c in FONT], *columns], [*FONT, *names])
