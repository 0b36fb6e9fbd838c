"""Structure of ToUnicode maps, checked with column expressions: one row per map, a code for one that can't be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blocks that a map may have, and the operands of their entries.
BLOCKS = {"bfchar": 2, "bfrange": 3, "codespacerange": 2}
_HEX = "(?<!<)<([^<>]*)>(?!>)"
#: UTF-16BE in hex digits: units that are no surrogates, and pairs of these.
_UTF16 = "^(?i)(?:(?!d[89a-f])[0-9a-f]{4}|d[89ab][0-9a-f]{2}d[c-f][0-9a-f]{2})+$"
UNSUPPORTED, INVALID = "to_unicode_cmap_unsupported", "to_unicode_cmap_invalid"


def _code(*faults: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in faults])


def block_entries(text: Column, name: str) -> tuple[Column, Column]:
    """The entries of a kind of block, each an array of hex digits, and a code where a block is open, holds arrays or has a wrong number of operands."""
    block = rf"(?s)(\d+)\s+begin{name}\b(.*?)\bend{name}\b"
    counts, bodies = (F.regexp_extract_all(text, F.lit(block), F.lit(k)) for k in (1, 2))
    times = lambda word: F.size(F.split(text, word)) - 1
    tokens = lambda body: F.regexp_extract_all(body, F.lit(_HEX), F.lit(1))
    arity = BLOCKS[name]
    right = F.transform(F.arrays_zip(counts.alias("n"), bodies.alias("body")), lambda b: (F.size(tokens(b["body"])) == b["n"].try_cast("int") * arity) & F.regexp_replace(b["body"], _HEX, "").rlike(r"^\s*$"))
    code = _code(
        ((F.size(bodies) != times(f"begin{name}")) | (F.size(bodies) != times(f"end{name}")), INVALID),
        (F.exists(bodies, lambda b: b.rlike(r"[\[\]]")), UNSUPPORTED),
        (F.exists(right, lambda ok: ~F.coalesce(ok, F.lit(False))), INVALID),
    )
    flat = F.flatten(F.transform(bodies, tokens))
    groups = F.when(F.size(flat) >= arity, F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / arity).cast("int") - 1), lambda i: F.slice(flat, i * arity + 1, arity)))
    return F.coalesce(groups, F.array().cast("array<array<string>>")), code


def _number(digits: Column) -> Column:
    return F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).cast("long"))


def _reaches(target: Column, span: Column) -> Column:
    """Whether all targets of a range are UTF-16BE: the first, and each that follows by counting up its last four bytes, without overflow."""
    tail = F.right(target, F.lit(8))
    head = F.substring(target, F.lit(1), F.length(target) - F.length(tail))
    most = F.pow(F.lit(16.0), F.length(tail))
    at = lambda k: F.concat(head, F.lpad(F.hex(_number(tail) + k), F.length(tail), "0"))
    return (target != "") & (_number(tail) + span < most) & F.forall(F.sequence(F.lit(0).cast("long"), span), lambda k: at(k).rlike(_UTF16))


def checked(maps: DataFrame, key: str, text: str, code_bytes: int, simple: bool = False) -> DataFrame:
    """key, code, wide_codespace, n_codes for each map (text: its bytes as Latin-1).

    ``code`` is null for a sound map: known blocks only, entries of their arity, sources of ``code_bytes``, ranges that rise,
    targets in UTF-16BE, no code mapped twice, and none outside of the declared spaces, where there are any. A ``simple`` font of
    one byte may declare spaces of two: wide_codespace. Of several faults those of form come first, then unsupported ones. A null map is invalid.
    """
    rows = maps.select(key, F.col(text).alias("__t"))
    t = F.col("__t")
    entries = {name: block_entries(t, name) for name in BLOCKS}
    known = F.array(*[F.lit(name) for name in BLOCKS])
    named = F.regexp_extract_all(t, F.lit(r"\bbegin([a-z]+(?:char|range))\b"), F.lit(1))
    form = F.coalesce(_code((t.isNull(), INVALID), (F.contains(t, F.lit("usecmap")) | (F.size(F.array_except(named, known)) > 0), UNSUPPORTED)), *[entries[name][1] for name in BLOCKS])
    rows = rows.select(key, form.alias("__form"), *[entries[name][0].alias(name) for name in BLOCKS])

    digits = 2 * code_bytes
    hexed = lambda x: x.rlike("^[0-9A-Fa-f]*$")
    widths = F.array_distinct(F.flatten(F.transform("codespacerange", lambda e: F.transform(e, F.length))))
    differs = (F.size(widths) > 0) & ~((F.size(widths) == 1) & (F.try_element_at(widths, F.lit(1)) == digits))
    allowed = differs & F.lit(simple and code_bytes == 1) & (F.size(widths) == 1) & (F.try_element_at(widths, F.lit(1)) == 4)
    sources = lambda e, n: F.slice(e, 1, n)
    odd = lambda name, n: F.exists(name, lambda e: F.exists(sources(e, n), lambda x: (F.length(x) != digits) | ~hexed(x)))
    falls = lambda name: F.exists(name, lambda e: _number(e[0]) > _number(e[1]))
    own = F.concat(F.transform("bfchar", lambda e: F.struct(_number(e[0]).alias("low"), _number(e[0]).alias("high"))), F.transform("bfrange", lambda e: F.struct(_number(e[0]).alias("low"), _number(e[1]).alias("high"))))
    rows = rows.withColumns({"__codes": F.array_sort(own), "__spaces": F.array_sort(F.transform("codespacerange", lambda e: F.struct(_number(e[0]).alias("low"), _number(e[1]).alias("high")))), "__wide": allowed})
    codes, spaces = F.col("__codes"), F.col("__spaces")
    twice = F.exists(F.arrays_zip(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))).alias("a"), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))).alias("b")), lambda p: p["b"]["low"] <= p["a"]["high"])
    # A range is inside if spaces, by their starts, carry it on from its first code to beyond its last.
    beyond = lambda c: F.aggregate(spaces, c["low"], lambda at, s: F.when(s["low"] <= at, F.greatest(at, s["high"] + 1)).otherwise(at))
    outside = (F.size(spaces) > 0) & F.exists(codes, lambda c: beyond(c) <= c["high"])
    code = F.coalesce(
        F.col("__form"),
        _code((differs & ~F.col("__wide"), UNSUPPORTED), (odd("bfchar", 1) | odd("bfrange", 2), UNSUPPORTED), (falls("bfrange") | falls("codespacerange"), INVALID)),
        _code((F.exists("bfchar", lambda e: ~e[1].rlike(_UTF16)), INVALID), (F.exists("bfrange", lambda e: ~_reaches(e[2], _number(e[1]) - _number(e[0]))), INVALID)),
        _code((twice, INVALID), (outside, INVALID)),
    )
    n = F.aggregate(codes, F.lit(0).cast("long"), lambda total, c: total + c["high"] - c["low"] + 1)
    return rows.withColumn("code", code).select(key, "code", (F.col("code").isNull() & F.col("__wide")).alias("wide_codespace"), F.when(F.col("code").isNull(), n).alias("n_codes"))
