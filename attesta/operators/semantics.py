"""What a region's source says, and whether its candidate says the same: order, signals, relations and verdict, each with its reasons.

Flags of glyphs are column expressions; a region's glyphs meet in one grouping, which is as large as the region. Relations of
a region's glyphs and of its LaTeX are read by row functions; all else stays in the plan.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import latex
from . import evidence, relations
from .relational import is_subsequence

# Pieces of large delimiters, reasons of the source in the order in which they are looked at, and rules that settle a doubt.
FRAGMENTS = ["bracketleftbt", "bracketlefttp", "bracketrightbt", "bracketrighttp"]
ALIGNMENT_AMBIGUOUS, NOT_TRACED, ORDER, GID = "structural_alignment_ambiguous", "structural_alignment_not_traced", "glyph_order_ambiguous", "rendered_gid_mismatch"
FRAGMENT, CONTROL, CONFLICT = "source_extensible_delimiter_fragment", "authoritative_tounicode_control_invalid", "source_signal_conflict"
NAME_RULE, CONTROL_RULE, NO_CONTENT = "cff_tex_glyph_name_authoritative", "invalid_tounicode_control_ignored_for_agl_source", "candidate_content_missing"
#: What is read of a glyph.
GLYPH = ["u", "name", "method", "to_unicode", "rendered_u", "gid", "rendered_gid", "evidence", "block", "line", "span", "char", "size", "oy", "x0", "y0", "x1", "y1"]


def glyph_signals(glyphs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The glyphs with ``named`` (the font's own name for the glyph settles its text), ``fragment``, ``control`` (a ToUnicode text with control
    characters) and ``conflict`` (signals that are left disagree). ``names``: the texts of glyph names, a constant table."""
    same = F.array_contains("evidence", F.col("name")) & (F.col("method") == "agl") & (F.col("gid") == F.col("rendered_gid"))
    expected = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]), F.col("name")) if names else F.lit(None).cast("string")
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = glyphs.withColumns({"named": sure(same & (F.col("u") == expected)), "fragment": sure(same & F.col("name").isin(*FRAGMENTS)), "control": sure(F.col("to_unicode").rlike(r"[\p{Cc}\p{Cs}]"))})
    ignored = (F.col("method") == "agl") & F.col("control")
    signals = F.array_distinct(F.array_compact(F.array("u", "rendered_u", F.when(~sure(ignored), F.col("to_unicode")))))
    return rows.withColumn("conflict", ~F.col("named") & ~F.col("fragment") & (F.size(signals) > 1))


_READ = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("canonical", T.ArrayType(T.StringType())), T.StructField("signature", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])


def read(glyphs: list[dict], rules: list[dict]) -> tuple[list[str], list[str] | None, list[str] | None, str | None]:
    """The tokens of some glyphs as they stand, their tokens in logical order, the relation signature, and a reason where there is none."""
    tokens = [c for c in unicodedata.normalize("NFC", "".join(g["u"] or "" for g in glyphs)) if not c.isspace()]
    signature, reason = relations.expression([g | {"u": g["u"] or ""} for g in glyphs], rules)
    if signature is None:
        return tokens, None, None, reason
    return tokens, list(unicodedata.normalize("NFC", "".join(t for t in signature if not latex.is_marker(t)))), signature, None


@F.pandas_udf(_READ)
def read_udf(glyphs: pd.Series, rules: pd.Series) -> pd.DataFrame:
    rows = [read([dict(g) for g in gs] if gs is not None else [], [dict(r) for r in rs] if rs is not None else []) for gs, rs in zip(glyphs, rules, strict=True)]
    return pd.DataFrame(rows, columns=["tokens", "canonical", "signature", "reason"])


def _source(status: Column, limitations: Column) -> tuple[Column, Column]:
    """(semantic, reasons) by the first rule that holds, over the flags of the region's glyphs."""
    traced = [(F.col("order_ambiguous"), "ambiguous", ORDER), (F.size("gid_mismatches") > 0, "not_established", GID), (F.col("fragment"), "not_established", FRAGMENT), (F.col("control"), "not_established", CONTROL), (F.size("conflicts") > 0, "conflicting", CONFLICT)]
    missing = F.when(F.size(limitations) > 0, limitations).otherwise(F.array(F.lit(NOT_TRACED)))
    semantic = F.when(status == "ambiguous", "ambiguous").when(status != "traced", "not_established")
    reasons = F.when(status == "ambiguous", F.array(F.lit(ALIGNMENT_AMBIGUOUS))).when(status != "traced", missing)
    for holds, name, code in traced:
        semantic, reasons = semantic.when(holds, name), reasons.when(holds, F.array(F.lit(code)))
    return semantic.otherwise("established"), reasons.otherwise(F.array().cast("array<string>"))


def evaluated(regions: DataFrame, glyphs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The regions with semantic, reasons, rules_applied, source_tokens, canonical_tokens, source_signature, relation_reason, candidate_tokens,
    candidate_signature, failure_stage, candidate_status, verdict, conflicts and signal_missing.

    ``regions``: page, id, status, limitations (codes, or null), indices (glyphs by number, in order; null: none), candidate_text,
    candidate_format (latex or mixed_text), link_status, link_reason, rules (those that structure it: x0, x1, y, width; null: none).
    ``glyphs``: page, id (the number) and ``GLYPH``; a number without a glyph is left out. An established source whose relations can't be read
    isn't established. Candidates are compared by tokens first, then by relations where the source has any; a candidate
    whose relations can't be told isn't compared, unless its LaTeX is broken and the source has structure: that contradicts.
    """
    flagged = glyph_signals(glyphs.select("page", "id", *GLYPH), names)
    places = regions.select("page", "id", F.posexplode("indices").alias("at", "glyph"))
    met = places.join(flagged.withColumnRenamed("id", "glyph"), ["page", "glyph"])
    each = F.struct("at", F.col("glyph").alias("seq"), F.struct("block", "line", "span", "char").alias("place"), *[c for c in GLYPH if c not in ("block", "line", "span", "char", "evidence")])
    numbers = lambda flag: F.sort_array(F.collect_list(F.when(flag, F.col("glyph"))))
    held = met.groupBy("page", "id").agg(
        F.array_sort(F.collect_list(each)).alias("held"), numbers(~F.col("gid").eqNullSafe(F.col("rendered_gid"))).alias("gid_mismatches"), numbers(F.col("conflict")).alias("conflicts"), numbers(F.col("to_unicode").isNull()).alias("signal_missing"),
        F.max("fragment").alias("fragment"), F.max(F.col("control") & (F.col("method") == "to_unicode")).alias("control"), F.max("named").alias("named"), F.max(F.col("control") & (F.col("method") == "agl")).alias("ignored"),
    )
    order = F.transform("held", lambda g: g["place"])
    ambiguous = (F.size(F.array_distinct(order)) < F.size(order)) | (order != F.array_sort(order))
    none = F.array().cast("array<long>")
    rows = regions.join(held.withColumn("order_ambiguous", ambiguous), ["page", "id"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("order_ambiguous", "fragment", "control", "named", "ignored")} | {c: F.coalesce(c, none) for c in ("gid_mismatches", "conflicts", "signal_missing")})
    semantic, reasons = _source(F.col("status"), F.col("limitations"))
    rows = rows.withColumns({"semantic": semantic, "reasons": reasons, "source": read_udf("held", "rules"), "parsed": latex.analyse_udf("candidate_text", "candidate_format")})
    source, parsed = F.col("source"), F.col("parsed")
    unread = (F.col("semantic") == "established") & source["reason"].isNotNull()
    kept = lambda flag, code: F.when(flag, F.lit(code))
    rules = F.array_compact(F.array(kept(F.col("named"), NAME_RULE), kept(F.col("ignored"), CONTROL_RULE)))
    rules = F.when(F.col("semantic") == "established", rules).otherwise(F.array().cast("array<string>"))
    blank = parsed["reason"].isNull() & (F.coalesce(F.size(parsed["tokens"]), F.lit(0)) <= 0)
    more = F.array_compact(F.array(F.when(unread, source["reason"]), F.coalesce(parsed["reason"], F.when(blank, NO_CONTENT))))
    rows = rows.withColumns({
        "rules_applied": rules, "reasons": F.concat("reasons", more), "semantic": F.when(unread, "not_established").otherwise(F.col("semantic")), "source_tokens": source["tokens"], "canonical_tokens": source["canonical"],
        "source_signature": source["signature"], "relation_reason": source["reason"], "candidate_tokens": parsed["tokens"], "candidate_signature": parsed["signature"],
        "failure_stage": evidence.failure_stage(parsed["reason"], F.col("link_reason")),
    })
    basis = F.when(F.size("canonical_tokens") > 0, F.col("canonical_tokens")).otherwise(F.col("source_tokens"))
    established = F.col("semantic") == "established"
    structured = F.exists("source_signature", lambda t: t.startswith("<"))
    broken = established & (F.col("link_status") == "linked") & (F.trim("candidate_text") != "") & structured & (parsed["reason"] == latex.INVALID)
    comparable = established & (F.size("candidate_tokens") > 0) & (F.col("source_signature").isNull() | F.col("candidate_signature").isNotNull())
    same = F.col("source_signature").isNull() | F.col("candidate_signature").eqNullSafe(F.col("source_signature"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    candidate = (
        F.when(sure(broken), "contradicting").when(~sure(comparable), "not_evaluated").when(F.col("candidate_tokens") == basis, F.when(same, "matching").otherwise("contradicting"))
        .when(is_subsequence(F.col("candidate_tokens"), basis), "missing").otherwise("contradicting")
    )
    rows = rows.withColumn("candidate_status", candidate)
    verdict = F.when(F.col("candidate_status") == "matching", "conformant_within_scope").when(F.col("candidate_status") == "not_evaluated", "non_verifiable").otherwise("contradicted")
    return rows.withColumn("verdict", verdict).select(
        *regions.columns, "semantic", "reasons", "rules_applied", "source_tokens", "canonical_tokens", "source_signature", "relation_reason", "candidate_tokens", "candidate_signature", "failure_stage", "candidate_status", "verdict", "conflicts", "signal_missing",
    )


def relations_of(glyphs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens, canonical, signature and reason of each region: how its glyphs stand to each other and to its rules.

    ``glyphs``: keys, seq, u, name, size, oy, x0, y0, x1, y1; ``rules``: keys, x0, x1, y, width. Fractions by a rule, a radical over its radicand,
    operators with bounds, and lines with scripts are told; what could be read in two ways has a reason instead.
    """
    columns = ["seq", "u", "name", "size", "oy", "x0", "y0", "x1", "y1"]
    held = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__g"))
    ruled = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "y", "width"))).alias("__r"))
    return held.join(ruled, keys, "left").withColumn("__t", read_udf("__g", "__r")).select(*keys, "__t.*")
