"""Glyph evidence: the flat reference row, and which of its signals decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of pieces of large delimiters, and reason codes of candidates that aren't there.
FRAGMENTS = ["bracelefttp", "braceleftmid", "braceleftbt", "bracerighttp", "bracerightmid", "bracerightbt", "bracketlefttp", "bracketleftbt", "bracketrighttp", "bracketrightbt", "parenlefttp", "parenleftbt", "parenrighttp", "parenrightbt", "braceex"]
MISSING = ["docling_picture_candidate_missing", "docling_text_container_missing"]
ACQUISITION = [*MISSING, "docling_text_container_ambiguous"]
STRUCTURE = ["candidate_relation_invalid", "candidate_relation_unsupported"]


def reference_rows(evidence: DataFrame) -> DataFrame:
    """Nested evidence (page, glyph) as one flat row per glyph; only the fields that are read are scanned."""
    g, r = (lambda c: F.col(f"glyph.{c}")), (lambda c: F.col(f"glyph.rendered.{c}"))
    plain = ["sequence_index", "glyph_name", "source_unicode", "source_unicode_method", "agl_unicode", "font_resource", "code", "code_hex", "cff_gid", "to_unicode"]
    return evidence.select(
        "page", *[g(c).alias(c) for c in plain], g("source_unicode").alias("unicode"), F.coalesce(g("font_math_glyph_evidence"), F.array().cast("array<string>")).alias("font_math_glyph_evidence"),
        r("bbox").alias("bbox"), r("gid").alias("rendered_gid"), r("unicode_text").alias("rendered_unicode"), r("font").alias("rendered_font"), F.element_at(r("origin"), 1).alias("rendered_origin_x"), F.element_at(r("origin"), 2).alias("rendered_origin_y"), r("size").alias("rendered_size"),
    )


def _named(name: Column, evidence: Column, method: Column, gid: Column, rendered: Column) -> Column:
    """The font itself declares the glyph's name, the text comes from it, and the rendered glyph is the same."""
    return F.array_contains(evidence, name) & (method == "agl") & (gid == rendered)


def name_decides(name: Column, expected: Column, unicode: Column, evidence: Column, method: Column, gid: Column, rendered: Column) -> Column:
    """The glyph's name is authoritative: it also stands for the very character (``expected``, from a table of names)."""
    return F.coalesce((unicode == expected) & _named(name, evidence, method, gid, rendered), F.lit(False))


def delimiter_fragment(name: Column, evidence: Column, method: Column, gid: Column, rendered: Column) -> Column:
    return F.coalesce(name.isin(*FRAGMENTS) & _named(name, evidence, method, gid, rendered), F.lit(False))


def missing_candidate(code: Column) -> Column:
    return F.coalesce(code.isin(*MISSING), F.lit(False))


def needs_normalising(verdict: Column, kind: Column, link: Column, text: Column, source: Column, candidate: Column) -> Column:
    """Right as it is, but written as text around formulas though it holds scripts."""
    return F.coalesce(
        (verdict == "conformant_within_scope") & (kind == "mixed_text") & (link == "linked") & text.contains("$") & ~(text.startswith("$") & text.endswith("$"))
        & F.exists(source, lambda t: t.isin("<sub>", "<sup>")) & (candidate == source),
        F.lit(False),
    )


def failure_stage(candidate: Column, link: Column) -> Column:
    """The stage at which a candidate failed, by its own reason first, then by that of its link."""
    return (
        F.when(candidate == "candidate_latex_invalid", "latex_parsing").when(candidate.isin(*STRUCTURE), "math_structure").when(candidate.isNotNull(), "candidate_evaluation")
        .when(link == "docling_text_alignment_incomplete", "text_alignment").when(link.isin(*ACQUISITION), "candidate_acquisition")
    )


def page_has_content(text: Column, images: Column, drawings: Column) -> Column:
    return (F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0) | (images > 0) | (drawings > 0)


def negated_operators(text: Column) -> Column:
    """The stroke U+0338 that stands before its operator goes behind it, as composed text has it."""
    return F.regexp_replace(text, "̸(\\s*)([=<>≤≥≡∼≈∈⊂⊆])", "$1$2̸")
