"""Verdicts of regions: ordered cascades over flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import is_subsequence


def signals_conflict(*signals: Column) -> Column:
    """Whether the signals that are there disagree; an absent one never does."""
    return F.size(F.array_distinct(F.array_compact(F.array(*signals)))) > 1


def source_semantics(status: Column, order_ambiguous: Column, gid_mismatch: Column, fragment: Column, control: Column, conflict: Column) -> Column:
    """(semantic, reason) of a region; the first rule that holds decides."""
    def told(semantic: str, reason: str | None) -> Column:
        return F.struct(F.lit(semantic).alias("semantic"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when(status == "ambiguous", told("ambiguous", "structural_alignment_ambiguous"))
        .when(status != "traced", told("not_established", "structural_alignment_not_traced"))
        .when(order_ambiguous, told("ambiguous", "glyph_order_ambiguous"))
        .when(gid_mismatch, told("not_established", "rendered_gid_mismatch"))
        .when(fragment, told("not_established", "source_extensible_delimiter_fragment"))
        .when(control, told("not_established", "source_control_tounicode"))
        .when(conflict, told("conflicting", "source_signals_conflict"))
        .otherwise(told("established", None))
    )


def compared(semantic: Column, source: Column, canonical: Column, candidate: Column, source_signature: Column, candidate_signature: Column) -> Column:
    """candidate status: matching, missing, contradicting or not_evaluated.

    Tokens decide first: equal to the source's (its canonical ones where there are any), part of them in their order (missing),
    or neither. Then the relations. An empty candidate or an unestablished source isn't evaluated.
    """
    basis = F.when(canonical.isNotNull() & (F.size(canonical) > 0), canonical).otherwise(source)
    blank = candidate.isNull() | (F.size(candidate) == 0)
    return (
        F.when((semantic != "established") | blank, "not_evaluated")
        .when((candidate != basis) & (candidate != source), F.when(is_subsequence(candidate, basis), "missing").otherwise("contradicting"))
        .when(source_signature.isNotNull() & candidate_signature.isNotNull() & (source_signature != candidate_signature), "contradicting")
        .otherwise("matching")
    )


def verdict(semantic: Column, candidate: Column) -> Column:
    return F.when(candidate.isin("missing", "contradicting"), "contradicted").when((semantic == "established") & (candidate == "matching"), "conformant_within_scope").otherwise("non_verifiable")


def alignment_status(reason: Column, n_glyphs: Column, n_multiple: Column, n_boundary: Column, page_traced: Column) -> Column:
    """Status of a region by its glyphs: the candidate's own reason, then the page, then what was found."""
    return (
        F.when(reason.isNotNull(), "unsupported").when(~page_traced, "page_not_traced").when(n_multiple > 0, "ambiguous")
        .when(n_boundary > 0, "boundary").when(n_glyphs == 0, "missing").otherwise("traced")
    )


def evaluated(regions: DataFrame) -> DataFrame:
    """Append candidate_status and verdict to rows with semantic, tokens and signatures of both sides."""
    status = compared(F.col("semantic"), F.col("source_tokens"), F.col("canonical_tokens"), F.col("candidate_tokens"), F.col("source_signature"), F.col("candidate_signature"))
    return regions.withColumn("candidate_status", status).withColumn("verdict", verdict(F.col("semantic"), F.col("candidate_status")))
