"""Correction targets: grouping of contradicted regions, eligibility, and patching of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that would join statements without proof.
CONNECTIVES = ["and", "if", "is", "or", "otherwise", "when", "where"]


def targets(regions: DataFrame) -> DataFrame:
    """Group regions (region_id, ref, label, verdict, start, end, missing, page, first_glyph) into targets.

    First all contradicted regions of one formula, then contradicted spans of one text that overlap strictly (islands of
    several), then each region that is left on its own. target, kind, region_ids, page, start, end.
    """
    wrong = F.col("verdict") == "contradicted"
    held = regions.where(wrong | F.col("missing")).withColumn("__formula", wrong & (F.col("label") == "formula"))
    w = Window.partitionBy("ref", "__spanned").orderBy("start", "end", "region_id")
    spanned = held.withColumn("__spanned", wrong & ~F.col("__formula") & F.col("start").isNotNull() & F.col("ref").isNotNull())
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spanned = spanned.withColumn("__new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    spanned = spanned.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    several = F.count(F.lit(1)).over(Window.partitionBy("ref", "__spanned", "__island")) > 1
    key = (
        F.when(F.col("__formula"), F.concat(F.lit("formula:"), "ref"))
        .when(F.col("__spanned") & several, F.concat_ws(":", F.lit("merged"), "ref", "__island"))
        .otherwise(F.concat(F.lit("single:"), F.col("region_id").cast("string")))
    )
    kind = F.when(F.col("__formula"), "formula_replacement").when(F.col("__spanned") & several, "merged_replacement").when(F.col("missing"), "formula_insertion").otherwise("replacement")
    keyed = spanned.withColumns({"target": key, "kind": kind})
    out = keyed.groupBy("target", "kind").agg(F.array_sort(F.collect_list("region_id")).alias("region_ids"), F.min("page").alias("page"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_glyph").alias("first_glyph"))
    return out


def source_ineligibility(status: Column, semantic: Column, relation_reason: Column, tokens: Column, signature: Column, bbox: Column) -> Column:
    return (
        F.when(~status.eqNullSafe(F.lit("traced")) | ~semantic.eqNullSafe(F.lit("established")), "source_not_established")
        .when(relation_reason.isNotNull(), relation_reason)
        .when(tokens.isNull() | signature.isNull(), "source_relations_not_established")
        .when(bbox.isNull() | (F.size(bbox) != 4), "source_bbox_missing")
    )


def target_ineligibility(kind: Column, scope_reason: Column, region_reason: Column, loci_missing: Column, loci_overlap: Column) -> Column:
    """The first rule that stands against a target."""
    return (
        F.when(kind == "formula_insertion", "formula_insertion_rendering_unproven").when(scope_reason.isNotNull(), scope_reason).when(region_reason.isNotNull(), region_reason)
        .when(~kind.isin("merged_replacement", "formula_replacement"), F.lit(None).cast("string"))
        .when(loci_missing, "source_loci_missing").when(loci_overlap, "source_loci_overlap").when(kind == "merged_replacement", "merged_replacement_context_unproven")
    )


def scope_reason(text: Column, candidate: Column, source: Column, canonical: Column) -> Column:
    """Why a candidate text says more than its source."""
    connective = r"(?i)(?<![A-Za-z])(?:" + "|".join(CONNECTIVES) + r")(?![A-Za-z])"
    return (
        F.when(candidate.isNull() | ((candidate != source) & (candidate != canonical)), "candidate_content_not_covered_by_source")
        .when(text.rlike(connective), "candidate_contains_unproven_connective")
        .when(text.rlike(r"\p{L}{2,}(?:-\p{L}+)*(?:\s+\p{L}+(?:-\p{L}+)*)+"), "candidate_contains_unstructured_prose")
    )


def _patched(text: str | None, edits: list | None) -> str | None:
    """Edits of a text put in from the right; null where they leave the text or overlap."""
    if text is None:
        return None
    out, limit = text, len(text)
    for edit in sorted(edits if edits is not None else [], key=lambda e: (e["start"], e["end"]), reverse=True):
        a, b = edit["start"], edit["end"]
        if not 0 <= a <= b <= limit:
            return None
        out, limit = out[:a] + edit["after"] + out[b:], a
    return out


@F.pandas_udf(T.StringType())
def patched_udf(texts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([_patched(t, e) for t, e in zip(texts, edits, strict=True)], dtype=object)


def patch(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """key, text with the edits (key, start, end, after) put in; null where they can't be."""
    listed = edits.groupBy(key).agg(F.collect_list(F.struct("start", "end", "after")).alias("__edits"))
    return texts.join(listed, key, "left").select(key, F.when(F.col("__edits").isNull(), F.col("text")).otherwise(patched_udf("text", "__edits")).alias("text"))


def proposals(targets: DataFrame, lookup, batch_rows: int = 64) -> DataFrame:
    """Append ``proposal`` and ``failure`` by a lookup function of a request, called on the executors.

    ``lookup(request) -> str`` may raise; the failure's class name is kept. Rows whose ``proven`` isn't null need no lookup and
    never reach it.
    """
    done = targets.where("proven IS NOT NULL").withColumns({"proposal": F.col("proven"), "failure": F.lit(None).cast("string")})

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows].copy()
                out = []
                for request in part["request"]:
                    try:
                        out.append((lookup(request), None))
                    except Exception as e:  # any failure of a lookup is a row
                        out.append((None, type(e).__name__))
                part["proposal"], part["failure"] = [o[0] for o in out], [o[1] for o in out]
                yield part

    schema = T.StructType([*targets.schema.fields, T.StructField("proposal", T.StringType()), T.StructField("failure", T.StringType())])
    return done.unionByName(targets.where("proven IS NULL").mapInPandas(run, schema))


def outcome(eligibility: Column, proposal: Column, failure: Column, matches: Column) -> Column:
    """accepted, rejected or failed, for each target."""
    return F.when(eligibility.isNotNull(), "rejected").when(failure.isNotNull(), "failed").when(proposal.isNotNull() & matches, "accepted").otherwise("rejected")
