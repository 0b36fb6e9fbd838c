"""From evidence to verdicts: page reports, scaled regions, their glyphs and tokens, and the report of all regions, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import evaluate, semantics, spatial
from .checks import first_limitation, require_supported, require_unambiguous

_SIDES = ("x0", "y0", "x1", "y1")


def page_reports(pages: DataFrame) -> DataFrame:
    """page, status, code, scale of pages (page, box of the source, width and height of the candidate, rotation, n_layers).

    A rotated page is unsupported and one with several layers of text ambiguous: a row with a code, not an error. ``scale`` is
    null where the two frames aren't one another's multiple. A page that is given twice counts once, and is ambiguous where its rows differ.
    """
    own = [c for c in pages.columns if c != "page"]
    pages = pages.groupBy("page").agg(F.min(F.struct(*own)).alias("__row"), F.count_distinct(F.struct(*own)).alias("__rows")).select("page", "__row.*", "__rows")
    limit = first_limitation(require_supported(F.col("rotation") == 0, "page_rotation_unsupported"), require_unambiguous(F.col("__rows") == 1, "page_rows_ambiguous"), require_unambiguous(F.col("n_layers") <= 1, "page_text_layers_ambiguous"))
    scale = G.uniform_scale(G.Box.of(""), F.col("width"), F.col("height"))
    return pages.select("page", F.coalesce(limit["status"], F.lit("traced")).alias("status"), limit["code"].alias("code"), scale.alias("scale"))


def normalised(regions: DataFrame, reports: DataFrame) -> DataFrame:
    """``regions`` with their boxes in the frame of the source; one whose page has no scale keeps its box."""
    scale = F.coalesce("scale", F.lit(1.0))
    return regions.join(reports.select("page", "scale"), "page", "left").withColumns({c: F.col(c) * scale for c in _SIDES}).drop("scale")


def aligned(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """page, id, indices (ids of the glyphs that only this region owns, in order), n_multiple, n_boundary of each region that any glyph touches."""
    owns = G.contains_center(spatial.left_box(), spatial.right_box()) & (G.overlap_ratio(spatial.left_box(), spatial.right_box()) >= spatial.ASSIGNED)
    pairs = spatial.overlapping(regions.select("page", "id", *_SIDES), glyphs.select("page", "id", *_SIDES))
    pairs = pairs.select(F.col("l_page").alias("page"), F.col("l_id").alias("id"), F.col("r_id").alias("glyph"), owns.alias("owns"))
    owners = F.count_if("owns").over(Window.partitionBy("page", "glyph"))
    alone = F.col("owns") & (F.col("n") == 1)
    return pairs.withColumn("n", owners).groupBy("page", "id").agg(
        F.array_sort(F.collect_list(F.when(alone, F.col("glyph")))).alias("indices"), F.count_if(F.col("owns") & (F.col("n") > 1)).alias("n_multiple"), F.count_if(~F.col("owns") & (F.col("n") == 0)).alias("n_boundary"),
    )


def looked_up(regions: DataFrame, glyphs: DataFrame, value: str = "u") -> DataFrame:
    """page, id, source_tokens, n_absent: the values of the glyphs in ``indices``, in that order and without blanks, and how many indices have no glyph."""
    places = regions.select("page", "id", F.posexplode("indices").alias("at", "glyph"))
    known = glyphs.select("page", F.col("id").alias("glyph"), F.col(value).alias("__value"), F.lit(True).alias("__there"))
    found = places.join(known, ["page", "glyph"], "left")
    tokens = F.array_sort(F.collect_list(F.when(~F.col("__value").rlike(r"^\s*$"), F.struct("at", "__value"))))
    return found.groupBy("page", "id").agg(F.transform(tokens, lambda t: t["__value"]).alias("source_tokens"), F.count_if(F.col("__there").isNull()).alias("n_absent"))


def report(pages: DataFrame, regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """One row per region: page, id, status, n_glyphs, source_tokens, semantic, candidate_status, verdict.

    ``regions``: page, id, box in the candidate's frame, reason (why it has no place, or null), candidate_tokens. ``glyphs``:
    page, id, box, u. A region whose page has no row isn't traced; one without a box touches nothing.
    """
    reports = page_reports(pages)
    placed = normalised(regions, reports)
    met = aligned(placed, glyphs)
    tokens = looked_up(met, glyphs)
    rows = placed.join(reports.select("page", F.col("status").alias("page_status")), "page", "left").join(met, ["page", "id"], "left").join(tokens, ["page", "id"], "left")
    rows = rows.withColumns({"n_glyphs": F.coalesce(F.size("indices"), F.lit(0)), "n_multiple": F.coalesce("n_multiple", F.lit(0)), "n_boundary": F.coalesce("n_boundary", F.lit(0))})
    rows = rows.withColumn("source_tokens", F.coalesce("source_tokens", F.array().cast("array<string>")))
    traced = F.coalesce(F.col("page_status") == "traced", F.lit(False))
    rows = rows.withColumn("status", evaluate.alignment_status(F.col("reason"), F.col("n_glyphs"), F.col("n_multiple"), F.col("n_boundary"), traced))
    none = F.lit(False)
    semantics = evaluate.source_semantics(F.col("status"), none, none, none, none, none)
    null = F.lit(None)
    rows = rows.withColumn("semantic", semantics["semantic"]).withColumns({"canonical_tokens": null.cast("array<string>"), "source_signature": null.cast("array<string>"), "candidate_signature": null.cast("array<string>")})
    return evaluate.evaluated(rows).select("page", "id", "status", "n_glyphs", "source_tokens", "semantic", "candidate_status", "verdict")


def semantic_report(pages: DataFrame, regions: DataFrame, glyphs: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per region with what its source says, what its candidate says, the verdict, and all reasons (see ``semantics.evaluated``).

    ``regions``: page, id, box in the candidate's frame, reason, limitations, candidate_text, candidate_format, link_status, link_reason,
    rules. ``glyphs``: page, id, box and the signals of each glyph. A region given a reason has that and its limitations as reasons.
    """
    reports = page_reports(pages)
    placed = normalised(regions, reports)
    rows = placed.join(reports.select("page", F.col("status").alias("page_status")), "page", "left").join(aligned(placed, glyphs), ["page", "id"], "left")
    counts = [F.coalesce(F.size("indices"), F.lit(0)), F.coalesce("n_multiple", F.lit(0)), F.coalesce("n_boundary", F.lit(0))]
    status = evaluate.alignment_status(F.col("reason"), *counts, F.coalesce(F.col("page_status") == "traced", F.lit(False)))
    return semantics.evaluated(rows.withColumn("status", status), glyphs, names).drop("page_status", "n_multiple", "n_boundary", "reason")


def summary(reported: DataFrame, reports: DataFrame) -> DataFrame:
    """page, status, code, regions and the count of each verdict, for every page; pages without regions have zeros."""
    count = lambda verdict: F.count_if(F.col("verdict") == verdict).alias(verdict)
    counts = reported.groupBy("page").agg(F.count(F.lit(1)).alias("regions"), count("conformant_within_scope"), count("contradicted"), count("non_verifiable"))
    return reports.select("page", "status", "code").join(counts, "page", "left").fillna(0, ["regions", "conformant_within_scope", "contradicted", "non_verifiable"])
