"""Zero-filled histograms, roll-ups, verdicts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a region, in the order of the report.
SEMANTIC = ["established", "conflicting", "ambiguous", "not_established"]
CANDIDATE = ["matching", "missing", "contradicting", "not_evaluated"]
VERDICT = ["conformant_within_scope", "contradicted", "non_verifiable"]


def histograms(regions: DataFrame, by: str = "page") -> DataFrame:
    """Counts of each state per page and, as scope ``all``, over all; a null page is a page of its own. No state is left out."""
    counts = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in (("semantic", SEMANTIC), ("candidate", CANDIDATE), ("verdict", VERDICT)) for v in values]
    sets = regions.groupingSets([[by], []], by).agg(F.grouping(by).alias("__all"), F.count(F.lit(1)).alias("regions"), *counts)
    return sets.withColumn("scope", F.when(F.col("__all") == 1, "all").otherwise("page")).drop("__all")


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 6))


def document_verdict(contradicted: Column, non_verifiable: Column, total: Column) -> Column:
    """Any contradiction decides; then nothing verifiable, then something not."""
    return (
        F.when(contradicted > 0, "contradicted").when((total == 0) | (non_verifiable == total), "non_verifiable")
        .when(non_verifiable > 0, "partially_conformant").otherwise("conformant_within_scope")
    )


def correction_status(accepted: Column, rejected: Column, failed: Column) -> Column:
    return F.when(failed > 0, "failed").when(accepted > 0, "corrected").when(rejected > 0, "rejected").otherwise("not_required")


def blocking_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The codes of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(when, code) for when, code in rules]))


def gate(corpora: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row: ``reasons``, a code ``<metric>_below_threshold`` for each metric that some corpus misses, and ``passed``.

    Only corpora that are exhaustive and representative count; without any, the gate is blocked by ``no_representative_corpus``.
    """
    counts = F.col("exhaustive") & F.col("representative")
    below = [F.coalesce(F.bool_or(counts & (F.col(m) < t)), F.lit(False)).alias(m) for m, t in thresholds.items()]
    one = corpora.agg(F.coalesce(F.bool_or(counts), F.lit(False)).alias("__any"), *below)
    reasons = blocking_reasons([(~F.col("__any"), "no_representative_corpus"), *[(F.col(m), f"{m}_below_threshold") for m in thresholds]])
    return one.select(reasons.alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def grouped_text(glyphs: DataFrame, keys: list[str], order: str, text: str, having: Column) -> DataFrame:
    """Ordered texts of groups in which some row is marked: keys, text, n."""
    rows = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("__g"), F.bool_or(having).alias("__any"))
    return rows.where("__any").select(*keys, F.array_join(F.transform("__g", lambda g: g[text]), "").alias("text"), F.size("__g").cast("long").alias("n"))


def ordered_digest(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """SHA-256 of the values in order, joined by line feeds."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("__g"))
    return held.select(*keys, F.sha2(F.array_join(F.transform("__g", lambda g: g["v"]), "\n"), 256).alias("digest"))


def conflicts(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """keys with the number of rows, the distinct ``order`` values sorted, and the first row's ``values``."""
    first = [F.min_by(v, order).alias(f"first_{v}") for v in values]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(order)).alias("places"), *first)


def envelopes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def contingency(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Counts of two predicates against each other: both, only_a, only_b, neither."""
    return rows.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def usage(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """by, kind, value, n: how often each value of each column stands, e.g. the fonts and operators of a page; nulls aren't counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(by, F.inline(pairs)).where("value IS NOT NULL").groupBy(by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
