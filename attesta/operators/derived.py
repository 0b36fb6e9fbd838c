"""Derived documents: accepted corrections put into the texts, and formulas into the HTML that is rendered from them, in one pass.

Texts are rendered with a marker in place of each correction, and the markers are then exchanged for formulas all at once. That every
marker stands in the HTML exactly once is proven by counting before anything is exchanged; what can't be proven is a row with a code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed codes of corrections that can't be put in; attributes of published formulas.
UNKNOWN, SPAN, WHOLE, OVERLAP, LOST = "correction_reference_missing", "correction_span_invalid", "correction_formula_partial", "correction_overlap", "correction_not_localisable"
REF, LOCUS, CORRECTION = "data-docling-ref", "data-docling-charspan", "data-correction-id"
#: Markers are a private character, a number that makes them unlike all that the document holds, and the correction's own number.
_OPEN, _CLOSE, _TRIES = "\ue000", "\ue001", 16


def loci(doc: str, texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """The corrections with derived_start, derived_end and code: where each stands once all sound ones of its text are put in.

    ``texts``: doc, ref, label, text. ``corrections``: doc, target_id, ref, start, end, after, mathml. A correction has to lie in its text, to cover all of it
    where that is a formula, and to share no character with another sound one of its text: those that do are all refused. Sound
    ones may touch. Spans of refused ones are null.
    """
    known = texts.select(doc, "ref", "label", F.length("text").alias("__n"), F.lit(True).alias("__there")).dropDuplicates([doc, "ref"])
    met = corrections.join(known, [doc, "ref"], "left")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("__n")), F.lit(False))
    partial = (F.col("label") == "formula") & ~((F.col("start") == 0) & (F.col("end") == F.col("__n")))
    met = met.withColumn("code", F.when(F.col("__there").isNull(), UNKNOWN).when(~inside | F.col("after").isNull(), SPAN).when(F.coalesce(partial, F.lit(False)), WHOLE))
    # Sorted by their starts, spans overlap if one begins before the furthest end so far, and whatever reaches beyond the next start is hit.
    w = Window.partitionBy(doc, "ref", F.col("code").isNull()).orderBy("start", "end", "target_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumns({"__hits": F.coalesce(F.col("start") < reach, F.lit(False)), "__next": F.lead("start").over(w)})
    met = met.withColumn("code", F.when(F.col("code").isNull() & (F.col("__hits") | F.coalesce(F.col("__next") < F.col("end"), F.lit(False))), OVERLAP).otherwise(F.col("code")))
    delta = F.length("after") - F.col("end") + F.col("start")
    sound = Window.partitionBy(doc, "ref", F.col("code").isNull()).orderBy("start", "end", "target_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("code").isNull(), F.col("start") + F.coalesce(F.sum(delta).over(sound), F.lit(0)))
    return met.withColumn("derived_start", at.cast("int")).withColumn("derived_end", (F.col("derived_start") + F.length("after")).cast("int")).drop("__n", "__there", "__hits", "__next", "label")


def _patched(text: Column, edits: Column) -> Column:
    """The text with edits (start, end, after), which are sorted and apart, put in from the left."""
    told = F.aggregate(edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, e: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["after"]).alias("out"), e["end"].alias("at")))
    return F.concat(told["out"], F.substring(text, told["at"] + 1, F.length(text)))


def derived(doc: str, texts: DataFrame, corrections: DataFrame, render: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The derived texts (doc, ref, label, text), the documents (doc, html), and the corrections with their loci and codes.

    ``render`` makes doc, html of doc, ref, label, text. Each sound correction's ``mathml`` (one math element) stands in the HTML in its place, with its
    reference, locus and target; if its marker isn't there exactly once, that is its code, and the marker's places keep its text.
    """
    placed = loci(doc, texts, corrections)
    sound = placed.where("code IS NULL").withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy("ref", "start", "end", "target_id")))
    # The first number whose marker begins nothing in the document's own texts or corrections.
    taken = texts.select(doc, F.col("text").alias("t")).unionAll(corrections.select(doc, F.col("after").alias("t"))).where(F.contains("t", F.lit(_OPEN)))
    taken = taken.select(doc, F.explode(F.regexp_extract_all("t", F.lit(f"{_OPEN}([0-9]+)"), F.lit(1))).alias("n")).groupBy(doc).agg(F.collect_set("n").alias("__taken"))
    free = F.array_except(F.transform(F.sequence(F.lit(0), F.lit(_TRIES)), lambda i: i.cast("string")), F.coalesce("__taken", F.array().cast("array<string>")))
    sound = sound.join(taken, doc, "left").withColumn("__own", F.concat(F.lit(_OPEN), F.element_at(free, 1), F.lit(_OPEN))).drop("__taken")
    marker = F.concat("__own", F.col("__k").cast("string"), F.lit(_CLOSE))
    edits = sound.groupBy(doc, "ref").agg(F.array_sort(F.collect_list(F.struct("start", "end", "after"))).alias("__e"), F.array_sort(F.collect_list(F.struct("start", "end", marker.alias("after")))).alias("__m"))
    met = texts.select(doc, "ref", "label", "text").join(edits, [doc, "ref"], "left")
    put = lambda e: F.when(F.col(e).isNull(), F.col("text")).otherwise(_patched(F.col("text"), F.col(e)))
    new = met.select(doc, "ref", "label", put("__e").alias("text"))
    html = render(met.select(doc, "ref", "label", put("__m").alias("text"))).select(doc, "html")

    span = F.concat_ws(":", "derived_start", "derived_end")
    attributes = F.concat(F.lit(f'<math {REF}="'), "ref", F.lit(f'" {LOCUS}="'), span, F.lit(f'" {CORRECTION}="'), "target_id", F.lit('"'))
    formula = F.concat(attributes, F.substring("mathml", 6, 2**31 - 1))
    given = sound.groupBy(doc).agg(F.first("__own").alias("__own"), F.map_from_entries(F.collect_list(F.struct("__k", F.struct(formula.alias("formula"), F.col("after").alias("after"))))).alias("__of"))
    pattern = F.concat(F.coalesce("__own", F.lit(_OPEN + "none")), F.lit("([0-9]+)" + _CLOSE))
    held = html.join(given, doc, "left").withColumns({"__ids": F.transform(F.regexp_extract_all("html", pattern, F.lit(1)), lambda x: x.cast("int")), "__parts": F.split("html", pattern)})
    once = lambda x: F.size(F.filter("__ids", lambda y: y == x)) == 1
    shown = F.transform(F.arrays_zip(F.col("__ids").alias("x"), F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(1))).alias("p")), lambda z: F.concat(F.when(once(z["x"]), F.col("__of")[z["x"]]["formula"]).otherwise(F.col("__of")[z["x"]]["after"]), z["p"]))
    documents = held.select(doc, F.when(F.size("__ids") > 0, F.concat(F.element_at("__parts", 1), F.array_join(shown, ""))).otherwise(F.col("html")).alias("html"))
    counts = held.select(doc, F.explode("__ids").alias("__k")).groupBy(doc, "__k").agg(F.count("*").alias("__n"))
    lost = sound.join(counts, [doc, "__k"], "left").where(~F.col("__n").eqNullSafe(F.lit(1).cast("long"))).select(doc, "target_id", F.lit(LOST).alias("__lost"))
    out = placed.join(lost, [doc, "target_id"], "left").withColumn("code", F.coalesce("code", "__lost")).drop("__lost")
    return new, documents, out
