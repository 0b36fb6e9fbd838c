"""Candidate documents: an explicit schema, regions flattened from it, and checks of its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dollars import paired_spans_udf

_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in "ltrb"] + [T.StructField("coord_origin", T.StringType())])
PROVENANCE = T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("bbox", _BOX), T.StructField("charspan", T.ArrayType(T.IntegerType()))])
TEXT = T.StructType([*[T.StructField(n, T.StringType()) for n in ("self_ref", "label", "text", "orig", "content_layer")], T.StructField("prov", T.ArrayType(PROVENANCE))])
ITEM = T.StructType([T.StructField("self_ref", T.StringType()), T.StructField("prov", T.ArrayType(PROVENANCE))])
PAGE = T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("size", T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])), T.StructField("image", T.StructType([T.StructField("uri", T.StringType())]))])
CANDIDATE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("schema_name", "version", "name")], T.StructField("pages", T.MapType(T.StringType(), PAGE)), T.StructField("texts", T.ArrayType(TEXT)),
    *[T.StructField(n, T.ArrayType(ITEM)) for n in ("pictures", "tables", "key_value_items", "form_items")],
])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON files, one each; what can't be read keeps its text in ``_corrupt_record``."""
    schema = T.StructType([*CANDIDATE.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def parsed(texts: DataFrame, column: str) -> DataFrame:
    return texts.withColumn("document", F.from_json(column, CANDIDATE))


def formula_regions(documents: DataFrame, key: str) -> DataFrame:
    """key, region_id, ref, page, box, charspan, text, reason: a row for each provenance of a formula; one with a reason where there is none."""
    items = documents.select(key, F.explode("document.texts").alias("t")).where("t.label = 'formula'")
    rows = items.select(key, "t", F.posexplode_outer("t.prov").alias("i", "p"))
    many = F.size("t.prov") > 1
    region = F.when(many, F.concat_ws(":", "t.self_ref", F.col("i").cast("string"))).otherwise(F.col("t.self_ref"))
    return rows.select(key, region.alias("region_id"), F.col("t.self_ref").alias("ref"), F.col("p.page_no").alias("page"), F.col("p.bbox").alias("box"), F.col("p.charspan").alias("charspan"), F.col("t.text").alias("text"), F.when(F.col("p").isNull(), "formula_provenance_missing").alias("reason"))


def inline_regions(documents: DataFrame, key: str) -> DataFrame:
    """The same columns for spans between dollars in texts of the body; a span needs exactly one provenance that holds it."""
    items = documents.select(key, F.explode("document.texts").alias("t")).where("t.label NOT IN ('code', 'formula') AND coalesce(t.content_layer, 'body') = 'body' AND contains(t.text, '$')")
    spans = items.select(key, "t", F.posexplode(paired_spans_udf("t.text")).alias("i", "s"))
    holds = F.filter("t.prov", lambda p: (F.element_at(p["charspan"], 1) <= F.col("s.start")) & (F.col("s.end") <= F.element_at(p["charspan"], 2)))
    rows = spans.withColumn("h", holds)
    one = F.when(F.size("h") == 1, F.element_at("h", 1))
    reason = F.when(~F.size("h").eqNullSafe(1), "inline_math_provenance_ambiguous").when(F.col("s.reason").isNotNull(), F.col("s.reason")).otherwise("inline_math_bbox_unavailable")
    return rows.select(key, F.concat_ws(":", "t.self_ref", F.lit("inline"), F.col("i").cast("string")).alias("region_id"), F.col("t.self_ref").alias("ref"), one["page_no"].alias("page"), F.lit(None).cast(_BOX).alias("box"), F.array("s.start", "s.end").alias("charspan"), F.expr("substring(t.text, s.start + 1, s.end - s.start)").alias("text"), reason.alias("reason"))


def regions(documents: DataFrame, key: str) -> DataFrame:
    return formula_regions(documents, key).unionByName(inline_regions(documents, key))


def on_page(documents: DataFrame, page: int) -> DataFrame:
    """Items that have any provenance on a page, nothing else of the document being kept."""
    there = lambda column: F.filter(column, lambda i: F.exists(i["prov"], lambda p: p["page_no"] == page))
    kept = [there(f"document.{c}").alias(c) for c in ("texts", "pictures", "tables")]
    return documents.select(*[c for c in documents.columns if c != "document"], *kept, F.element_at("document.pages", str(page)).alias("page"))


def pages_valid(pages: Column) -> Column:
    """Pages are numbered from 1 without gaps, each with an embedded image."""
    numbers = F.array_sort(F.transform(F.map_keys(pages), lambda k: k.cast("int")))
    dense = numbers == F.sequence(F.lit(1), F.size(numbers))
    return F.coalesce(F.when(F.size(pages) > 0, dense & F.forall(F.map_values(pages), lambda p: p["image"]["uri"].startswith("data:image/"))), F.lit(False))


def items_valid(texts: Column, pages: Column) -> Column:
    """Every text has provenances, all of them on pages that are there; an empty text needs none."""
    known = F.transform(F.map_keys(pages), lambda k: k.cast("int"))
    return F.forall(texts, lambda t: ((F.size(t["prov"]) > 0) | (F.coalesce(t["text"], F.lit("")) == "")) & F.forall(t["prov"], lambda p: F.array_contains(known, p["page_no"])))


def top_left(box: Column, height: Column) -> Column:
    """A box as [x0, y0, x1, y1] from the top left; null if it isn't in the page."""
    flip = box["coord_origin"] == "BOTTOMLEFT"
    y0, y1 = F.when(flip, height - box["t"]).otherwise(box["t"]), F.when(flip, height - box["b"]).otherwise(box["b"])
    return F.when((box["l"] < box["r"]) & (y0 < y1) & (y0 >= 0) & (y1 <= height), F.array(box["l"], y0, box["r"], y1))
