"""Queries on glyph evidence and on the states that follow from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import lifecycle
from ..sources.testdata import table
from .registry import query


def _evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    name = F.when(n % 7 == 0, "braceex").when(n % 3 == 0, "plus").otherwise("a")
    rendered = F.struct(
        F.array(*[n.cast("double")] * 4).alias("bbox"), (n % 11).cast("int").alias("gid"), F.lit("+").alias("unicode_text"), F.lit("F").alias("font"), F.array(F.col("value"), F.lit(2.0)).alias("origin"), F.lit(10.0).alias("size"),
    )
    glyph = F.struct(
        n.alias("sequence_index"), name.alias("glyph_name"), F.when(n % 2 == 0, "+").otherwise("a").alias("source_unicode"), F.when(n % 5 == 0, "to_unicode").otherwise("agl").alias("source_unicode_method"), F.lit("a").alias("agl_unicode"),
        F.lit("/F1").alias("font_resource"), (n % 256).cast("int").alias("code"), F.hex(n % 256).alias("code_hex"), F.when(n % 13 == 0, 99).otherwise((n % 11).cast("int")).alias("cff_gid"), F.lit("a").alias("to_unicode"),
        F.when(n % 4 != 0, F.array(F.lit("plus"), F.lit("braceex"))).alias("font_math_glyph_evidence"), rendered.alias("rendered"),
    )
    return e.select(F.col("user_id").alias("page"), glyph.alias("glyph"))


@query("""SELECT user_id AS page, event_id AS sequence_index, CASE WHEN event_id % 2 = 0 THEN '+' ELSE 'a' END AS unicode, CASE WHEN event_id % 4 <> 0 THEN ['plus', 'braceex'] ELSE [] END AS font_math_glyph_evidence,
  CAST(event_id % 11 AS INTEGER) AS rendered_gid, value AS rendered_origin_x, 10.0::DOUBLE AS rendered_size FROM events""")
def b01_reference_rows(spark, sf_dir):
    return E.reference_rows(_evidence(spark, sf_dir)).select("page", "sequence_index", "unicode", "font_math_glyph_evidence", "rendered_gid", "rendered_origin_x", "rendered_size")


@query("""WITH g AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'braceex' WHEN event_id % 3 = 0 THEN 'plus' ELSE 'a' END AS n, event_id % 4 <> 0 AS ev, event_id % 5 <> 0 AS agl, event_id % 13 <> 0 OR event_id % 11 = 99 AS same, event_id % 2 = 0 AS plus FROM events)
SELECT id, n = 'plus' AND plus AND ev AND agl AND same AS decides, n = 'braceex' AND ev AND agl AND same AS fragment FROM g""")
def b19_b20_name_evidence(spark, sf_dir):
    g = E.reference_rows(_evidence(spark, sf_dir))
    rest = [F.col(c) for c in ("font_math_glyph_evidence", "source_unicode_method", "cff_gid", "rendered_gid")]
    expected = F.when(F.col("glyph_name") == "plus", "+")
    return g.select(F.col("sequence_index").alias("id"), E.name_decides(F.col("glyph_name"), expected, F.col("unicode"), *rest).alias("decides"), E.delimiter_fragment(F.col("glyph_name"), *rest).alias("fragment"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'candidate_latex_invalid' WHEN 1 THEN 'candidate_relation_invalid' WHEN 2 THEN 'candidate_mixed_text_invalid' END AS c,
  CASE o_custkey % 3 WHEN 0 THEN 'docling_text_alignment_incomplete' WHEN 1 THEN 'docling_text_container_missing' END AS l FROM orders)
SELECT id, CASE WHEN c = 'candidate_latex_invalid' THEN 'latex_parsing' WHEN c = 'candidate_relation_invalid' THEN 'math_structure' WHEN c IS NOT NULL THEN 'candidate_evaluation' WHEN l = 'docling_text_alignment_incomplete' THEN 'text_alignment' WHEN l IS NOT NULL THEN 'candidate_acquisition' END AS stage,
  coalesce(l = 'docling_text_container_missing', false) AS missing FROM r""")
def b09_h57_failure_stages(spark, sf_dir):
    n = F.col("o_orderkey") % 5
    c = F.when(n == 0, "candidate_latex_invalid").when(n == 1, "candidate_relation_invalid").when(n == 2, "candidate_mixed_text_invalid")
    k = F.col("o_custkey") % 3
    link = F.when(k == 0, "docling_text_alignment_incomplete").when(k == 1, "docling_text_container_missing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.failure_stage(c, link).alias("stage"), E.missing_candidate(link).alias("missing"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '$' || lang || '$' WHEN doc_id % 3 = 1 THEN lang || ' $x$' ELSE lang END AS t, doc_id % 5 <> 0 AS ok, doc_id % 2 = 0 AS scripts FROM documents)
SELECT doc_id, ok AND scripts AND contains(t, '$') AND NOT (starts_with(t, '$') AND ends_with(t, '$') ) AS needs FROM d""")
def b10_needs_normalising(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("$"), "lang", F.lit("$"))).when(k == 1, F.concat("lang", F.lit(" $x"), F.lit("$ "))).otherwise(F.col("lang"))
    text = F.when(k == 1, F.concat("lang", F.lit(" $x$"))).otherwise(text)
    signature = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("<sub>"))).otherwise(F.array(F.lit("x")))
    verdict = F.when(F.col("doc_id") % 5 != 0, "conformant_within_scope").otherwise("contradicted")
    return table(spark, sf_dir, "documents").select("doc_id", E.needs_normalising(verdict, F.lit("mixed_text"), F.lit("linked"), text, signature, signature).alias("needs"))


@query("""SELECT page_id, length(trim(CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN NULL ELSE html END)) > 0 IS TRUE OR page_id % 8 = 0 OR page_id % 9 = 0 AS has_content FROM pages""")
def b22_b23_page_content(spark, sf_dir):
    n = F.col("page_id")
    text = F.when(n % 4 == 0, "").when(n % 4 == 1, None).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", E.page_has_content(text, F.when(n % 8 == 0, 1).otherwise(0), F.when(n % 9 == 0, 2).otherwise(0)).alias("has_content"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'staging' END AS status, o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE AS stale FROM orders),
j AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 2 = 0), f AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT id, CASE WHEN status IN ('queued', 'running') AND id IN (SELECT id FROM f) THEN 'failed_execution' WHEN status = 'queued' AND stale AND id NOT IN (SELECT id FROM j) THEN 'orphaned' WHEN status = 'staging' AND stale THEN CASE WHEN id IN (SELECT id FROM j) THEN 'adopt' ELSE 'fail' END END AS action
FROM r WHERE action IS NOT NULL""")
def j12_reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id"), F.concat(F.lit("k"), "o_orderkey").alias("job_key"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'staging' END").alias("status"), F.col("o_orderdate").alias("updated_at"))
    items = table(spark, sf_dir, "lineitem")
    jobs = items.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("job_id")).distinct().withColumns({"job_key": F.concat(F.lit("k"), "job_id"), "arguments": F.lit("")})
    return lifecycle.reconciled(records, jobs, items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")).distinct(), F.expr("TIMESTAMP '1998-01-01'"))
