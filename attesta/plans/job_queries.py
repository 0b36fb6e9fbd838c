"""Queries on the job as one plan, and on the checks of its inputs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, corrections, job, metrics, spatial
from ..sources import cmaps, sinks
from ..sources import testdata as T
from ..sources.testdata import BOXES_SQL, table
from .geometry_queries import _INTER, _TOUCH
from .registry import query


def _evidence(spark, sf_dir):
    """Pages of 500 x 800, every second one at half size in the candidate; oracle boxes are regions, the others glyphs of one letter."""
    boxes = T.boxes(spark, sf_dir)
    page = F.col("page")
    half = F.when(page % 2 == 0, 2.0).otherwise(1.0)
    pages = boxes.select("page").distinct().select(
        "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(800.0).alias("y1"), (500.0 / half).alias("width"), (800.0 / half).alias("height"),
        F.when(page % 7 == 0, 90).otherwise(0).alias("rotation"), F.when(page % 11 == 0, 2).otherwise(1).alias("n_layers"),
    )
    letter = lambda n: F.substring(F.lit("abcdefgh"), (n % 8 + 1).cast("int"), F.lit(1))
    own = [(F.col(c) / half).alias(c) for c in ("x0", "y0", "x1", "y1")]
    regions = boxes.where("role = 'oracle'").select(
        "page", "id", *own, F.when(F.col("id") % 13 == 0, "formula_provenance_missing").alias("reason"),
        F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(letter(F.col("id")))).alias("candidate_tokens"),
    )
    glyphs = boxes.where("role = 'candidate'").select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], letter(F.floor(F.col("id") / 3)).alias("u"))
    return pages, regions, glyphs


REPORT_SQL = f"""{BOXES_SQL}, pg AS (
  SELECT page, CASE WHEN page % 7 = 0 THEN 'unsupported' WHEN page % 11 = 0 THEN 'ambiguous' ELSE 'traced' END AS status,
    CASE WHEN page % 7 = 0 THEN 'page_rotation_unsupported' WHEN page % 11 = 0 THEN 'page_text_layers_ambiguous' END AS code FROM (SELECT DISTINCT page FROM boxes)
), p AS (
  SELECT b.page, b.id AS glyph, a.id, (b.x0 + b.x1) / 2.0 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2.0 BETWEEN a.y0 AND a.y1
      AND CAST({_INTER} AS DOUBLE) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5 AS owns
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.role = 'oracle' AND b.role = 'candidate' AND {_TOUCH}
), o AS (SELECT *, count(*) FILTER (owns) OVER (PARTITION BY page, glyph) AS n FROM p),
m AS (
  SELECT page, id, coalesce(list(substr('abcdefgh', glyph // 3 % 8 + 1, 1) ORDER BY glyph) FILTER (owns AND n = 1), []) AS tokens, count(*) FILTER (owns AND n > 1) AS mult, count(*) FILTER (NOT owns AND n = 0) AS bound FROM o GROUP BY 1, 2
), r AS (
  SELECT b.page, b.id, coalesce(len(m.tokens), 0) AS n_glyphs, coalesce(m.tokens, []) AS source_tokens, CASE WHEN b.id % 5 = 0 THEN [] ELSE [substr('abcdefgh', b.id % 8 + 1, 1)] END AS cand,
    CASE WHEN b.id % 13 = 0 THEN 'unsupported' WHEN pg.status <> 'traced' THEN 'page_not_traced' WHEN coalesce(mult, 0) > 0 THEN 'ambiguous' WHEN coalesce(bound, 0) > 0 THEN 'boundary'
      WHEN coalesce(len(m.tokens), 0) = 0 THEN 'missing' ELSE 'traced' END AS status
  FROM boxes b JOIN pg ON pg.page = b.page LEFT JOIN m ON m.page = b.page AND m.id = b.id WHERE b.role = 'oracle'
), s AS (SELECT *, CASE status WHEN 'ambiguous' THEN 'ambiguous' WHEN 'traced' THEN 'established' ELSE 'not_established' END AS semantic FROM r),
c AS (
  SELECT *, CASE WHEN semantic <> 'established' OR len(cand) = 0 THEN 'not_evaluated' WHEN cand = source_tokens THEN 'matching' WHEN list_contains(source_tokens, cand[1]) THEN 'missing' ELSE 'contradicting' END AS candidate_status FROM s
), report AS (
  SELECT page, id, status, CAST(n_glyphs AS INTEGER) AS n_glyphs, source_tokens, semantic, candidate_status,
    CASE WHEN candidate_status IN ('missing', 'contradicting') THEN 'contradicted' WHEN candidate_status = 'matching' THEN 'conformant_within_scope' ELSE 'non_verifiable' END AS verdict FROM c
)"""


@query(f"WITH {REPORT_SQL} SELECT * FROM report")
def a01_c03_c11_k22_report(spark, sf_dir):
    return job.report(*_evidence(spark, sf_dir))


@query(f"""WITH {REPORT_SQL} SELECT pg.page, pg.status, pg.code, count(r.id) AS regions, count(*) FILTER (verdict = 'conformant_within_scope') AS conformant_within_scope,
  count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'non_verifiable') AS non_verifiable FROM pg LEFT JOIN report r ON r.page = pg.page GROUP BY 1, 2, 3""")
def a03_a10_b24_b25_page_reports(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    return job.summary(job.report(*evidence), job.page_reports(evidence[0]))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(user_id % 10 AS INTEGER) END AS given, CASE WHEN event_id % 4 = 0 AND user_id % 10 <= 7 THEN CAST(user_id % 10 AS INTEGER) END AS mode, event_id % 3 = 0 AS six FROM events""")
def i08_i10_operands(spark, sf_dir):
    e, n = F.col("event_id"), (F.col("user_id") % 10).cast("string")
    operands = F.when(e % 4 == 0, F.array(n)).when(e % 4 == 1, F.array(n, n)).when(e % 4 == 2, F.array(F.concat(n, F.lit(".5")))).otherwise(F.array(F.lit("/N")))
    values = F.when(e % 3 == 0, F.sequence(F.lit(1), F.lit(6))).when(e % 3 == 1, F.sequence(F.lit(1), F.lit(5))).otherwise(F.array(*[F.when(e < 0, 1)] * 6))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", operands.alias("operands"), values.alias("values"))
    return rows.select("event_id", F.when(e % 4 == 0, (F.col("user_id") % 10).cast("int")).alias("given"), checks.rendering_mode(F.col("operands")).alias("mode"), checks.matrix(F.col("values")).isNotNull().alias("six"))


@query("""SELECT o_orderkey, list(coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END, '-') || '/' || l_linenumber % 2 || '/' || l_linestatus ORDER BY coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END, ''), l_linenumber % 2, l_linestatus) AS reasons
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def i25_sorted_reasons(spark, sf_dir):
    reason = F.struct(F.col("l_quantity").alias("page"), F.col("l_linestatus").alias("message"), (F.col("l_linenumber") % 2).cast("string").alias("code"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("font_resource"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(reason).alias("reasons"))
    shown = F.transform(checks.canonical_reasons(F.col("reasons")), lambda r: F.concat_ws("/", F.coalesce(r["font_resource"], F.lit("-")), r["code"], r["message"]))
    return held.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", shown.alias("reasons"))


@query("""WITH g AS (SELECT l_orderkey, list(l_suppkey) AS s, count(*) AS n, list(DISTINCT l_suppkey) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(a) = n AND l_orderkey % 3 <> 0 AND (l_orderkey % 4 <> 0 OR len(a) = 0) AS valid FROM g""")
def g07_selected_regions(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"), F.count(F.lit(1)).alias("n"))
    wanted = F.col("n") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    known = F.when(F.col("l_orderkey") % 4 == 0, F.array_except(F.array_distinct("s"), F.slice("s", 1, 1))).otherwise(F.array_distinct("s"))
    return held.select("l_orderkey", checks.selection_valid(F.col("s"), known, wanted).alias("valid"))


@query("""SELECT conv_id, max(turn) + 1 = count(*) AND count(*) = count(DISTINCT turn) AND (conv_id % 3 <> 0 OR count(*) < 2) AS in_order FROM conversations GROUP BY conv_id""")
def f08_page_anchors(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    named = F.transform("t", lambda t: F.concat(F.lit("page-"), (t + 1).cast("string")))
    anchors = F.concat(F.array(F.lit("top")), F.when(F.col("conv_id") % 3 == 0, F.reverse(named)).otherwise(named))
    return held.select("conv_id", checks.anchors_in_order(anchors, F.sequence(F.lit(1).cast("long"), (F.array_max("t") + 1).cast("long"))).alias("in_order"))


@query("""SELECT doc_id, CASE WHEN strlen(text) > 1500 THEN 'event_too_large' END AS code, 'progress' AS "type", lang AS phase, CASE WHEN doc_id % 6 = 0 THEN 429 WHEN doc_id % 5 = 0 THEN 408 WHEN strlen(text) > 3000 THEN 413 WHEN lang IS NULL OR lang <> 'en' THEN 422 ELSE 200 END AS status
FROM documents WHERE text IS NOT NULL""")
def j04_j05_j07_admission(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    size, i = F.octet_length("text"), F.col("doc_id")
    event = checks.progress_event(F.col("lang"), i, i)
    status = checks.admission((i % 6 == 0).cast("int"), 1, F.when(i % 5 == 0, 9.0).otherwise(1.0), 5.0, size, 3000, F.col("lang") == "en")
    return d.select("doc_id", checks.event_limit(size, 1500).alias("code"), event["type"].alias("type"), event["phase"].alias("phase"), status.alias("status"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(replace(text, '\', ''), '[aeiou]', '$', 'g') AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?s)\$\$.*?\$\$|\$[^$]+\$'), lambda x: regexp_replace(CASE WHEN starts_with(x, '$$') THEN substr(x, 3, length(x) - 4) ELSE substr(x, 2, length(x) - 2) END, '^\s+|\s+$', '', 'g')) AS f FROM d)
SELECT doc_id, list_filter(f, lambda x: x <> '') AS formulas FROM m""")
def h54_extracted_math(spark, sf_dir):
    t = F.regexp_replace(F.replace(F.col("text"), F.lit("\\"), F.lit("")), "[aeiou]", r"\$")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", checks.extracted_math(t).alias("formulas"))


@query("""WITH g AS (SELECT l_orderkey AS k, min(l_partkey) AS g0, max(l_partkey + l_quantity) AS g1 FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, CAST(o_orderkey % 300 AS DOUBLE) AS x0, o_orderkey % 300 + 100.0 AS x1, o_orderkey % 5 * 1.0 AS w FROM orders)
SELECT k, x0 <= g0 + least(greatest(0.1, w), (g1 - g0) * CAST(0.2 AS DOUBLE)) AND x1 >= g1 - least(greatest(0.1, w), (g1 - g0) * CAST(0.2 AS DOUBLE)) AS covers,
  x0 >= g0 - least(greatest(1.0, w * 2), (g1 - g0) * 0.25) AND x1 <= g1 + least(greatest(1.0, w * 2), (g1 - g0) * 0.25) AS fits FROM r JOIN g USING (k)""")
def d15_d16_rule_spans(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    glyphs = l.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").cast("double").alias("x0"), (F.col("l_partkey") + F.col("l_quantity")).cast("double").alias("x1"))
    at = F.col("o_orderkey") % 300
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), at.cast("double").alias("x0"), (at + 100.0).alias("x1"), (F.col("o_orderkey") % 5).cast("double").alias("width"))
    return checks.rule_against_glyphs(rules, glyphs, ["k"])


@query("""WITH n AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS page, min(l_returnflag) AS markup FROM lineitem WHERE l_linenumber % 2 = 0 AND l_quantity > 20 GROUP BY 1)
SELECT o_orderkey AS target_id, CASE WHEN n IS NULL THEN 'correction_missing' WHEN n > 1 THEN 'correction_repeated' WHEN page <> 2 THEN 'correction_page_differs' WHEN markup <> 'A' THEN 'correction_markup_differs' END AS code FROM orders LEFT JOIN n ON k = o_orderkey""")
def c33_published_corrections(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0 AND l_quantity > 20").select(F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("markup"))
    accepted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.lit(2).alias("page"), F.lit("A").alias("markup"))
    return checks.publication(accepted, nodes, ["target_id"])


@query("""SELECT l_orderkey, count(*) AS n, bool_and(l_discount < 0.08) AS applicable, CASE WHEN NOT bool_and(l_discount < 0.08) THEN 'region_not_exact' END AS reason FROM lineitem GROUP BY 1""")
def k26_applicable_targets(spark, sf_dir):
    return checks.applicable(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") < 0.08)


@query("""SELECT conv_id, count(*) FILTER (turn % 3 = 1 AND role = 'user') AS n FROM conversations GROUP BY conv_id""")
def c22_links_on_page(spark, sf_dir):
    page = F.struct(F.lit("page").alias("key"), (F.col("turn") % 3).cast("string").alias("value"))
    detail = F.map_from_entries(F.when(F.col("role") == "user", F.array(page, F.struct(F.lit("link_status").alias("key"), F.lit(None).cast("string").alias("value")))).otherwise(F.array(page)))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(detail).alias("details"))
    return held.select("conv_id", F.size(checks.links_on_page(F.col("details"), 1)).cast("long").alias("n"))


@query("""SELECT conv_id, CASE WHEN bool_and(turn % 7 <> 5) THEN string_agg(text, chr(10) ORDER BY turn) END AS text, coalesce(list(conv_id || '/' || turn ORDER BY conv_id || '/' || turn) FILTER (turn % 7 = 5), []) AS missing FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def a49_concatenated_parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return checks.concatenated(c.select("conv_id", F.col("turn").alias("position"), path.alias("path")), c.where("turn % 7 <> 5").select(path.alias("path"), "text"), "conv_id")


@query("""SELECT o_orderstatus, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey) GROUP BY 1""")
def d30_active_jobs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    active = checks.active_jobs(jobs, l.where("l_returnflag = 'A'"), l.where("l_quantity > 45"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")))
    return active.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, doc_id % 4 < 2 AS same FROM documents WHERE source IS NOT NULL""")
def i23_same_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    i = F.col("doc_id")
    left = F.to_json(F.struct(F.col("source").alias("$ref"), F.array(F.lit(1), F.lit(2)).alias("span"), i.alias("n")))
    right = (
        F.when(i % 4 < 2, F.to_json(F.struct(i.alias("n"), F.array(F.lit(1), F.lit(2)).alias("span"), F.col("source").alias("cref"))))
        .when(i % 4 == 2, F.to_json(F.struct(i.cast("double").alias("n"), F.array(F.lit(1), F.lit(2)).alias("span"), F.col("source").alias("cref"))))
        .otherwise(F.to_json(F.struct(i.alias("n"), F.array(F.lit(2), F.lit(1)).alias("span"), F.col("source").alias("cref"))))
    )
    return d.select("doc_id", checks.same_value_udf(left, right).alias("same"))


@query("""WITH l AS (SELECT event_id, event_type AS t, CAST(event_id AS VARCHAR) AS i, event_id % 3 AS k FROM events)
SELECT event_id, 'crop.png' AS name, 'png' || i AS content FROM l UNION ALL SELECT event_id, 'request.json', '"' || t || '"' FROM l
UNION ALL SELECT event_id, CASE k WHEN 0 THEN 'response.json' ELSE 'response.bin' END, CASE k WHEN 0 THEN '{}' ELSE 'raw' || i END FROM l WHERE k < 2""")
def a26_a27_lookup_files(spark, sf_dir):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    lookups = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("png"), i).cast("binary").alias("image"), F.concat(F.lit('"'), "event_type", F.lit('"')).cast("binary").alias("request"),
        F.when(k == 0, F.lit("{}").cast("binary")).alias("response"), F.when(k == 1, F.concat(F.lit("raw"), i).cast("binary")).alias("raw"),
    )
    return sinks.lookup_files(lookups, "event_id").select("event_id", "name", F.col("content").cast("string").alias("content"))


@query("""SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'to_unicode_cmap_invalid' WHEN 2 THEN 'to_unicode_cmap_unsupported' WHEN 3 THEN 'to_unicode_cmap_invalid' WHEN 4 THEN 'to_unicode_cmap_invalid' WHEN 5 THEN 'to_unicode_cmap_unsupported'
  WHEN 6 THEN 'to_unicode_cmap_invalid' WHEN 7 THEN 'to_unicode_cmap_invalid' WHEN 8 THEN 'to_unicode_cmap_unsupported' END AS code, event_id % 12 = 9 AS wide_codespace,
  CASE WHEN event_id % 12 IN (0, 9, 10, 11) THEN 2 + CASE WHEN event_id % 12 = 10 THEN 0 ELSE user_id % 4 END END AS n_codes FROM events""")
def a17_a18_checked_maps(spark, sf_dir):
    k = F.col("event_id") % 12
    high = F.lpad(F.hex(F.col("user_id") % 4 + 0x50), 2, "0")
    pick = lambda default, **cases: F.coalesce(*[F.when(k == int(i[1:]), v if not isinstance(v, str) else F.lit(v)) for i, v in cases.items()], F.lit(default))
    space = pick("1 begincodespacerange <00> <ff> endcodespacerange ", k7="1 begincodespacerange <00> <10> endcodespacerange ", k9="1 begincodespacerange <0000> <00ff> endcodespacerange ", k11="")
    chars = pick("1 beginbfchar <41> <03B1> endbfchar ", k1="2 beginbfchar <41> <03B1> endbfchar ", k3="2 beginbfchar <41> <03B1> <41> <03B2> endbfchar ", k4="1 beginbfchar <41> <> endbfchar ", k5="1 beginbfchar <0041> <03B1> endbfchar ", k6="1 beginbfchar <41> <D800> endbfchar ", k10="2 beginbfchar <41> <D835DC00> <42> <03B1> endbfchar ")
    span = F.when(k == 2, F.concat(F.lit("1 beginbfrange <50> <"), high, F.lit("> [<0061>] endbfrange"))).when(k == 8, "/Base usecmap").when(k == 10, "").otherwise(F.concat(F.lit("1 beginbfrange <50> <"), high, F.lit("> <0061> endbfrange")))
    maps = table(spark, sf_dir, "events").select("event_id", F.concat(space, chars, span).alias("map"))
    return cmaps.checked(maps, "event_id", "map", 1, simple=True)


@query(f"""WITH {BOXES_SQL}, t AS (
  SELECT page, id, CASE page % 4 WHEN 0 THEN x0 WHEN 1 THEN 800 - y1 WHEN 2 THEN 500 - x1 ELSE y0 END AS x0, CASE page % 4 WHEN 0 THEN y0 WHEN 1 THEN x0 WHEN 2 THEN 800 - y1 ELSE 500 - x1 END AS y0,
    CASE page % 4 WHEN 0 THEN x1 WHEN 1 THEN 800 - y0 WHEN 2 THEN 500 - x0 ELSE y1 END AS x1, CASE page % 4 WHEN 0 THEN y1 WHEN 1 THEN x1 WHEN 2 THEN 800 - y0 ELSE 500 - x0 END AS y1
  FROM boxes WHERE role = 'oracle'
), m AS (
  SELECT b.page, b.id, count(*) AS n, bool_or(a.id % 3 = b.id % 3) AS exact FROM boxes a JOIN t b ON a.page = b.page AND a.role = 'candidate'
    AND (b.x0 + b.x1) / 2.0 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2.0 BETWEEN a.y0 AND a.y1 GROUP BY 1, 2
) SELECT t.page, t.id, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS detected, coalesce(exact, false) AS exact FROM t LEFT JOIN m USING (page, id)""")
def c38_rotated_containment(spark, sf_dir):
    boxes = T.boxes(spark, sf_dir)
    pages = boxes.select("page").distinct().select("page", (F.col("page") % 4 * 90).alias("angle"), F.lit(500).alias("width"), F.lit(800).alias("height"))
    return spatial.detected(boxes.where("role = 'oracle'"), boxes.where("role = 'candidate'"), pages, F.col("l_id") % 3 == F.col("r_id") % 3)


@query("""SELECT user_id, 'event_type' AS kind, event_type AS value, count(*) AS n FROM events GROUP BY 1, 3
UNION ALL SELECT user_id, 'k', CAST(event_id % 7 AS VARCHAR), count(*) FROM events WHERE event_id % 7 <> 3 GROUP BY 1, 3""")
def d07_font_and_operator_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 7 != 3, F.col("event_id") % 7).alias("k"))
    return metrics.usage(rows, "user_id", "event_type", "k")


def _lookup(request: str) -> str:
    """A stand-in for a model: an answer to most requests, an error to some."""
    if request.endswith("7"):
        raise TimeoutError(request)
    return request[::-1]


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS r, o_orderkey % 5 = 0 AS proven, o_orderkey % 11 = 0 AS ineligible FROM orders)
SELECT id, CASE WHEN NOT proven AND r LIKE '%7' THEN 'TimeoutError' END AS failure,
  CASE WHEN ineligible THEN 'rejected' WHEN NOT proven AND r LIKE '%7' THEN 'failed' WHEN proven OR reverse(r) = r THEN 'accepted' ELSE 'rejected' END AS outcome FROM o""")
def k20_k21_l01_correction_outcomes(spark, sf_dir):
    i = F.col("o_orderkey")
    targets = table(spark, sf_dir, "orders").select(i.alias("id"), i.cast("string").alias("request"), F.when(i % 5 == 0, i.cast("string")).alias("proven"), F.when(i % 11 == 0, "source_not_established").alias("ineligible"))
    tried = corrections.proposals(targets, _lookup)
    return tried.select("id", "failure", corrections.outcome(F.col("ineligible"), F.col("proposal"), F.col("failure"), F.col("proposal") == F.col("request")).alias("outcome"))


@query("""SELECT p_partkey, substr(p_brand || p_name, 1, 24) AS family, CASE WHEN p_partkey % 3 <> 0 THEN sha256(p_name) END AS sha FROM part""")
def h43_h59_font_names_and_digests(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 2 == 0, "/").otherwise(""), F.when(p % 3 == 0, "ABCDEF+").otherwise(""), "p_brand", "p_name")
    digest = F.upper(F.sha2("p_name", 256))
    return table(spark, sf_dir, "part").select("p_partkey", X.font_family(name).alias("family"), X.valid_sha256(F.when(p % 3 == 0, F.substring(digest, 1, 63)).otherwise(digest)).alias("sha"))
