"""Queries on sources, candidate documents, checks of shape, and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import islands, lifecycle, relational
from ..sources import candidate, pdf_streams, sinks
from ..sources import testdata as T
from ..sources.testdata import BOXES_SQL, REGIONS_SQL, table
from .registry import query


def _documents(spark, sf_dir):
    """A candidate document for each conversation: every turn is a text, every third one a formula, with none to two provenances."""
    turn = F.col("turn")
    box = F.struct(F.lit(10.0).alias("l"), F.lit(700.0).alias("t"), F.lit(90.0).alias("r"), F.lit(650.0).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    prov = lambda page: F.struct(page.cast("int").alias("page_no"), box.alias("bbox"), F.array(F.lit(0), F.length("text")).alias("charspan"))
    none = F.array(prov(turn + 1)).cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>,charspan:array<int>>>")
    provs = F.when(turn % 4 == 1, F.slice(none, 1, 0)).when(turn % 4 == 3, F.array(prov(turn + 1), prov(turn + 2))).otherwise(F.array(prov(turn + 1)))
    text = F.struct(
        F.concat(F.lit("#/texts/"), turn.cast("string")).alias("self_ref"), F.when(turn % 3 == 0, "formula").otherwise("text").alias("label"), F.concat(F.lit("$x$ "), "text").alias("text"), F.col("text").alias("orig"),
        F.when(turn % 5 == 4, "furniture").alias("content_layer"), provs.alias("prov"),
    )
    page = F.struct((turn + 1).cast("int").alias("page_no"), F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).alias("size"), F.struct(F.lit("data:image/png;base64,").alias("uri")).alias("image"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(turn, text.alias("t"), page.alias("p")))).alias("g"))
    pages = F.map_from_entries(F.transform("g", lambda g: F.struct((g["turn"] + 1).cast("string").alias("k"), g["p"].alias("v"))))
    body = held.select("conv_id", F.to_json(F.struct(F.lit("doc").alias("name"), pages.alias("pages"), F.transform("g", lambda g: g["t"]).alias("texts"))).alias("json"))
    return candidate.parsed(body, "json").select("conv_id", "document")


@query("""WITH c AS (SELECT conv_id, turn, '#/texts/' || turn AS ref, '$x$ ' || text AS t FROM conversations WHERE turn % 3 = 0)
SELECT conv_id, CASE WHEN turn % 4 = 3 THEN ref || ':' || i ELSE ref END AS region_id, CASE WHEN turn % 4 <> 1 THEN CAST(turn + 1 + i AS INTEGER) END AS page, t AS text, CASE WHEN turn % 4 = 1 THEN 'formula_provenance_missing' END AS reason
FROM c, range(0, 2) r(i) WHERE i = 0 OR turn % 4 = 3""")
def a19_a20_formula_regions(spark, sf_dir):
    return candidate.formula_regions(_documents(spark, sf_dir), "conv_id").select("conv_id", "region_id", "page", "text", "reason")


@query("""SELECT conv_id, '#/texts/' || turn || ':inline:0' AS region_id, CASE WHEN turn % 4 IN (0, 2) THEN CAST(turn + 1 AS INTEGER) END AS page,
  CASE WHEN turn % 4 IN (0, 2) THEN 'inline_math_bbox_unavailable' ELSE 'inline_math_provenance_ambiguous' END AS reason FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 4 AND NOT contains(text, '$')""")
def a21_k24_inline_regions(spark, sf_dir):
    rows = candidate.inline_regions(_documents(spark, sf_dir), "conv_id").select("conv_id", "region_id", "page", "reason", "ref")
    plain = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("$"))).select("conv_id", F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("ref"))
    return rows.join(plain, ["conv_id", "ref"], "left_semi").drop("ref")


@query("""SELECT conv_id, count(*) FILTER ((turn % 4 <> 1 AND turn = 2) OR (turn % 4 = 3 AND turn = 1)) AS n, max(turn) >= 2 AS has_page FROM conversations GROUP BY conv_id""")
def a42_a43_page_projection(spark, sf_dir):
    return candidate.on_page(_documents(spark, sf_dir), 3).select("conv_id", F.coalesce(F.size("texts"), F.lit(0)).cast("long").alias("n"), F.col("page").isNotNull().alias("has_page"))


@query("""SELECT conv_id, max(turn) + 1 = count(DISTINCT turn) AS pages_valid, bool_and(turn % 4 <> 1 AND (turn % 4 <> 3 OR turn + 1 <= m)) AS items_valid FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id""")
def b33_b34_valid_documents(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("conv_id", candidate.pages_valid(F.col("document.pages")).alias("pages_valid"), candidate.items_valid(F.col("document.texts"), F.col("document.pages")).alias("items_valid"))


_LINE = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, {_LINE} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, length(t))) AS i FROM d WHERE length(t) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS sequence, substr(t, CAST(i + 1 AS BIGINT), 1) AS u, CAST(100 AS DOUBLE) AS y FROM c""")
def a02_a05_content_streams(spark, sf_dir):
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    content = F.concat(F.lit("q 1 0 0 1 0 0 cm BT /F1 10 Tf 1 0 0 1 50 700 Tm ("), t, F.lit(") Tj ET Q")).cast("binary")
    fonts = {"/F1": {"width": 1, "map": {c: chr(c) for c in range(32, 127)}}}
    pages = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return pdf_streams.glyph_rows(pages, ["doc_id"], fonts, 800.0).where("sequence IS NOT NULL").select("doc_id", "sequence", "u", "y")


@query("""SELECT turn % 3 = 0 AS broken, count(*) AS n, count(*) FILTER (turn % 3 <> 0) AS readable, max(CASE WHEN turn % 3 = 0 THEN 'checkpoint_unreadable' END) AS reason FROM conversations GROUP BY 1""")
def a32_recovered_lines(spark, sf_dir):
    line = F.to_json(F.struct("conv_id", "turn"))
    lines = table(spark, sf_dir, "conversations").select((F.col("turn") % 3 == 0).alias("broken"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("{oops"), line)).otherwise(line).alias("line"))
    read = sinks.recovered(lines, "line", "conv_id long, turn long")
    return read.groupBy("broken").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("readable"), F.max("reason").alias("reason"))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT id, page, y0, CASE WHEN id % 3 = 0 THEN y0 ELSE y1 END AS ye, least(x0, x1) AS l, greatest(x0, x1) AS r, id % 2 + 1 AS segments FROM boxes) SELECT id, l AS "left", r AS "right", CAST(y0 AS DOUBLE) AS y FROM s WHERE segments = 1 AND y0 = ye""")
def a07_horizontal_rules(spark, sf_dir):
    b = T.boxes(spark, sf_dir)
    strokes = b.select("id", "x0", "x1", "y0", F.when(F.col("id") % 3 == 0, F.col("y0")).otherwise(F.col("y1")).alias("y1"), (F.col("id") % 2 + 1).alias("segments"))
    return pdf_streams.horizontal_rules(strokes).select("id", "left", "right", F.col("y").cast("double").alias("y"))


@query("""WITH c AS (SELECT event_id AS id, user_id % 5 AS page, event_type AS font, event_id % 7 AS k, CASE WHEN event_id % 4 = 0 THEN -1 ELSE 5 END AS gid FROM events),
t AS (SELECT a.id FROM c a JOIN c b ON a.gid = -1 AND b.gid <> -1 AND a.page = b.page AND a.font = b.font AND a.k = b.k AND a.id // 40 = b.id // 40 GROUP BY a.id HAVING count(*) = 1) SELECT id FROM c WHERE id NOT IN (SELECT id FROM t)""")
def a06_synthetic_twins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    box = F.floor(F.col("event_id") / 40).cast("double")
    chars = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("page"), F.col("event_type").alias("font"), (F.col("event_id") % 7).alias("seqno"), F.lit("x").alias("u"), F.lit(0.0).alias("origin_x"), F.lit(0.0).alias("origin_y"), F.lit(1.0).alias("size"), F.when(F.col("event_id") % 4 == 0, -1).otherwise(5).alias("gid"), *[box.alias(c) for c in ("x0", "y0", "x1", "y1")])
    return pdf_streams.without_synthetic_twins(chars).select("id")


@query(f"""WITH {REGIONS_SQL} SELECT count(*) AS regions, count(DISTINCT page) AS pages, count(*) FILTER (semantic = 'established') AS established, count(DISTINCT CASE WHEN verdict = 'contradicted' THEN page * 10 + region_id % 10 END) AS contradicted_keys, CAST(coalesce(sum(region_id % 7) FILTER (candidate = 'matching'), 0) AS BIGINT) AS matching_glyphs FROM regions""")
def d03_d04_coverage(spark, sf_dir):
    r = T.regions(spark, sf_dir)
    key = F.col("page") * 10 + F.col("region_id") % 10
    return r.agg(F.count(F.lit(1)).alias("regions"), F.count_distinct("page").alias("pages"), F.count_if(F.col("semantic") == "established").alias("established"), F.count_distinct(F.when(F.col("verdict") == "contradicted", key)).alias("contradicted_keys"), F.coalesce(F.sum(F.when(F.col("candidate") == "matching", F.col("region_id") % 7)), F.lit(0)).cast("long").alias("matching_glyphs"))


@query("""SELECT p_type, count(DISTINCT p_brand) = 1 AS consistent, min(p_brand) AS brand, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY p_type""")
def d08_d27_harvested(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg((F.count_distinct("p_brand") == 1).alias("consistent"), F.min("p_brand").alias("brand"), F.array_sort(F.collect_set("p_size")).alias("sizes"))


@query("""WITH g AS (SELECT conv_id, list_sort(list(turn)) AS t, list_sort(list(turn) FILTER (role = 'user')) AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, t = list_sort(list_distinct(t)) AND list_min(t) >= 0 AS sorted_set, len(list_filter(coalesce(u, []), lambda x: x % 2 <> 0)) = 0 AS users_even, coalesce(list_filter(t, lambda x: x % 2 = 0 AND NOT list_contains(coalesce(u, []), x)), []) AS others FROM g""")
def e18_f07_g06_g09_turn_sets(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("u"))
    even = F.filter("t", lambda x: x % 2 == 0)
    return g.select("conv_id", islands.is_sorted_set(F.col("t")).alias("sorted_set"), (F.size(F.array_except("u", even)) == 0).alias("users_even"), F.array_except(even, "u").alias("others"))


@query("""SELECT p_type, arg_min(p_name, struct_pack(n := length(p_name), x := p_name)) AS shortest FROM part GROUP BY p_type""")
def f04_shortest_name(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("shortest"))


@query("""WITH l AS (SELECT conv_id, arg_max(role, turn) AS r, max(turn) AS t FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN NULL WHEN r = 'user' THEN 'queued' WHEN t < 3 THEN 'failed' ELSE 'completed' END AS a, CASE WHEN conv_id % 2 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN 'running' ELSE 'completed' END AS q, CASE WHEN conv_id % 3 = 0 THEN 'contradicted' ELSE 'conformant_within_scope' END AS v FROM l)
SELECT conv_id, CASE WHEN a IS NULL THEN 'not_started' WHEN a = 'queued' THEN 'conversion_queued' WHEN a = 'failed' THEN 'conversion_failed' WHEN q IS NULL THEN 'converted' WHEN q = 'running' THEN 'qualification_running' WHEN v = 'conformant_within_scope' THEN 'qualified' ELSE 'qualified_with_findings' END AS label FROM s""")
def h60_processing_labels(spark, sf_dir):
    last = islands.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn")
    c = F.col("conv_id")
    attempt = F.when(c % 9 == 0, None).when(F.col("role") == "user", "queued").when(F.col("turn") < 3, "failed").otherwise("completed")
    qualification = F.when(c % 2 == 0, None).when(c % 5 == 0, "running").otherwise("completed")
    return last.select("conv_id", lifecycle.processing_status(attempt, qualification, F.when(c % 3 == 0, "contradicted").otherwise("conformant_within_scope")).alias("label"))


@query("""WITH s AS (SELECT user_id, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS s FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id)
SELECT user_id, CASE WHEN s >= 86400 THEN (s // 86400) || ' j ' ELSE '' END || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM s""")
def i29_elapsed(spark, sf_dir):
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(G.elapsed(F.max(second) - F.min(second)).alias("elapsed"))


@query("""WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), n AS (SELECT r, count(*) AS n, min(conv_id) AS first FROM a GROUP BY r) SELECT a.conv_id, CASE WHEN n.n = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM a JOIN n ON n.r = a.r""")
def c43_sequence_matches(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    n = a.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    return a.join(n, "r").select("conv_id", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT c_custkey AS c, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1) SELECT a.id, p.n IS NOT NULL AS known FROM a LEFT JOIN p ON p.c = a.c""")
def c31_c36_c37_c41_c45_lookups(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").groupBy(F.col("c_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(known, "c", "left").select("id", F.col("n").isNotNull().alias("known"))


@query("""WITH g AS (SELECT conv_id, list(length(text) ORDER BY turn) AS a, list(length(text) - CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN 1 ELSE 0 END ORDER BY turn) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, a = b AS equal FROM g""")
def c39_c46_positional_equality(spark, sf_dir):
    value = F.length("text") - F.when((F.col("turn") == 3) & (F.col("conv_id") % 2 == 0), 1).otherwise(0)
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("v")))).alias("a"), F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))).alias("b"))
    return g.select("conv_id", relational.all_equal(F.transform("a", lambda x: x["v"]), F.transform("b", lambda x: x["v"])).alias("equal"))


@query("""SELECT doc_id, regexp_matches(source, '^src1') AND lang = 'en' AS limited, doc_id % 3 = 0 AND contains(text, 'the') AS met, coalesce(CASE WHEN doc_id % 4 = 0 THEN lang END, CASE WHEN length(text) > 500 THEN 'bbox' ELSE 'text' END) AS method FROM documents""")
def b31_b32_b35_memberships(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", (F.col("source").rlike("^src1") & (F.col("lang") == "en")).alias("limited"), (F.array_contains(F.array(F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y")), "x") & F.contains("text", F.lit("the"))).alias("met"),
        F.coalesce(F.when(F.col("doc_id") % 4 == 0, F.col("lang")), F.when(F.length("text") > 500, "bbox").otherwise("text")).alias("method"),
    )


@query(f"""WITH {BOXES_SQL} SELECT id, id % 5 <> 0 AND x0 < x1 AND y0 < y1 AS valid, CASE WHEN 500 - y1 >= 0 THEN 500 - y1 END AS top FROM boxes""")
def b36_k25_boxes_checked(spark, sf_dir):
    b = T.boxes(spark, sf_dir)
    box = F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    given = F.when(F.col("id") % 5 == 0, F.slice(box, 1, 3)).otherwise(box)
    raw = F.struct(F.col("x0").cast("double").alias("l"), F.col("y1").cast("double").alias("t"), F.col("x1").cast("double").alias("r"), F.col("y0").cast("double").alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    return b.select("id", G.valid_box(given).alias("valid"), F.element_at(candidate.top_left(raw, F.lit(500.0)), 2).cast("long").alias("top"))


@query(r"""SELECT doc_id, len(regexp_replace(text, '[^|]', '', 'g')) % 2 = 0 AS bars_even, regexp_replace(replace(text, '−', '-'), '\s+', ' ', 'g') AS normal FROM documents""")
def b06_h50_normalised(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.length(F.regexp_replace("text", "[^|]", "")) % 2 == 0).alias("bars_even"), F.regexp_replace(F.replace(F.col("text"), F.lit("−"), F.lit("-")), r"\s+", " ").alias("normal"))


@query("""WITH b AS (SELECT doc_id, replace(replace(replace(regexp_replace(text, '[a-z]', '', 'g'), 'A', '('), 'E', ')'), 'T', '[') AS t FROM documents) SELECT doc_id, length(t) AS n, length(replace(t, '(', '')) = length(t) AND length(replace(t, '[', '')) = length(t) AND length(replace(t, ')', '')) = length(t) AND length(replace(t, ']', '')) = length(t) AS plain FROM b""")
def b07_balance_inputs(spark, sf_dir):
    t = F.regexp_replace("text", "[a-z]", "")
    for a, b in (("A", "("), ("E", ")"), ("T", "[")):
        t = F.replace(t, F.lit(a), F.lit(b))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    plain = ~F.col("t").rlike(r"[()\[\]]")
    return d.select("doc_id", F.length("t").cast("long").alias("n"), (plain & X.delimiters_balanced(F.col("t"))).alias("plain"))


@query("""WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'error') SELECT user_id, event_id FROM w WHERE k <= 3""")
def f05_f02_recent_errors(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", k).where("k <= 3").select("user_id", "event_id")
