"""Queries on the elements of HTML documents and the audit of links, over ``pages.html``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived, dom
from ..sources.testdata import table
from .registry import query

# A page's html is cut at its paragraphs. Paragraph i gets a formula in front (none where i % 9 = 8, two where i % 7 = 6), and every fifth one begins a page.
_PARTS = "string_split(html, '<p>')"
PARTS_SQL = f"""parts AS (
  SELECT page_id, unnest(range(1, len({_PARTS}))) AS i, unnest({_PARTS}[2:]) AS s FROM pages
), t AS (SELECT page_id, i, regexp_replace(s, '<[^>]*>', '', 'g') AS text, i // 5 + 1 AS page, i % 4 = 1 AS corrected FROM parts),
u AS (SELECT *, CASE WHEN i % 9 = 8 THEN 0 WHEN i % 7 = 6 THEN 2 ELSE 1 END AS n FROM t)"""


def _published(spark, sf_dir):
    """The documents with formulas put in, and a row for each paragraph: page_id, i, text."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split("html", "<p>").alias("parts"))
    parts = pages.select("page_id", F.posexplode("parts").alias("i", "s")).where("i > 0").select("page_id", "i", F.regexp_replace("s", "<[^>]*>", "").alias("text"))
    length = lambda s: F.length(F.regexp_replace(s, "<[^>]*>", "")).cast("string")
    own = lambda i: F.when(i % 4 == 1, F.concat(F.lit(' data-correction-id="t'), i.cast("string"), F.lit('"'))).otherwise("")
    one = lambda s, i: F.concat(F.lit('<math data-docling-ref="#/texts/'), i.cast("string"), F.lit('" data-docling-charspan="0:'), length(s), F.lit('"'), own(i), F.lit("><mi>x</mi></math>"))
    math = lambda s, i: F.when(i % 9 == 8, "").when(i % 7 == 6, F.concat(one(s, i), one(s, i))).otherwise(one(s, i))
    anchor = lambda i: F.when(i % 5 == 0, F.concat(F.lit('</div><div class="page" id="page-'), F.floor(i / 5 + 1).cast("string"), F.lit('">'))).otherwise("")
    whole = F.array_join(F.transform("parts", lambda s, i: F.when(i == 0, F.concat(s, F.lit('<div class="page" id="page-1">'))).otherwise(F.concat(anchor(i), math(s, i), F.lit("<p>"), s))), "")
    return pages.select("page_id", whole.alias("html")), parts


def _links(spark, sf_dir):
    pages, parts = _published(spark, sf_dir)
    i = F.col("i")
    page = F.floor(i / 5 + 1) + F.when(i % 11 == 10, 1).otherwise(0)
    ref = F.concat(F.lit("#/texts/"), i.cast("string"))
    start, end = F.lit(0).alias("start"), F.length("text").alias("end")
    regions = parts.select("page_id", i.cast("string").alias("region_id"), page.alias("page"), ref.alias("ref"), start, end, "text", (i % 13 != 12).alias("linked"), F.when(i % 17 == 16, "non_verifiable").otherwise("contradicted").alias("verdict"))
    items = parts.select("page_id", ref.alias("ref"), F.when(i % 2 == 0, "formula").otherwise("text").alias("label"), F.when(i % 8 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    corrections = parts.where("i % 4 = 1").select(
        "page_id", F.concat(F.lit("t"), i.cast("string")).alias("target_id"), F.lit("accepted").alias("status"), ref.alias("ref"), start, end, F.col("text").alias("after"), F.lit(None).cast("string").alias("derived_ref"),
        F.lit(0).alias("derived_start"), F.length("text").alias("derived_end"), F.array(i.cast("string")).alias("region_ids"), F.array(F.struct(i.cast("string").alias("region_id"), start, end, F.when(i % 8 == 5, "?").otherwise(F.col("text")).alias("text"))).alias("proofs"),
    )
    return regions, items, corrections, dom.elements(pages, "page_id", "html", ["math"]), parts


@query(f"""WITH {PARTS_SQL}
SELECT page_id, CAST(i AS VARCHAR) AS region_id, corrected, CASE WHEN v THEN n END AS matches, CASE WHEN NOT v THEN 'identity_missing' WHEN n = 0 THEN 'missing' WHEN n = 2 THEN 'duplicated' WHEN i % 11 = 10 THEN 'wrong_page' ELSE 'matched' END AS status,
  CASE WHEN NOT v THEN 'linked_math_identity_missing' WHEN n = 0 THEN 'linked_math_missing' WHEN n = 2 THEN 'linked_math_duplicated' WHEN i % 11 = 10 THEN 'linked_math_page_mismatch' END AS code
FROM (SELECT *, text <> '' AND NOT (corrected AND i % 8 = 5) AS v FROM u WHERE i % 13 <> 12 AND i % 17 <> 16)""")
def c13_corrected_links(spark, sf_dir):
    regions, items, corrections, nodes, _ = _links(spark, sf_dir)
    return dom.audited_links("page_id", regions, items, corrections, nodes).select("page_id", "region_id", "corrected", "matches", "status", "code")


@query(f"""WITH {PARTS_SQL}, c AS (SELECT page_id, 't' || i AS target_id, CASE WHEN i % 8 = 5 THEN 'correction_node_unexpected' WHEN n = 0 THEN 'correction_node_missing' WHEN n = 2 THEN 'correction_node_duplicated' WHEN i % 11 = 10 THEN 'correction_page_mismatch' WHEN i % 3 = 2 THEN 'correction_markup_mismatch' END AS code FROM u WHERE corrected AND NOT (i % 8 = 5 AND n = 0))
SELECT * FROM c WHERE code IS NOT NULL""")
def c33_published_formulas(spark, sf_dir):
    pages, parts = _published(spark, sf_dir)
    i = F.col("i")
    markup = F.concat(F.lit('<math data-docling-ref="#/texts/'), i.cast("string"), F.lit('" data-docling-charspan="0:'), F.length("text").cast("string"), F.lit('" data-correction-id="t'), i.cast("string"), F.lit('"><mi>'), F.when(i % 3 == 2, "y").otherwise("x"), F.lit("</mi></math>"))
    accepted = parts.where("i % 4 = 1 AND i % 8 <> 5").select("page_id", F.concat(F.lit("t"), i.cast("string")).alias("target_id"), (F.floor(i / 5 + 1) + F.when(i % 11 == 10, 1).otherwise(0)).cast("int").alias("page"), markup.alias("markup"))
    return dom.publication_faults("page_id", accepted, dom.elements(pages, "page_id", "html", ["math"]))


@query("""WITH p AS (SELECT page_id, unnest(string_split(html, '<a href="')[2:]) AS s FROM pages)
SELECT page_id, s[: strpos(s, '"') - 1] AS href, '<a href="' || s[: strpos(s, '</a>') + 3] AS markup FROM p""")
def a37_link_elements(spark, sf_dir):
    nodes = dom.elements(table(spark, sf_dir, "pages"), "page_id", "html", ["a"])
    return nodes.select("page_id", F.col("attributes")["href"].alias("href"), "markup")


def _corrected(spark, sf_dir):
    """Each paragraph of a page is a text; its first three characters are corrected where i % 4 = 1, and i % 12 = 5 has another correction from the third on,
    i % 20 = 9 one beyond its end, i % 16 = 13 is a formula. The HTML leaves out paragraphs where i % 18 = 17, and has those of i % 36 = 1 twice."""
    _, parts = _published(spark, sf_dir)
    i = F.col("i")
    ref = F.concat(F.lit("#/texts/"), i.cast("string"))
    texts = parts.where("length(text) >= 6").select("page_id", ref.alias("ref"), F.when(i % 16 == 13, "formula").otherwise("text").alias("label"), "text")
    some = parts.where("i % 4 = 1 AND length(text) >= 6")
    one = lambda rows, name, start, end: rows.select("page_id", F.concat(F.lit(name), i.cast("string")).alias("target_id"), ref.alias("ref"), start.alias("start"), end.alias("end"), F.lit("\\alpha").alias("after"), F.lit("<math><mi>α</mi></math>").alias("mathml"))
    beyond = F.when(i % 20 == 9, F.length("text") + 1).otherwise(3)
    corrections = one(some, "a", F.lit(0), beyond).unionAll(one(some.where("i % 12 = 5"), "b", F.lit(2), F.lit(5))).unionAll(one(some.where("i % 12 = 9"), "c", F.lit(3), F.lit(4)))

    def render(marked):
        number = F.regexp_extract("ref", r"(\d+)$", 1).cast("int")
        p = F.concat(F.lit("<p>"), "text", F.lit("</p>"))
        shown = marked.select("page_id", number.alias("i"), F.when(number % 18 == 17, "").when(number % 36 == 1, F.concat(p, p)).otherwise(p).alias("p"))
        return shown.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("s")).select("page_id", F.array_join(F.transform("s", lambda x: x["p"]), "").alias("html"))

    return derived.derived("page_id", texts, corrections, render)


@query(f"""WITH {PARTS_SQL}, r AS (SELECT page_id, i, text FROM t WHERE length(text) >= 6 AND i % 4 = 1),
c AS (SELECT *, 'a' || i AS target_id, 0 AS s, CASE WHEN i % 20 = 9 THEN length(text) + 1 ELSE 3 END AS e FROM r UNION ALL SELECT *, 'b' || i, 2, 5 FROM r WHERE i % 12 = 5 UNION ALL SELECT *, 'c' || i, 3, 4 FROM r WHERE i % 12 = 9),
k AS (SELECT *, CASE WHEN e > length(text) THEN 'correction_span_invalid' WHEN i % 16 = 13 AND e - s < length(text) THEN 'correction_formula_partial' WHEN i % 12 = 5 AND i % 20 <> 9 THEN 'correction_overlap' END AS refused FROM c)
SELECT page_id, target_id, coalesce(refused, CASE WHEN i % 18 = 17 OR i % 36 = 1 THEN 'correction_not_localisable' END) AS code,
  CASE WHEN refused IS NULL THEN CAST(CASE WHEN target_id[1] = 'c' AND i % 20 <> 9 THEN s + 3 ELSE s END AS INTEGER) END AS derived_start FROM k""")
def a39_derived_loci(spark, sf_dir):
    return _corrected(spark, sf_dir)[2].select("page_id", "target_id", "code", "derived_start")


# What was put into the texts and into the documents, read back from both.
@query(f"""WITH {PARTS_SQL}, r AS (SELECT page_id, i, text FROM t WHERE length(text) >= 6 AND i % 4 = 1),
c AS (SELECT *, 'a' || i AS target_id, 0 AS s, CASE WHEN i % 20 = 9 THEN length(text) + 1 ELSE 3 END AS e FROM r UNION ALL SELECT *, 'b' || i, 2, 5 FROM r WHERE i % 12 = 5 UNION ALL SELECT *, 'c' || i, 3, 4 FROM r WHERE i % 12 = 9)
SELECT page_id, target_id, '\\alpha' AS shown, true AS alone FROM c
WHERE NOT (e > length(text) OR i % 16 = 13 AND e - s < length(text) OR i % 12 = 5 AND i % 20 <> 9 OR i % 18 = 17 OR i % 36 = 1)""")
def a39_derived_documents(spark, sf_dir):
    texts, documents, told = _corrected(spark, sf_dir)
    nodes = dom.elements(documents, "page_id", "html", ["math"]).select("page_id", F.col("attributes")[dom.CORRECTION].alias("target_id"), F.col("attributes")[dom.SPAN].alias("span"), F.col("attributes")[dom.REF].alias("ref"))
    met = told.where("code IS NULL").withColumn("span", F.concat_ws(":", "derived_start", "derived_end")).join(nodes, ["page_id", "target_id", "span", "ref"]).join(texts, ["page_id", "ref"])
    shown = F.substring(F.col("text"), F.col("derived_start") + 1, F.col("derived_end") - F.col("derived_start"))
    return met.groupBy("page_id", "target_id").agg(F.max(shown).alias("shown"), (F.count("*") == 1).alias("alone"))
