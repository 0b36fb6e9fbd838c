"""The job with its semantic half: regions of a few glyphs with scripts, each in a case of its own, against LaTeX candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import job, semantics
from ..sources.testdata import table
from .registry import query

#: Texts of the glyph names that occur in the made regions.
NAMES = {"alpha": "α", "bracketlefttp": "["}


def _made(spark, sf_dir):
    """Each order k is a region of three letters and a script, by twenties on pages of 400 x 400, every second one at half size in the candidate.

    k % 17 = 3: the script is read before the letters; k % 19 = 4: another glyph is rendered; k % 23 = 5: the first glyph is a piece of a
    delimiter; k % 29 = 6: its text is a control character; k % 31 = 7: another character is rendered; k % 37 = 8: so it is, but the font names the glyph.
    k % 3 says whether the script stands above (0) or below, k % 8 how the candidate differs.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    page, slot = F.floor(k / 20), k % 20
    half = F.when(page % 2 == 1, 2.0).otherwise(1.0)
    pages = o.select(page.alias("page"), half.alias("h")).distinct().select("page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(400.0).alias("y1"), (400 / F.col("h")).alias("width"), (400 / F.col("h")).alias("height"), F.when(F.col("page") % 13 == 12, 90).otherwise(0).alias("rotation"), F.lit(1).alias("n_layers"))
    pages = pages.unionAll(pages.where("page % 5 = 0"))  # given twice
    letter = lambda n: F.substring(F.lit("abcdefgh"), (n % 8 + 1).cast("int"), F.lit(1))
    named = (k % 37 == 8) & (F.col("j") == 0)
    fragment = (k % 23 == 5) & (F.col("j") == 0)
    u = F.when(named, "α").when(fragment, "[").when(F.col("j") < 3, letter(k + F.col("j"))).otherwise((k % 10).cast("string"))
    above = k % 3 == 0
    small = F.col("j") == 3
    y = (slot * 20).cast("double")
    glyphs = o.select("k", F.explode(F.array(*map(F.lit, range(4)))).alias("j")).select("k", "j", page.alias("page"), (k * 4 + F.col("j")).alias("id"), u.alias("u")).select(
        "page", "id", "u", F.when(named, "alpha").when(fragment, "bracketlefttp").otherwise(F.col("u")).alias("name"), F.when((k % 29 == 6) & (F.col("j") == 0), "to_unicode").otherwise("agl").alias("method"),
        F.when((k % 29 == 6) & (F.col("j") == 0), F.lit("\x01")).when((k % 31 == 9) & (F.col("j") == 1), F.lit("\x02")).when(F.col("j") == 2, F.lit(None)).otherwise(F.col("u")).alias("to_unicode"),
        F.when(((k % 31 == 7) & (F.col("j") == 1)) | named, "?").otherwise(F.col("u")).alias("rendered_u"), F.lit(7).alias("gid"), F.when((k % 19 == 4) & (F.col("j") == 2), 8).otherwise(7).alias("rendered_gid"),
        F.array(F.lit("alpha"), F.lit("bracketlefttp")).alias("evidence"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.when((k % 17 == 3) & small, -1).otherwise(F.col("j")).alias("char"),
        F.when(small, 5.0).otherwise(10.0).alias("size"), F.when(~small, y + 14).when(above, y + 8).otherwise(y + 17).alias("oy"), (F.col("j") * 10 + 20).cast("double").alias("x0"), F.when(~small, y + 5).when(above, y + 3).otherwise(y + 12).alias("y0"),
        (F.col("j") * 10 + 29).cast("double").alias("x1"), F.when(~small, y + 15).when(above, y + 8).otherwise(y + 17).alias("y1"),
    )
    a, b, c, d = F.when(k % 37 == 8, "\\alpha ").when(k % 23 == 5, "[").otherwise(letter(k)), letter(k + 1), letter(k + 2), (k % 10).cast("string")
    script = lambda up: F.concat(F.when(up, "^{").otherwise("_{"), d, F.lit("}"))
    right = F.concat(a, b, c, script(above))
    text = (
        F.when(k % 8 == 1, F.concat(b, c, script(above))).when(k % 8 == 2, F.concat(a, b, F.lit("z"), script(above))).when(k % 8 == 3, F.concat(a, b, c, script(~above))).when(k % 8 == 4, F.concat(a, b, F.lit("\\frac{"), c))
        .when(k % 8 == 5, " ").when(k % 8 == 6, F.concat(a, b, c, d)).otherwise(right)
    )
    regions = o.select(
        page.alias("page"), k.alias("id"), *[(v / half).alias(n) for n, v in (("x0", F.lit(15.0)), ("y0", y), ("x1", F.lit(65.0)), ("y1", y + 19))], F.when(k % 11 == 10, "formula_provenance_missing").alias("reason"),
        F.when(k % 22 == 10, F.array(F.lit("pdf_page_partially_traced"))).alias("limitations"), text.alias("candidate_text"), F.lit("latex").alias("candidate_format"),
        F.when(k % 16 == 4, "unlinked").otherwise("linked").alias("link_status"), F.when(k % 16 == 5, "docling_text_alignment_incomplete").alias("link_reason"), F.lit(None).cast("array<struct<x0:double,x1:double,y:double,width:double>>").alias("rules"),
    )
    return pages, regions, glyphs


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 20 AS page, o_orderkey % 3 = 0 AS above FROM orders),
t AS (
  SELECT *, CASE WHEN k % 37 = 8 THEN 'α' WHEN k % 23 = 5 THEN '[' ELSE substr('abcdefgh', k % 8 + 1, 1) END AS a, substr('abcdefgh', (k + 1) % 8 + 1, 1) AS b, substr('abcdefgh', (k + 2) % 8 + 1, 1) AS c, CAST(k % 10 AS VARCHAR) AS d,
    CASE WHEN k % 11 = 10 THEN 'unsupported' WHEN page % 13 = 12 THEN 'page_not_traced' ELSE 'traced' END AS status FROM o
), s AS (
  SELECT *, [a, b, c, CASE WHEN above THEN '<sup>' ELSE '<sub>' END, d, CASE WHEN above THEN '</sup>' ELSE '</sub>' END] AS signature,
    CASE WHEN status <> 'traced' THEN 'not_established' WHEN k % 17 = 3 THEN 'ambiguous' WHEN k % 19 = 4 THEN 'not_established' WHEN k % 23 = 5 AND k % 37 <> 8 AND k % 29 <> 6 THEN 'not_established' WHEN k % 29 = 6 THEN 'not_established'
      WHEN k % 31 = 7 THEN 'conflicting' ELSE 'established' END AS semantic,
    CASE WHEN status = 'unsupported' AND k % 22 = 10 THEN 'pdf_page_partially_traced' WHEN status <> 'traced' THEN 'structural_alignment_not_traced' WHEN k % 17 = 3 THEN 'glyph_order_ambiguous' WHEN k % 19 = 4 THEN 'rendered_gid_mismatch'
      WHEN k % 23 = 5 AND k % 37 <> 8 AND k % 29 <> 6 THEN 'source_extensible_delimiter_fragment' WHEN k % 29 = 6 THEN 'authoritative_tounicode_control_invalid' WHEN k % 31 = 7 THEN 'source_signal_conflict' END AS first
  FROM t
)
SELECT page, k AS id, status, semantic, array_to_string(list_filter([first, CASE k % 8 WHEN 4 THEN 'candidate_latex_invalid' WHEN 5 THEN 'candidate_content_missing' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN status <> 'traced' AND status <> 'unsupported' AND status <> 'page_not_traced' THEN NULL ELSE array_to_string(signature, '') END AS source_signature,
  CASE WHEN k % 8 = 4 THEN 'latex_parsing' WHEN k % 16 = 5 THEN 'text_alignment' END AS failure_stage,
  CASE WHEN semantic = 'established' THEN array_to_string(list_filter([CASE WHEN k % 37 = 8 THEN 'cff_tex_glyph_name_authoritative' END, CASE WHEN k % 31 = 9 THEN 'invalid_tounicode_control_ignored_for_agl_source' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS rules_applied,
  CASE WHEN semantic <> 'established' OR k % 8 = 5 OR (k % 8 = 4 AND k % 16 = 4) THEN 'not_evaluated' WHEN k % 8 IN (0, 7) THEN 'matching' WHEN k % 8 = 1 THEN 'missing' ELSE 'contradicting' END AS candidate_status,
  CASE WHEN semantic <> 'established' OR k % 8 = 5 OR (k % 8 = 4 AND k % 16 = 4) THEN 'non_verifiable' WHEN k % 8 IN (0, 7) THEN 'conformant_within_scope' ELSE 'contradicted' END AS verdict
FROM s""")
def a01_k18_k23_semantic_report(spark, sf_dir):
    told = job.semantic_report(*_made(spark, sf_dir), NAMES)
    flat = [F.array_join(c, s).alias(c) for c, s in (("reasons", ","), ("source_signature", ""), ("rules_applied", ","))]
    return told.select("page", "id", "status", "semantic", *flat, "failure_stage", "candidate_status", "verdict")


# Kinds by k % 9: 0 a fraction, 1 one whose rule is too short, 2 a radical, 3 one without its rule, 4 an operator with bounds, 5 two operators, 6 scripts on both sides, 7 two
# baselines of one size, 8 letters over an equals sign. Letters follow from k.
@query(r"""WITH o AS (SELECT o_orderkey AS k, substr('abcdefgh', o_orderkey % 8 + 1, 1) AS a, substr('abcdefgh', (o_orderkey + 3) % 8 + 1, 1) AS b, substr('abcdefgh', (o_orderkey + 5) % 8 + 1, 1) AS c FROM orders)
SELECT k, CASE k % 9 WHEN 0 THEN c || '<fraction><numerator>' || a || '</numerator><denominator>' || b || '</denominator></fraction>' WHEN 2 THEN '√<radicand>' || a || '</radicand>' || b
    WHEN 4 THEN '∑<sub>' || a || '</sub><sup>' || b || '</sup>' || c WHEN 6 THEN a || '<sub>' || b || '</sub><sup>' || c || '</sup>' WHEN 8 THEN a || '=<over>' || b || '</over>' || c END AS signature,
  CASE k % 9 WHEN 1 THEN 'source_fraction_rule_too_short' WHEN 3 THEN 'source_radical_rule_missing' WHEN 5 THEN 'source_stacked_operator_ambiguous' WHEN 7 THEN 'source_baseline_ambiguous' END AS reason FROM o""")
def k09_k14_source_relations(spark, sf_dir):
    letter = lambda n: F.substring(F.lit("abcdefgh"), (n % 8 + 1).cast("int"), F.lit(1))
    k = F.col("k")
    a, b, c = letter(k), letter(k + 3), letter(k + 5)

    def glyph(seq, u, x, oy=10.0, size=10.0, name=""):
        return F.struct(F.lit(seq).alias("seq"), (u if not isinstance(u, str) else F.lit(u)).alias("u"), F.lit(name).alias("name"), *[F.lit(float(v)).alias(n) for n, v in (("size", size), ("oy", oy), ("x0", x), ("y0", oy - 0.8 * size), ("x1", x + 0.5 * size), ("y1", oy + 0.2 * size))])

    def rule(x0, x1, y):
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x0", x0), ("x1", x1), ("y", y), ("width", 0.5))])

    fraction = [glyph(0, c, 0, 16), glyph(1, a, 20, 8), glyph(2, b, 20, 24)]
    kinds = [
        (fraction, [rule(19.5, 25.5, 11)]), (fraction, [rule(22, 25.5, 11)]), ([glyph(0, "√", 0), glyph(1, a, 6), glyph(2, b, 20)], [rule(5, 11.5, 0)]), ([glyph(0, "√", 0), glyph(1, a, 6)], []),
        ([glyph(0, "∑", 0, name="summationdisplay"), glyph(1, a, 0, 17, 6), glyph(2, b, 0, -1, 6), glyph(3, c, 10)], []), ([glyph(0, "∑", 0, name="summationdisplay"), glyph(1, "∏", 10, name="productdisplay"), glyph(2, a, 20)], []),
        ([glyph(0, a, 0), glyph(1, b, 6, 13, 6), glyph(2, c, 6, 5, 6)], []), ([glyph(0, a, 0), glyph(1, b, 10, 40)], []), ([glyph(0, a, 0), glyph(1, "=", 10), glyph(2, b, 11, 4, 5), glyph(3, c, 20)], []),
    ]
    one = lambda part, empty: F.coalesce(*[F.when(k % 9 == n, F.array(*kind[part]) if kind[part] else empty) for n, kind in enumerate(kinds)])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    glyphs = o.select("k", F.inline(one(0, None)))
    rules = o.select("k", F.inline(one(1, F.array().cast("array<struct<x0:double,x1:double,y:double,width:double>>"))))
    return semantics.relations_of(glyphs, rules, ["k"]).select("k", F.array_join("signature", "").alias("signature"), "reason")
