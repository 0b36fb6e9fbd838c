"""Queries on fonts, rules, loci and MathML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locus, mathml
from ..operators import fonts
from ..sources import testdata as T
from ..sources.testdata import BOXES_SQL, table
from .registry import query


def _fonted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        (F.floor(n / 2000) * 20 + F.col("user_id") % 20).alias("page"), F.concat(F.lit("/F"), (n % 6).cast("string")).alias("font"), F.lit(0).alias("block"), (F.col("user_id") % 7).alias("line"), F.floor(n / 10).alias("span"), n.alias("seq"),
        F.when(n % 6 == 1, "(").when(n % 3 == 0, "x").otherwise("word").alias("u"), ((n % 6 == 2) & (n % 50 == 0)).alias("evidence"), F.when(n % 6 >= 3, 2).otherwise(0).alias("flags"),
    )


@query("""WITH e AS (SELECT event_id // 2000 * 20 + user_id % 20 AS page, '/F' || event_id % 6 AS font, user_id % 7 AS line, event_id // 10 AS span, event_id AS seq, CASE WHEN event_id % 6 = 1 THEN '(' WHEN event_id % 3 = 0 THEN 'x' ELSE 'word' END AS u,
  event_id % 6 = 2 AND event_id % 50 = 0 AS evidence, event_id % 6 >= 3 AS italic FROM events),
s AS (SELECT page, font, line, span, string_agg(u, '' ORDER BY seq) AS t FROM e GROUP BY 1, 2, 3, 4), x AS (SELECT page, font, count(*) AS texts, bool_and(regexp_matches(replace(t, ',', ''), '^\\p{L}{1,2}$')) AS short FROM s GROUP BY 1, 2),
o AS (SELECT page, font, bool_or(evidence) AS ev, bool_and(u = '(') AS de, bool_or(italic) AS it FROM e GROUP BY 1, 2), f AS (SELECT o.*, x.texts, x.short, ev OR de OR (it AND short AND texts >= 3) AS seed FROM o JOIN x USING (page, font)),
l AS (SELECT DISTINCT e.page, e.line FROM e JOIN f USING (page, font) WHERE seed), h AS (SELECT e.page, e.font, count(DISTINCT e.line) AS n FROM e JOIN l USING (page, line) GROUP BY 1, 2)
SELECT f.page, f.font, seed OR (it AND coalesce(h.n, 0) >= 2) AS math, CASE WHEN it THEN 'contextual' END AS variable FROM f LEFT JOIN h USING (page, font)""")
def d11_d12_math_fonts(spark, sf_dir):
    return fonts.math_fonts(_fonted(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, r AS (SELECT page, id AS rule, x0 AS r0, x1 AS r1, y1 + 2 AS y, 0.5 AS slack FROM boxes WHERE role = 'oracle' AND id % 5 = 0), g AS (SELECT page, x0, y0, x1, y1, y1 - y0 AS size FROM boxes WHERE role = 'candidate'),
m AS (SELECT r.page, rule, y1 <= y + slack AND y - y1 <= 0.6 * size AS a, y0 >= y - slack AND y0 - y <= 0.6 * size AS b, y0 < y AND y < y1 AS c FROM r JOIN g ON g.page = r.page AND (x0 + x1) / 2.0 BETWEEN r0 - slack AND r1 + slack),
n AS (SELECT page, rule, count(*) FILTER (a) AS above, count(*) FILTER (NOT a AND b) AS below, count(*) FILTER (NOT a AND NOT b AND c) AS crossing FROM m GROUP BY 1, 2)
SELECT r.page, r.rule, coalesce(above, 0) AS above, coalesce(below, 0) AS below, coalesce(crossing, 0) AS crossing FROM r LEFT JOIN n USING (page, rule)""")
def k05_k06_rule_sides(spark, sf_dir):
    b = T.boxes(spark, sf_dir)
    rules = b.where("role = 'oracle' AND id % 5 = 0").select("page", "id", "x0", "x1", (F.col("y1") + 2).alias("y"), F.lit(0.5).alias("width"))
    return fonts.rule_sides(rules, b.where("role = 'candidate'").withColumn("size", F.col("y1") - F.col("y0")))


@query(f"""WITH {BOXES_SQL}, l AS (SELECT id // 60 AS page, id % 4 AS font, x0, y0, x1, y1 FROM boxes WHERE id % 4 < 3), m AS (SELECT p AS page, f AS font FROM (SELECT DISTINCT id // 60 AS p FROM boxes) a, range(1, 4) b(f) WHERE (p + f) % 3 = 0)
SELECT DISTINCT l.* FROM l JOIN m USING (page, font) UNION ALL SELECT page, font, 0, 0, 500, 500 FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page = m.page AND l.font = m.font)""")
def c10_font_exclusions(spark, sf_dir):
    boxes = T.boxes(spark, sf_dir).withColumn("page", F.floor(F.col("id") / 60))
    lines = boxes.where("id % 4 < 3").select("page", (F.col("id") % 4).alias("font"), "x0", "y0", "x1", "y1")
    numbers = boxes.select("page").distinct()
    pairs = numbers.select("page", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])).alias("font"))
    zero, full = [F.lit(x).cast("long") for x in (0, 500)]
    pages = numbers.select("page", zero.alias("x0"), zero.alias("y0"), full.alias("x1"), full.alias("y1"))
    return fonts.font_exclusions(lines, pairs.where("(page + font) % 3 = 0"), pages)


@query()
def h15_h23_expanded_loci(spark, sf_dir):
    d = T.lines(spark, sf_dir, 80).select("doc_id", "line", F.regexp_replace("t", r"[^\p{L}]", "x").alias("w"))
    made = d.select("doc_id", "line", F.concat(F.lit(r"\frac{\mathbf{"), "w", F.lit("}_{i}}{2}+y")).alias("latex"))
    return made.select("doc_id", "line", "latex", locus.expanded_udf("latex", F.lit(14), F.lit(16)).alias("s")).select("doc_id", "line", "latex", "s.*")


@query()
def h33_h40_published_mathml(spark, sf_dir):
    d = T.lines(spark, sf_dir, 80).select("doc_id", "line", F.regexp_replace("t", r"[^\p{L}]", "x").alias("w"))
    xml = F.concat(F.lit("<math><msub><mo>max</mo><mi>"), "w", F.lit("</mi></msub><mo>|</mo><mo>|</mo><mi>&amp;</mi><mtext>if $x$ holds</mtext></math>"))
    return d.select("doc_id", "line", mathml.published_udf(xml, "w").alias("xml"))
