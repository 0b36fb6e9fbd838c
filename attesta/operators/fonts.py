"""Which fonts of a page are mathematical, and which rules are those of fractions, by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_variable

ITALIC, BOLD = 2, 16
DELIMITERS = "()[]{}|"


def span_texts(glyphs: DataFrame) -> DataFrame:
    """page, font, text of each span in its order."""
    spans = glyphs.groupBy("page", "font", "block", "line", "span").agg(F.array_sort(F.collect_list(F.struct("seq", "u"))).alias("g"))
    return spans.select("page", "font", F.array_join(F.transform("g", lambda g: g["u"]), "").alias("text"))


def math_fonts(glyphs: DataFrame) -> DataFrame:
    """page, font, math, variable (standalone, contextual or null).

    Mathematical by evidence (a glyph name that its font declares), by holding delimiters only, or as an italic font of short
    variables only, three at least. Then, once, italic fonts that share two lines with such fonts.
    """
    texts = span_texts(glyphs).groupBy("page", "font").agg(F.count(F.lit(1)).alias("texts"), F.bool_and(short_variable(F.col("text"))).alias("short"))
    delimiters = F.bool_and(F.col("u").rlike(r"^[()\[\]{}|]+$"))
    own = glyphs.groupBy("page", "font").agg(F.bool_or("evidence").alias("evidence"), delimiters.alias("delimiters"), F.bool_or(F.col("flags").bitwiseAND(ITALIC) != 0).alias("italic"), F.bool_or(F.col("flags").bitwiseAND(BOLD) != 0).alias("bold"))
    both = own.join(texts, ["page", "font"])
    first = both.withColumn("seed", F.col("evidence") | F.col("delimiters") | (F.col("italic") & F.col("short") & (F.col("texts") >= 3)))
    lines = glyphs.join(first.where("seed").select("page", "font"), ["page", "font"], "left_semi").select("page", "block", "line").distinct()
    shared = glyphs.join(lines, ["page", "block", "line"], "left_semi").groupBy("page", "font").agg(F.count_distinct("block", "line").alias("shared"))
    out = first.join(shared, ["page", "font"], "left").fillna(0, ["shared"])
    variable = F.when(F.col("bold") & F.col("short"), "standalone").when(F.col("italic"), "contextual")
    return out.select("page", "font", (F.col("seed") | (F.col("italic") & (F.col("shared") >= 2))).alias("math"), variable.alias("variable"))


def rule_sides(rules: DataFrame, glyphs: DataFrame) -> DataFrame:
    """page, rule, above, below, crossing: counts of the glyphs whose middle a rule spans, within its reach (0.6 of their size)."""
    r = rules.select("page", F.col("id").alias("rule"), F.col("x0").alias("r0"), F.col("x1").alias("r1"), "y", F.greatest(F.lit(0.5), "width").alias("slack"))
    middle = (F.col("x0") + F.col("x1")) / 2
    met = r.join(glyphs.select("page", "x0", "y0", "x1", "y1", "size"), "page").where(middle.between(F.col("r0") - F.col("slack"), F.col("r1") + F.col("slack")))
    above = (F.col("y1") <= F.col("y") + F.col("slack")) & (F.col("y") - F.col("y1") <= 0.6 * F.col("size"))
    below = ~above & (F.col("y0") >= F.col("y") - F.col("slack")) & (F.col("y0") - F.col("y") <= 0.6 * F.col("size"))
    crossing = ~above & ~below & (F.col("y0") < F.col("y")) & (F.col("y") < F.col("y1"))
    counts = met.groupBy("page", "rule").agg(F.count_if(above).alias("above"), F.count_if(below).alias("below"), F.count_if(crossing).alias("crossing"))
    return r.select("page", "rule").join(counts, ["page", "rule"], "left").fillna(0, ["above", "below", "crossing"])


def fraction_rules(sides: DataFrame) -> DataFrame:
    """The rules with something above and below and nothing crossing."""
    return sides.where("above > 0 AND below > 0 AND crossing = 0").select("page", "rule")


def font_exclusions(lines: DataFrame, limited: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of lines in limited fonts, each once; a limited font on no line is excluded by its page's whole box."""
    key = ["page", "font"]
    found = lines.join(limited.select(*key), key).select(*key, "x0", "y0", "x1", "y1").dropDuplicates()
    rest = limited.select(*key).join(lines.select(*key).distinct(), key, "left_anti").join(pages.select("page", "x0", "y0", "x1", "y1"), "page")
    return found.unionByName(rest.select(*key, "x0", "y0", "x1", "y1"))
