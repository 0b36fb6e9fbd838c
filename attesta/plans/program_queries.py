"""Queries on content streams with forms and on font programs, over documents made from the rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import font_codes
from ..sources import content, synthetic
from ..sources.testdata import table
from .registry import query




def _documents(spark, sf_dir):
    """A made document for each row of ``documents``: its page shows the row's whole text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("n"), "text")
    return synthetic.streams(docs, F.regexp_replace("text", "[^A-Za-z ]", "")), synthetic.entries(docs), docs


def _scan(spark, sf_dir):
    streams, entries, docs = _documents(spark, sf_dir)
    return content.Scan(streams, entries), docs


# Form k of n forms draws form k + 1; the last one draws form 1 where doc_id % 7 = 3. Paths are followed in SQL from each form by itself.
FORMS_SQL = """f AS (SELECT doc_id AS n, CAST(doc_id % 4 + 1 AS INTEGER) AS m, unnest(range(1, doc_id % 4 + 2)) AS k FROM documents),
-- Whose resources form k reads, coming from form 1, which reads the page's: the last even form up to k. A last form whose name is unknown isn't reached.
e AS (SELECT n, m, k, k // 2 * 2 AS ctx, (n + k) % 3 = 0 AS shows, CASE WHEN k < m THEN k + 1 WHEN n % 7 = 3 THEN 1 END AS draws FROM f WHERE NOT (n % 11 = 6 AND k = m AND m >= 3)),
-- Entered once more from the last form, an odd form 1 reads that form's resources.
x AS (
  SELECT *, 1 AS lap FROM e
  UNION ALL SELECT n, m, k, CASE WHEN k // 2 * 2 = 0 THEN m // 2 * 2 ELSE k // 2 * 2 END, shows, draws, 2 FROM e WHERE n % 7 = 3 AND m >= 2 AND k = 1 AND NOT (n % 11 = 6 AND m >= 3)
), o AS (
  SELECT n, k, ctx, CASE WHEN shows THEN 'text' WHEN draws IS NULL THEN 'none' WHEN n % 11 = 6 AND ctx > 0 AND draws = m THEN 'form_xobject_resource_missing' END AS own, m, draws FROM x
)"""


@query(f"""WITH RECURSIVE {FORMS_SQL}, p AS (
  SELECT n, k AS k0, ctx AS ctx0, k, ctx, own, m, draws, [k * 10 + ctx] AS path FROM o
  UNION ALL
  SELECT p.n, k0, ctx0, o.k, o.ctx, CASE WHEN list_contains(path, o.k * 10 + o.ctx) THEN 'form_xobject_cycle_unsupported' ELSE o.own END, o.m, o.draws, list_append(path, o.k * 10 + o.ctx)
  FROM p JOIN o ON o.n = p.n AND o.k = p.draws AND o.ctx = CASE WHEN p.draws % 2 = 0 THEN p.draws ELSE p.ctx END WHERE p.own IS NULL
)
SELECT n AS source, CAST(k0 AS BIGINT) AS stream, CAST(ctx0 AS BIGINT) AS ctx, own AS outcome FROM p WHERE own IS NOT NULL""")
def a09_form_contains_text(spark, sf_dir):
    scan, _ = _scan(spark, sf_dir)
    return scan.outcomes


_ALPHABET = [*range(65, 91), *range(97, 123), 32]


def _plain_fonts(docs):
    """Fonts as tables: F1 has all letters; F2 has codes of two bytes, but not 10, and isn't loaded where n % 17 is 2; F3 lacks the z."""
    n = F.col("n")
    kinds = F.array(*[F.struct(F.lit(f).cast("long").alias("font"), F.lit(w).alias("code_bytes")) for f, w in ((synthetic.FONT1, 1), (synthetic.FONT2, 2), (synthetic.FONT3, 1))])
    fonts = docs.select("source", "n", F.explode(kinds).alias("f")).select("source", "f.font", "f.code_bytes", F.when((n % 17 == 2) & (F.col("f.font") == synthetic.FONT2), "type0_to_unicode_required").alias("reason"))
    letters = [(f, c, chr(c)) for f in (synthetic.FONT1, synthetic.FONT3) for c in _ALPHABET if (f, c) != (synthetic.FONT3, 122)] + [(synthetic.FONT2, c, chr(synthetic.ALPHA + c)) for c in range(1, 12) if c != 10]
    each = F.array(*[F.struct(F.lit(f).cast("long").alias("font"), F.lit(c).alias("code"), F.lit(u).alias("u")) for f, c, u in letters])
    codes = docs.select("source", F.explode(each).alias("c")).select("source", "c.font", "c.code", F.concat(F.lit("g"), F.col("c.code").cast("string")).alias("name"), F.col("c.code").alias("gid"), "c.u")
    return fonts, codes


# The chain of forms that are entered: form k, up to the last that shows text; each shows its two chunks behind what it draws.
PAGES_SQL = f"""{FORMS_SQL}, p AS (
  SELECT n, k AS k0, ctx AS ctx0, k, ctx, own, m, draws, [k * 10 + ctx] AS path FROM o
  UNION ALL
  SELECT p.n, k0, ctx0, o.k, o.ctx, CASE WHEN list_contains(path, o.k * 10 + o.ctx) THEN 'form_xobject_cycle_unsupported' ELSE o.own END, o.m, o.draws, list_append(path, o.k * 10 + o.ctx)
  FROM p JOIN o ON o.n = p.n AND o.k = p.draws AND o.ctx = CASE WHEN p.draws % 2 = 0 THEN p.draws ELSE p.ctx END WHERE p.own IS NULL
), t AS (SELECT n, k0 AS k, ctx0 AS ctx, own FROM p WHERE own IS NOT NULL),
-- m: how many forms there are; l: the last form that shows text.
l AS (SELECT n, max(k) AS l FROM e WHERE shows GROUP BY n),
i AS (
  SELECT d.doc_id AS n, regexp_replace(coalesce(d.text, ''), '[^A-Za-z ]', '', 'g') AS line, l.l, a.own AS early,
    CASE WHEN d.doc_id % 11 = 6 AND e.ctx > 0 AND e.draws = e.m THEN 'form_xobject_resource_missing' WHEN z.own = 'text' THEN 'form_xobject_cycle_unsupported' WHEN z.own <> 'none' THEN z.own END AS late
  FROM documents d LEFT JOIN l ON l.n = d.doc_id LEFT JOIN t a ON a.n = d.doc_id AND a.k = 1 AND a.ctx = 0 LEFT JOIN e ON e.n = d.doc_id AND e.k = l.l
  LEFT JOIN t z ON z.n = d.doc_id AND z.k = e.draws AND z.ctx = CASE WHEN e.draws % 2 = 0 THEN e.draws ELSE e.ctx END
), g AS (
  SELECT n, line, l, CASE WHEN early NOT IN ('text', 'none') THEN early WHEN early = 'text' AND late IS NOT NULL THEN late WHEN line = '' AND coalesce(early, 'none') <> 'text' THEN 'page_content_unsupported' END AS reason,
    n % 17 = 2 AS unloaded, n % 10 = 9 AS lacks, n % 13 = 5 AS third FROM i
), w AS (SELECT g.*, e.k, e.shows, 4 + (e.draws IS NOT NULL)::INT + 4 * e.shows::INT AS ops, (e.draws IS NOT NULL)::INT AS d FROM g LEFT JOIN e ON e.n = g.n AND e.k <= g.l WHERE reason IS NULL),
-- Forms come innermost first: a chunk's place, its operator, and how many glyphs it counts as.
b AS (
  SELECT n, line, third, unloaded, lacks, k, shows, coalesce(sum(ops) OVER (PARTITION BY n), 0) AS nested, coalesce(sum(ops) OVER (PARTITION BY n ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner_ops, d FROM w
), c AS (
  SELECT n, -k AS ord, part, '/F2' AS font, 3 + 5 * (k - 1) + 4 + d + inner_ops + 2 AS op, [n % 10 + 1, k % 10 + 1] AS codes, unloaded OR lacks AS out_, unloaded, lacks, 4 AS bytes FROM b, range(2) r(part) WHERE shows
  UNION ALL
  SELECT DISTINCT n, 0, 0, CASE WHEN third THEN '/F3' ELSE '/F1' END, 8 + nested, list_transform(string_split(line, ''), lambda x: CAST(ascii(x) AS BIGINT)), third AND contains(line, 'z'), false, false, length(line) FROM b
), q AS (
  SELECT *, CASE WHEN font <> '/F2' THEN bytes WHEN unloaded OR lacks AND row_number() OVER (PARTITION BY n, font ORDER BY ord, part) > 1 THEN 4 ELSE 2 END AS taken FROM c
), s AS (SELECT *, CAST(sum(taken) OVER (PARTITION BY n ORDER BY ord, part) - taken AS BIGINT) AS base FROM q)"""


@query(f"""WITH RECURSIVE {PAGES_SQL}, u AS (SELECT n, font, op, base, unnest(codes) AS code, unnest(range(0, len(codes))) AS j FROM s WHERE NOT out_ AND bytes > 0)
SELECT n AS source, CAST(base + j AS BIGINT) AS sequence, CAST(op AS BIGINT) AS operation, font AS font_key, CAST(code AS INTEGER) AS code, CASE WHEN font = '/F2' THEN chr(CAST({synthetic.ALPHA} + code AS INTEGER)) ELSE chr(CAST(code AS INTEGER)) END AS u FROM u""")
def a04_a05_form_glyphs(spark, sf_dir):
    scan, docs = _scan(spark, sf_dir)
    glyphs, _, _ = scan.glyphs(*_plain_fonts(docs))
    return glyphs.select("source", "sequence", "operation", "font_key", "code", "u")


@query(f"""WITH RECURSIVE {PAGES_SQL}
SELECT n AS source, font AS font_key, CASE WHEN unloaded THEN 'type0_to_unicode_required' ELSE 'embedded_glyph_required' END AS reason, CAST(count(DISTINCT op) AS INTEGER) AS n_operations, CAST(sum(taken) AS INTEGER) AS n_sequences, CAST(min(base) AS BIGINT) AS first
FROM s WHERE out_ GROUP BY 1, 2, 3""")
def a04_c10_excluded_fonts(spark, sf_dir):
    scan, docs = _scan(spark, sf_dir)
    _, exclusions, _ = scan.glyphs(*_plain_fonts(docs))
    return exclusions.select("source", "font_key", "reason", F.size("operations").alias("n_operations"), F.size("sequences").alias("n_sequences"), F.array_min("sequences").alias("first"))


@query(f"""WITH RECURSIVE {PAGES_SQL} SELECT n AS source, reason FROM g WHERE reason IS NOT NULL""")
def a03_a05_unread_pages(spark, sf_dir):
    scan, docs = _scan(spark, sf_dir)
    _, _, faults = scan.glyphs(*_plain_fonts(docs))
    return faults.select("source", "reason")


@query(f"""WITH RECURSIVE {PAGES_SQL}
SELECT n AS source, 'form_xobject' AS kind, '/X1' AS resource, 10.0::DOUBLE AS x0, 770.0::DOUBLE AS y0, 30.0::DOUBLE AS x1, 780.0::DOUBLE AS y1, early = 'text' AS text_traced FROM i WHERE early IN ('text', 'none')
UNION ALL SELECT n, 'image_xobject', '/Im', 0.0, 799.0, 1.0, 800.0, false FROM i WHERE early IN ('text', 'none')""")
def a08_opaque_regions(spark, sf_dir):
    scan, _ = _scan(spark, sf_dir)
    regions, _ = scan.opaque_regions()
    return regions.select("source", "kind", "resource", "x0", "y0", "x1", "y1", "text_traced")


def _made_fonts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("n"))
    return font_codes.loaded(synthetic.fonts(parts))


_REASONS = {
    synthetic.FONT1: ["", font_codes.ENCODING, font_codes.ENCODING, font_codes.TYPE1C, "embedded_font_program_invalid", font_codes.TYPE],
    synthetic.FONT2: ["", font_codes.CID_GLYPHS, font_codes.IDENTITY, font_codes.CID, font_codes.CID_MAP, font_codes.TYPE0_MAP],
    synthetic.FONT3: ["", font_codes.AMBIGUOUS, "", font_codes.INCOMPLETE, "embedded_font_program_invalid", font_codes.TRUETYPE_MAP],
}
_REASON_SQL = "CASE font " + " ".join(f"WHEN {f} THEN CASE n % 6 {' '.join(f'WHEN {k} THEN {chr(39)}{r}{chr(39)}' for k, r in enumerate(rs) if r)} END" for f, rs in _REASONS.items()) + " END"
FONTS_SQL = f"""f AS (SELECT p_partkey AS n, unnest([{synthetic.FONT1}, {synthetic.FONT2}, {synthetic.FONT3}]) AS font FROM part), r AS (SELECT n, font, {_REASON_SQL} AS reason FROM f)"""


@query(f"""WITH {FONTS_SQL} SELECT n AS source, CAST(font AS BIGINT) AS font, CASE font WHEN {synthetic.FONT2} THEN 2 ELSE 1 END AS code_bytes,
CASE font WHEN {synthetic.FONT1} THEN CASE n % 6 WHEN 5 THEN 'Other' ELSE 'Made+One' END WHEN {synthetic.FONT2} THEN 'Made-Two' ELSE 'Made-Three' END AS trace_font, reason FROM r""")
def a11_a14_font_reasons(spark, sf_dir):
    return _made_fonts(spark, sf_dir)[0]


# The ASCII characters have the glyphs 1 to 95 in their order; alpha and beta stand behind them. Quotes differ between encodings.
@query(f"""WITH {FONTS_SQL}, c AS (
  SELECT n, font, code, code - 31 AS gid, CASE code WHEN 39 THEN '’' WHEN 96 THEN '‘' ELSE chr(CAST(code AS INTEGER)) END AS u FROM r, range(32, 127) t(code)
  WHERE reason IS NULL AND font = {synthetic.FONT1} AND (n % 3 = 0 OR code NOT IN (39, 96))
  UNION ALL SELECT n, font, code, 95 + code, chr(CAST(944 + code AS INTEGER)) FROM r, range(1, 3) t(code) WHERE reason IS NULL AND font = {synthetic.FONT1}
  UNION ALL SELECT n, font, code, gid, u FROM (SELECT n, font, unnest([145, 146]) AS code, unnest([65, 8]) AS gid, unnest(['‘', '’']) AS u FROM r WHERE reason IS NULL AND font = {synthetic.FONT1} AND n % 3 = 1)
  UNION ALL SELECT n, font, code, gid, u FROM (SELECT n, font, unnest([212, 213]) AS code, unnest([65, 8]) AS gid, unnest(['‘', '’']) AS u FROM r WHERE reason IS NULL AND font = {synthetic.FONT1} AND n % 3 = 2)
  UNION ALL SELECT n, font, code, 1, ' ' FROM (SELECT n, font, CASE n % 3 WHEN 1 THEN 160 ELSE 202 END AS code FROM r WHERE reason IS NULL AND font = {synthetic.FONT1} AND n % 3 > 0)
  UNION ALL SELECT n, font, 173, 14, '-' FROM r WHERE reason IS NULL AND font = {synthetic.FONT1} AND n % 3 = 1
  UNION ALL SELECT n, font, code, code, CASE WHEN code = 1 THEN '0' WHEN code <= n % 5 + 3 THEN chr(CAST({synthetic.ALPHA - 2} + code AS INTEGER)) ELSE substr('xyzvwqrs', CAST(code - n % 5 - 3 AS BIGINT), 1) END
    FROM r, range(1, 12) t(code) WHERE reason IS NULL AND font = {synthetic.FONT2}
  UNION ALL SELECT n, font, code, code - 64, chr(CAST({synthetic.ALPHA - 65} + code AS INTEGER)) FROM r, range(65, 72) t(code) WHERE reason IS NULL AND font = {synthetic.FONT3} AND code < 67 + n % 5
)
SELECT n AS source, CAST(font AS BIGINT) AS font, CAST(code AS INTEGER) AS code, CAST(gid AS INTEGER) AS gid, u FROM c""")
def a12_a14_font_codes(spark, sf_dir):
    return _made_fonts(spark, sf_dir)[1].select("source", "font", "code", "gid", "u")
