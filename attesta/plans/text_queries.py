"""Queries on texts, spans and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dollars
from ..functions import text as X
from ..operators import containment, relational
from ..sources.testdata import table
from ..streaming import protocol
from .registry import query




def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(r"""SELECT doc_id, regexp_matches(text, '\p{Sm}') AS math_symbol, regexp_matches(text, '[\p{Cc}]') AS control,
  regexp_matches(replace(regexp_extract(text, '[^ ]+', 0), ',', ''), '^\p{L}{1,2}$') AS short_variable, lang NOT IN ('de') AND source <> 'src0' AS inline_math,
  regexp_matches(replace(text, 'd e f', ''), '(^|\s)\p{L}(\s\p{L}){3,}(\s|$)') AS spaced, text LIKE '%the%' AS has_the FROM documents""")
def b02_b04_b16_b21_predicates(spark, sf_dir):
    first = F.regexp_extract("text", "[^ ]+", 0)
    label, layer = F.when(F.col("lang") == "de", "code").otherwise("text"), F.when(F.col("source") == "src0", "furniture")
    return _docs(spark, sf_dir).select(
        "doc_id", X.has_math_symbol(F.col("text")).alias("math_symbol"), X.has_control(F.col("text")).alias("control"), X.short_variable(first).alias("short_variable"),
        X.carries_inline_math(label, layer).alias("inline_math"), X.spaced_letters(F.col("text")).alias("spaced"), F.col("text").contains("the").alias("has_the"),
    )


@query(r"""WITH w AS (SELECT doc_id, trim(regexp_extract(text, '[^ ]+ [^ ]+', 0)) AS x FROM documents), v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '\' || x WHEN 1 THEN replace(x, ' ', ' = ') WHEN 2 THEN replace(x, ' ', '_') WHEN 3 THEN regexp_extract(x, '^[^ ]+', 0) ELSE x END AS x FROM w)
SELECT doc_id, x <> '' AND (x LIKE '\%' OR x LIKE '{%' OR regexp_matches(x, '^\S+\s*[<>=]\s*\S+$') OR regexp_matches(x, '[+*/^_{}()\[\]\\]') OR (NOT regexp_matches(x, '\s') AND NOT regexp_matches(x, '^\p{L}{2,}$'))) AS unambiguous FROM v""")
def b05_unambiguous_math(spark, sf_dir):
    x = F.trim(F.regexp_extract("text", "[^ ]+ [^ ]+", 0))
    k = F.col("doc_id") % 5
    made = F.when(k == 0, F.concat(F.lit("\\"), x)).when(k == 1, F.replace(x, F.lit(" "), F.lit(" = "))).when(k == 2, F.replace(x, F.lit(" "), F.lit("_"))).when(k == 3, F.regexp_extract(x, "^[^ ]+", 0)).otherwise(x)
    return _docs(spark, sf_dir).select("doc_id", X.unambiguous_math(made).alias("unambiguous"))


@query(r"""WITH p AS (SELECT doc_id, '/ABCDEF+' || source || lang AS f, sha256(text) AS s, regexp_replace(text, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, text FROM documents)
SELECT doc_id, source || lang AS family, safe, sha256(concat_ws(':', lang, source, s)) AS fingerprint, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE s END AS sha,
  list_transform(regexp_extract_all(text, '(?s:.)'), lambda c: 'U+' || CASE WHEN unicode(c) < 4096 THEN lpad(upper(to_hex(unicode(c))), 4, '0') ELSE upper(to_hex(unicode(c))) END) AS points,
  regexp_replace(text, '\s', '', 'g') AS collapsed FROM (SELECT p.*, d.source, d.lang FROM p JOIN documents d USING (doc_id))""")
def h41_h44_h53_h58_h62_identity(spark, sf_dir):
    font = F.concat(F.lit("/ABCDEF+"), "source", "lang")
    sha = F.sha2("text", 256)
    given = F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.upper(sha))
    return _docs(spark, sf_dir).select(
        "doc_id", X.font_family(font).alias("family"), X.safe_id(F.col("text")).alias("safe"), X.digest(F.col("lang"), F.col("source"), sha).alias("fingerprint"), X.valid_sha256(given).alias("sha"),
        X.code_points(F.col("text")).alias("points"), X.collapsed(F.col("text")).alias("collapsed"),
    )


@query()
def b06_h24_h25_math_spans(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(F.col("text").contains("$"))
    told = rows.select("doc_id", dollars.balanced_spans_udf("text").alias("d")).select("doc_id", "d.*")
    return told.select("doc_id", "balanced", F.explode_outer("spans").alias("s")).select("doc_id", "balanced", "s.*")


@query()
def a21_h27_paired_spans(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").contains("$")).select("doc_id", F.explode(dollars.paired_spans_udf("text")).alias("s")).select("doc_id", "s.*")


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '\\\$', '', 'g'), '$')) - 1 AS dollars FROM documents""")
def h32_h55_unescaped_dollars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.escaped_places(F.col("text"), "$")).cast("long").alias("dollars"))


@query(r"""WITH c AS (SELECT doc_id, unnest(c) AS u, unnest(range(0, len(c))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '(?s:.)') AS c FROM documents))
SELECT doc_id, p AS "at", translate(u, '-*''', '−∗′') AS u FROM c WHERE NOT regexp_matches(u, '^\s$') AND strpos('$_^{}', u) = 0""")
def b28_h28_h29_literal_characters(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(X.literal_characters(F.col("text"))).alias("c")).select("doc_id", F.col("c.at").cast("long").alias("at"), "c.u")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents) SELECT doc_id, list_filter(range(0, len(a)), lambda i: a[i + 1] = a[1] AND a[i + 2] IS NOT DISTINCT FROM a[2] AND i + 2 <= len(a)) AS places FROM w WHERE len(a) >= 2""")
def c15_pattern_places(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("a")).where("size(a) >= 2")
    return words.select("doc_id", F.transform(relational.pattern_places(F.col("a"), F.slice("a", 1, 2)), lambda i: i.cast("long")).alias("places"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s:.)') AS c FROM documents) SELECT doc_id, list_filter(range(0, greatest(len(c) - 1, 0)), lambda i: c[i + 1] = 't' AND c[i + 2] = 'h') AS places FROM t""")
def i21_substring_places(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.transform(relational.substring_places(t, F.lit("th")), lambda i: i.cast("long")).alias("places"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '[^aeiou]', '', 'g') AS v FROM documents) SELECT doc_id, regexp_matches(v, 'a.*e.*i.*o.*u') AS subsequence FROM d""")
def i20_subsequence(spark, sf_dir):
    vowels = F.split(F.regexp_replace(F.col("text"), "[^aeiou]", ""), "")
    return _docs(spark, sf_dir).select("doc_id", relational.is_subsequence(F.split(F.lit("aeiou"), ""), vowels).alias("subsequence"))


@query("""SELECT b.item_id, count(*) AS n, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s', '', 'g'), regexp_replace(b.text, '\\s', '', 'g')) GROUP BY b.item_id""")
def b37_h53_source_in_candidate(spark, sf_dir):
    source = table(spark, sf_dir, "benchmark").select("item_id", X.collapsed(F.col("text")).alias("part"))
    docs = _docs(spark, sf_dir).select("doc_id", X.collapsed(F.col("text")).alias("text"))
    return containment.contained(docs, source, "doc_id", "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'idiot') OR contains(text, 'moron') THEN 'REJECTED' WHEN contains(text, 'the') AND contains(text, 'and') THEN 'MATCH' ELSE 'NOT_PROVEN' END AS state,
  CASE WHEN contains(regexp_replace(text, 'the', 'idiot'), 'idiot') OR contains(text, 'moron') THEN 'REJECTED' WHEN contains(text, 'the') AND contains(text, 'and') THEN 'MATCH' ELSE 'NOT_PROVEN' END AS mutated FROM documents""")
def d31_h51_h52_facts(spark, sf_dir):
    # One occurrence is replaced: the text is cut at the first one.
    at = F.locate("the", "text")
    mutated = F.when(at > 0, F.concat(F.expr("substring(text, 1, locate('the', text) - 1)"), F.lit("idiot"), F.expr("substring(text, locate('the', text) + 3)"))).otherwise(F.col("text"))
    rules = (["the", "and"], ["idiot", "moron"])
    return _docs(spark, sf_dir).select("doc_id", X.fact_state(F.col("text"), *rules).alias("state"), X.fact_state(mutated, *rules).alias("mutated"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(regexp_extract(text, '^[^\\n]*', 0), '[,.;]+$', '') AS bare, regexp_extract(text, '^[^\\n]*', 0) AS line FROM documents) SELECT doc_id, doc_id % 4 <> 0 AND (doc_id % 3 <> 0 OR line = bare) AS covered FROM d""")
def b30_assertions_covered(spark, sf_dir):
    line = F.regexp_extract("text", r"^[^\n]*", 0)
    expected = F.when(F.col("doc_id") % 3 == 0, line).otherwise(F.regexp_replace(line, r"[,.;]+$", ""))
    relation = F.when(F.col("doc_id") % 4 == 0, "superscript").otherwise("sequence")
    return _docs(spark, sf_dir).select("doc_id", X.assertions_covered(F.array(relation), F.array(expected), line).alias("covered"))


@query("""WITH p AS (SELECT page_id, html FROM pages) SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS n_p, len(regexp_extract_all(html, '<a[ >]')) AS n_a, len(regexp_extract_all(html, '<li[ >]')) AS n_li, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, length(html) > 0 AS has_content, sha256(html) AS sha FROM p""")
def c12_d17_html_inventory(spark, sf_dir):
    n = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]")).cast("long").alias(f"n_{tag}")
    return table(spark, sf_dir, "pages").select("page_id", n("p"), n("a"), n("li"), n("h1"), (F.length("html") > 0).alias("has_content"), F.sha2("html", 256).alias("sha"))


@query("""WITH c AS (SELECT doc_id, encode(text) AS b FROM documents WHERE doc_id % 1 = 0), k AS (SELECT doc_id, b, unnest(range(0, greatest(1, CAST(ceil(octet_length(b) / 3000.0) AS BIGINT)))) AS s FROM c)
SELECT CAST(doc_id AS VARCHAR) AS name, CAST(s AS INTEGER) AS sequence, base64(b[s * 3000 + 1 : s * 3000 + 3000]) AS content_base64 FROM k""".replace(" WHERE doc_id % 1 = 0", ""))
def a28_artifact_chunks(spark, sf_dir):
    return protocol.chunks(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "text"), "text", 3000)


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, CAST(greatest(1, ceil(octet_length(encode(text)) / 3000.0)) AS INTEGER) AS chunks FROM documents""")
def a30_a44_reassembled(spark, sf_dir):
    return protocol.reassembled(a28_artifact_chunks(spark, sf_dir)).select("name", "bytes", "sha256", "chunks")


@query(r"""SELECT item_id, CAST(to_json({'id': item_id, 'n': length(text)}) AS VARCHAR) AS line, octet_length(encode(to_json({'id': item_id, 'n': length(text)}))) + 1 AS bytes FROM benchmark""")
def a22_a29_ndjson_lines(spark, sf_dir):
    line = F.to_json(F.struct(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")))
    return table(spark, sf_dir, "benchmark").select("item_id", line.alias("line"), (F.octet_length(line) + 1).cast("long").alias("bytes"))


@query("""SELECT conv_id, list_sort(list(role)) = ['assistant', 'user'] AS exact, len(list_filter(list(DISTINCT role), lambda r: r NOT IN ('user', 'assistant'))) = 0 AS allowed FROM conversations GROUP BY conv_id""")
def a34_g05_g08_field_sets(spark, sf_dir):
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("r"))
    return roles.select("conv_id", (F.col("r") == F.array(F.lit("assistant"), F.lit("user"))).alias("exact"), (F.size(F.array_except("r", F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("allowed"))


@query("""SELECT doc_id, CASE WHEN length(text) < 200 THEN 'too_short' WHEN lang NOT IN ('en', 'fr') THEN 'language_unsupported' WHEN contains(text, '|') THEN 'table_like' WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents""")
def b11_b13_first_failing_rule(spark, sf_dir):
    rules = [(F.length("text") < 200, "too_short"), (~F.col("lang").isin("en", "fr"), "language_unsupported"), (F.contains("text", F.lit("|")), "table_like"), (F.contains("text", F.lit("!!")), "shouting")]
    reason = F.coalesce(*[F.when(when, code) for when, code in rules])
    return _docs(spark, sf_dir).select("doc_id", reason.alias("reason"))
