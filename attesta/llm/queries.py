"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bestfit, bpe, codes, langid, licenses, media, neardup, packing, quality, repeats, shards, topk, turns
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), RANKS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.predict(docs.select("doc_id", "text"), docs)
    return told.select("doc_id", "held_out", "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(table(spark, sf_dir, "conversations"))[0]


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def _op2_sql() -> str:
    templates = [*licenses.BASE, *licenses.TEMPLATES]
    rows = []
    for number, (phrase, label) in enumerate(templates):
        words = phrase.split()
        rows += [f"('{words[i]}', '{words[i + 1]}', '{words[i + 2]}', {number}, {i}, {len(words) - 2}, '{label}', {number < len(licenses.BASE)})" for i in range(len(words) - 2)]
    return f"""
WITH t(t0, t1, t2, template, place, runs, label, base) AS (VALUES {", ".join(rows)}),
w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses._UPPER}', '{licenses._LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), g AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w),
h AS (SELECT rid, p - 1 - place AS diagonal, template, place, runs, label, base FROM g JOIN t ON ws[p] = t0 AND ws[p + 1] = t1 AND ws[p + 2] = t2),
v AS (SELECT rid, template, diagonal, runs, label, base, list(DISTINCT place) AS places FROM h GROUP BY ALL),
m AS (SELECT a.rid, a.template, a.diagonal, unnest(b.places) AS place, b.diagonal AS there FROM v a JOIN v b ON a.rid = b.rid AND a.template = b.template AND b.diagonal - a.diagonal BETWEEN 0 AND CASE WHEN a.base THEN 0 ELSE {licenses.APART} END),
f AS (SELECT rid, template, diagonal, least(count(DISTINCT place), count(DISTINCT place + there)) AS found FROM m GROUP BY ALL),
s AS (SELECT rid, template, runs, label, base, diagonal AS start, found / CAST(runs AS DOUBLE) AS share FROM v JOIN f USING (rid, template, diagonal)),
c AS (SELECT *, CASE WHEN base THEN share = 1 ELSE share >= {licenses.COVERED} END AS counts FROM s),
o AS (
  SELECT rid, count(*) FILTER (base AND counts) AS n_base, min(start) FILTER (base AND counts) AS first_word, max(start) FILTER (base AND counts) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND counts) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts) AS labels, max(share) FILTER (counts) AS score
  FROM c GROUP BY rid
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN o USING (rid)
"""


def _op4_sql() -> str:
    inside = lambda at: f"b[{at} : {at}] BETWEEN '\\x80'::BLOB AND '\\xBF'::BLOB"  # noqa: E731  a byte that continues a character
    before = "CASE " + " ".join(f"WHEN NOT ({inside(f'a - {k}')}) THEN a - {k}" for k in range(3)) + " ELSE a - 3 END"
    after = "CASE " + " ".join(f"WHEN NOT ({inside(f'z + {k}')}) THEN z + {k}" for k in range(3)) + " ELSE z + 3 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT rid, i, md5(b[i : i + 399]) AS m FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS n FROM h) WHERE n > 1),
l AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM l),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY rid, k),
w AS (SELECT rid, a, z, {before} AS wa, {after} AS wz FROM s JOIN d USING (rid)),
e AS (
  SELECT rid, coalesce(lag(z) OVER o, 1) AS x, a - 1 AS y, coalesce(lag(wz) OVER o, 1) AS wx, wa - 1 AS wy FROM w WINDOW o AS (PARTITION BY rid ORDER BY a)
  UNION ALL SELECT d.rid, coalesce(max(z), 1), octet_length(any_value(b)), coalesce(max(wz), 1), octet_length(any_value(b)) FROM d LEFT JOIN w ON w.rid = d.rid GROUP BY d.rid
), k AS (
  SELECT rid, string_agg(CASE WHEN y >= x THEN hex(b[x : y]) ELSE '' END, '' ORDER BY x) AS kept, string_agg(CASE WHEN wy >= wx THEN decode(b[wx : wy]) ELSE '' END, '' ORDER BY x) AS text
  FROM e JOIN d USING (rid) GROUP BY rid
),
c AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256, text
FROM d JOIN k USING (rid) LEFT JOIN c USING (rid)
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), d AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS UBIGINT))), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 20 AS kind
  FROM k, tab
), g AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copy
  FROM d
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS i FROM g),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (
  SELECT c, i, turn, role, text, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY o.conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY o.conv_id ORDER BY i) || left(role, 1) AS pair
  FROM o JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
), ways AS (
  SELECT [{'q': '', 'r': 's', 'ins': ''}, {'q': '', 'r': 'u', 'ins': ''}, {'q': '', 'r': 'a', 'ins': 'user'}, {'q': 's', 'r': 'u', 'ins': ''}, {'q': 's', 'r': 'a', 'ins': 'user'},
    {'q': 'u', 'r': 'a', 'ins': ''}, {'q': 'u', 'r': 'u', 'ins': 'assistant'}, {'q': 'a', 'r': 'u', 'ins': ''}, {'q': 'a', 'r': 'a', 'ins': 'user'}] AS ways
), dp AS (
  SELECT c, CAST(0 AS BIGINT) AS i, [{'r': '', 'k': CAST(0 AS BIGINT), 'a': '', 't': ''}] AS best FROM c
  UNION ALL
  SELECT dp.c, f.i, list_transform(['', 's', 'u', 'a'], lambda r: list_min(list_filter(list_concat(
      list_transform(best, lambda b: {'r': b.r, 'k': b.k + 3, 'a': b.a || 'D', 't': b.t}),
      flatten(list_transform(list_filter(best, lambda b: b IS NOT NULL AND f.fault NOT IN ('blank', 'duplicate')), lambda b: list_transform(
        list_filter(ways, lambda w: w.q = b.r AND (w.r <> 's' OR f.initial = 's')),
        lambda w: {'r': w.r,
          'k': CAST(b.k + (CASE WHEN w.ins = '' THEN 0 ELSE 2 END) + (CASE WHEN w.r = f.initial THEN 0 ELSE 2 END) + (CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END) AS BIGINT),
          'a': b.a || (CASE WHEN w.ins = '' THEN '' ELSE 'I' END) || (CASE WHEN w.r = f.initial THEN 'K' ELSE 'R' END),
          't': b.t || (CASE WHEN w.ins = '' THEN '' ELSE chr(10) || w.ins || ':' END) || chr(10)
            || (CASE WHEN w.r = f.initial THEN f.role WHEN w.r = 'u' THEN 'user' ELSE 'assistant' END) || ':' || f.text})))
    ), lambda x: x.r = r)))
  FROM dp JOIN f ON f.c = dp.c AND f.i = dp.i + 1, ways
), e AS (
  SELECT c, list_min(list_transform(list_filter(best, lambda b: b.r IS NOT NULL), lambda b: {
    'k': b.k + (CASE b.r WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END), 'a': b.a || (CASE b.r WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END),
    't': b.t || (CASE b.r WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END)})) AS x
  FROM dp QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1
), n AS (
  SELECT c, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  x.k AS cost, x.a AS audit, sha256(x.t[2:]) AS repaired_sha256
FROM c JOIN e USING (c) LEFT JOIN n USING (c)
"""


def _op12_sql() -> str:
    parts, entries = codes.PARTS, codes.ENTRIES
    near = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT rid, p, min(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) * {entries} + entry) AS m FROM x JOIN b{r} b USING (p) GROUP BY rid, p
)"""  # noqa: E731
    rounds = "".join(f""", {near(r)}, b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(u.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, m % {entries} AS entry, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} JOIN x USING (rid, p)) GROUP BY ALL) GROUP BY p, entry
  ) u ON u.p = b.p AND u.entry = b.entry
)""" for r in range(codes.ROUNDS))  # fmt: skip
    last = codes.ROUNDS
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), x AS MATERIALIZED (SELECT rid, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS v FROM e, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, v FROM x WHERE rid <= {entries}){rounds}, {near(last)},
s AS (SELECT rid, string_agg(printf('%02x', CAST(m % {entries} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{last} GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, i)) AS sha FROM (SELECT p, entry, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM b{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM e JOIN s USING (rid), h
"""


QUERIES = {"op1_bpe": op1_bpe, "op2_licenses": op2_licenses, "op3_neardup": op3_neardup, "op4_repeats": op4_repeats, "op5_packing": op5_packing, "op6_langid": op6_langid, "op7_media": op7_media, "op8_quality": op8_quality, "op9_sharding": op9_sharding, "op10_topk": op10_topk, "op11_turns": op11_turns, "op12_codes": op12_codes, "op13_bestfit": op13_bestfit}
ORACLES = {"op2_licenses": _op2_sql(), "op4_repeats": _op4_sql(), "op3_neardup": OP3_SQL, "op10_topk": OP10_SQL, "op11_turns": OP11_SQL, "op12_codes": _op12_sql()}
