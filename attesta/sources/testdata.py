"""Deterministic projections of plain tables onto the engine's input shapes, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, x0, y0, x1, y1, role: integer boxes from events."""
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("id"), (cents % 400).alias("x0"), (k * 4).cast("long").alias("y0"),
        F.when(F.col("event_type").isin("click", "view"), "oracle").otherwise("candidate").alias("role"),
    )
    return base.withColumns({"x1": F.col("x0") + 10 + F.col("id") % 30, "y1": F.col("y0") + 10 + F.col("id") % 20})


BOXES_SQL = """
boxes AS (
  SELECT user_id AS page, event_id AS id, cents % 400 AS x0, k * 4 AS y0, cents % 400 + 10 + event_id % 30 AS x1, k * 4 + 10 + event_id % 20 AS y1,
    CASE WHEN event_type IN ('click', 'view') THEN 'oracle' ELSE 'candidate' END AS role
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


#: Characters of a line.
WIDTH = 80


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, u, line, col: the characters of each document as glyphs of 5 x 10 on a grid of 6 x 12, on lines of 80."""
    return glyphs_of(table(spark, sf_dir, "documents"))


def glyphs_of(docs: DataFrame) -> DataFrame:
    chars = F.split("text", "")
    return (
        docs.select("doc_id", F.posexplode(chars).alias("seq", "u")).where("u <> ''")
        .select("doc_id", F.col("seq").cast("long").alias("seq"), "u", F.floor(F.col("seq") / WIDTH).alias("line"), (F.col("seq") % WIDTH).cast("long").alias("col"))
    )


GLYPHS_SQL = """
glyphs AS (
  SELECT doc_id, p - 1 AS seq, u, (p - 1) // 80 AS line, (p - 1) % 80 AS col
  FROM (SELECT doc_id, unnest(c) AS u, unnest(range(1, len(c) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(text, '(?s:.)') AS c FROM documents))
)"""


def lines(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """doc_id, line, t: each whole text on lines of so many characters; an empty one has none."""
    n = F.ceil(F.length("text") / size).cast("int")
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("line"))
    return rows.select("doc_id", "line", F.col("text").substr(F.col("line") * size + 1, F.lit(size)).alias("t"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, end: words of six characters or more (split at blanks), stretched so that some overlap."""
    words = F.split("text", " ")
    before = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(before))
    from pyspark.sql import Window

    start = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start).where(F.length("w") >= 6)
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("w") + F.col("doc_id") % 9).cast("long").alias("end"))


SPANS_SQL = """
spans AS (
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(w) + doc_id % 9 AS BIGINT) AS "end"
  FROM (
    SELECT doc_id, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
  ) WHERE length(w) >= 6
)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, event_id, ts, phase (0 to 4), completed, total: progress events of each user."""
    cents = F.round(F.col("value") * 100).cast("long")
    phase = F.array_position(F.array(*[F.lit(x) for x in ("signup", "view", "click", "purchase", "error")]), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", "ts", phase.cast("int").alias("phase"), (cents % 20).alias("completed"), F.lit(20).cast("long").alias("total"))


PROGRESS_SQL = """
progress AS (
  SELECT user_id AS stream, event_id, ts, CAST(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) - 1 AS INTEGER) AS phase,
    CAST(round(value * 100) AS BIGINT) % 20 AS completed, CAST(20 AS BIGINT) AS total
  FROM events
)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, page (null for some), semantic, candidate, verdict, from orders."""
    page = F.when(F.col("o_orderkey") % 37 != 0, F.col("o_custkey") % 50)
    semantic = F.expr("CASE o_orderstatus WHEN 'F' THEN 'established' WHEN 'O' THEN 'ambiguous' ELSE 'conflicting' END")
    candidate = F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN 'matching' WHEN o_orderpriority LIKE '2%' THEN 'missing' WHEN o_orderpriority LIKE '3%' THEN 'contradicting' ELSE 'not_evaluated' END")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region_id"), page.alias("page"), semantic.alias("semantic"), candidate.alias("candidate"))
    verdict = F.when((F.col("semantic") == "established") & (F.col("candidate") == "matching"), "conformant_within_scope").when(F.col("candidate").isin("missing", "contradicting"), "contradicted").otherwise("non_verifiable")
    return rows.withColumn("verdict", verdict)


REGIONS_SQL = """
regions AS (
  SELECT *, CASE WHEN semantic = 'established' AND candidate = 'matching' THEN 'conformant_within_scope'
    WHEN candidate IN ('missing', 'contradicting') THEN 'contradicted' ELSE 'non_verifiable' END AS verdict
  FROM (
    SELECT o_orderkey AS region_id, CASE WHEN o_orderkey % 37 <> 0 THEN o_custkey % 50 END AS page,
      CASE o_orderstatus WHEN 'F' THEN 'established' WHEN 'O' THEN 'ambiguous' ELSE 'conflicting' END AS semantic,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'matching' WHEN o_orderpriority LIKE '2%' THEN 'missing'
        WHEN o_orderpriority LIKE '3%' THEN 'contradicting' ELSE 'not_evaluated' END AS candidate
    FROM orders)
)"""
