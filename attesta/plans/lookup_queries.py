"""Queries on batched lookups: what users ask in a conversation is the batch, what is answered in it comes from the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from ..sources.testdata import table
from .registry import query

# The first attempt offers all that isn't the user's, the second only what assistants say; it fails where conv_id % 10 = 7.
BATCHES_SQL = """q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, max(position) AS wanted FROM q GROUP BY conv_id),
a AS (
  SELECT conv_id, 1 AS attempt, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS given, NULL AS failure FROM conversations WHERE role <> 'user' AND conv_id % 6 <> 5
  UNION ALL SELECT conv_id, 2, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn), count(*) OVER (PARTITION BY conv_id), CASE WHEN conv_id % 10 = 7 THEN 'lookup_http_error' END FROM conversations WHERE role = 'assistant' AND conv_id % 6 <> 5
), t AS (SELECT a.*, given = wanted AND failure IS NULL AS sound, coalesce(failure, CASE WHEN given <> wanted THEN 'batch_length_mismatch' END) AS code, wanted FROM a LEFT JOIN s USING (conv_id)),
b AS (SELECT conv_id, min(attempt) FILTER (sound) AS sound, max(attempt) AS last, arg_max(code, attempt) AS code FROM t GROUP BY conv_id),
z AS (
  SELECT q.conv_id, q.turn, q.text, CAST(q.position AS INTEGER) AS position, t.answer, coalesce(b.sound, b.last) AS attempt, CASE WHEN b.sound IS NULL THEN coalesce(b.code, 'batch_response_missing') END AS failure
  FROM q LEFT JOIN b USING (conv_id) LEFT JOIN t ON t.conv_id = q.conv_id AND t.attempt = b.sound AND t.position = q.position
)"""


def _batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    requests = c.where("role = 'user'").select("conv_id", "turn", "text")
    offer = lambda rows, attempt, failure: rows.select("conv_id", F.lit(attempt).alias("attempt"), F.col("turn").alias("position"), F.col("text").alias("answer"), failure.alias("failure"))
    answers = c.where("conv_id % 6 <> 5")
    first = offer(answers.where("role <> 'user'"), 1, F.lit(None).cast("string"))
    second = offer(answers.where("role = 'assistant'"), 2, F.when(F.col("conv_id") % 10 == 7, "lookup_http_error"))
    return lookups.zipped(requests, first.unionAll(second), ["conv_id"], "turn")


@query(f"WITH {BATCHES_SQL} SELECT conv_id, turn, position, answer, attempt, failure FROM z")
def a47_batched_lookup(spark, sf_dir):
    return _batches(spark, sf_dir)[0].select("conv_id", "turn", "position", "answer", "attempt", "failure")


@query(f"WITH {BATCHES_SQL} SELECT DISTINCT conv_id FROM t WHERE wanted IS NULL")
def a47_unasked_batches(spark, sf_dir):
    return _batches(spark, sf_dir)[1]


@query(f"""WITH {BATCHES_SQL}, p AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN reverse(text) END AS proven, CASE WHEN length(text) % 7 = 0 THEN 'target_not_eligible' END AS ineligible FROM z),
m AS (SELECT *, coalesce(proven, answer) AS proposal, length(coalesce(proven, answer)) % 2 = length(text) % 2 AS holds FROM p)
SELECT conv_id, turn, CASE WHEN ineligible IS NULL THEN CASE WHEN proven IS NULL THEN 'lookup' ELSE 'deterministic' END END AS method,
  CASE WHEN ineligible IS NOT NULL THEN 'rejected' WHEN proposal IS NULL THEN 'failed' WHEN holds THEN 'accepted' ELSE 'rejected' END AS outcome,
  coalesce(ineligible, CASE WHEN proposal IS NULL THEN coalesce(failure, 'batch_response_missing') WHEN NOT holds THEN 'proposal_not_proven' END) AS code,
  CASE WHEN ineligible IS NULL AND holds THEN proposal END AS proposal FROM m""")
def k20_k21_corrections(spark, sf_dir):
    text, n = F.col("text"), F.length("text")
    targets = _batches(spark, sf_dir)[0]
    told = lookups.correction_outcomes(targets, F.when(n % 5 == 0, F.reverse(text)), F.length("proposal") % 2 == n % 2, F.when(n % 7 == 0, "target_not_eligible"))
    return told.select("conv_id", "turn", "method", "outcome", "code", "proposal")
