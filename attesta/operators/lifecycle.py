"""Versions of records and their jobs: latest rows, guarded transitions, reconciliation.

Spark has no row locks: a transition is a batch of proposed changes applied to the latest rows, each guarded by the
state that it expects; rows whose guard fails stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ["queued", "running"]
TERMINAL = ["completed", "failed", "interrupted"]
STALE = "INTERVAL 5 MINUTES"


def transition(rows: DataFrame, claims: DataFrame, contract: str) -> DataFrame:
    """Start claimed rows (claims: id, job_id): queued -> running.

    The same job again on a running row: failed, as interrupted. A row of another contract: failed, as obsolete. Anything else
    stays. Columns of the result: id, status, job_id, contract, code, changed.
    """
    c = claims.select("id", F.col("job_id").alias("__job")).dropDuplicates(["id"])
    met = rows.join(c, "id", "left")
    claimed = F.col("__job").isNotNull()
    case = (
        F.when(~claimed | ~F.col("status").isin(*ACTIVE), "keep")
        .when(F.col("contract") != contract, "obsolete")
        .when(F.col("status") == "queued", "start")
        .when(F.col("job_id") == F.col("__job"), "interrupted")
        .otherwise("keep")
    )
    met = met.withColumn("__case", case)
    status = F.when(F.col("__case") == "start", "running").when(F.col("__case").isin("obsolete", "interrupted"), "failed").otherwise(F.col("status"))
    return met.select("id", status.alias("status"), F.when(F.col("__case") == "start", F.col("__job")).otherwise(F.col("job_id")).alias("job_id"), "contract", F.when(F.col("__case").isin("obsolete", "interrupted"), F.col("__case")).alias("code"), (F.col("__case") != "keep").alias("changed"))


def orphaned(records: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Queued records, older than five minutes, whose job is gone."""
    return records.where((F.col("status") == "queued") & (F.col("updated_at") <= now - F.expr(STALE))).join(jobs.select("job_id"), "job_id", "left_anti")


def failed_while_active(records: DataFrame, failures: DataFrame) -> DataFrame:
    """Active records whose job has a failed execution."""
    return records.where(F.col("status").isin(*ACTIVE)).join(failures.select("job_id"), "job_id", "left_semi")


def adopt(records: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Stale staging records: id, action (adopt or fail), job_id.

    The job is the one with the record's key, else the first one whose arguments name the record's id in full.
    """
    stale = records.where((F.col("status") == "staging") & (F.col("updated_at") <= now - F.expr(STALE)))
    keyed = jobs.groupBy("job_key").agg(F.min("job_id").alias("__keyed"))
    named = jobs.withColumn("__named", F.regexp_extract("arguments", r'/(\d+)"', 1)).where("__named <> ''").groupBy(F.col("__named").try_cast("long").alias("__named")).agg(F.min("job_id").alias("__first"))
    met = stale.join(keyed, "job_key", "left").join(named, stale["id"] == named["__named"], "left")
    job = F.coalesce("__keyed", "__first")
    return met.select("id", F.when(job.isNotNull(), "adopt").otherwise("fail").alias("action"), job.alias("job_id"))


def attempt_history(attempts: DataFrame, most: int = 64) -> DataFrame:
    """id and each ancestor over parent_id, with the distance; depth is bounded by ``most``."""
    query = f"""
        WITH RECURSIVE chain(id, ancestor, distance) MAX RECURSION LEVEL {most} AS (
          SELECT id, parent_id, 1 FROM {{attempts}} WHERE parent_id IS NOT NULL
          UNION ALL
          SELECT c.id, a.parent_id, c.distance + 1 FROM chain c JOIN {{attempts}} a ON a.id = c.ancestor WHERE a.parent_id IS NOT NULL
        ) SELECT id, ancestor, distance FROM chain"""
    return attempts.sparkSession.sql(query, attempts=attempts.select("id", "parent_id"))


def retry(latest: DataFrame) -> DataFrame:
    """A next version, queued, where the last one failed or was interrupted; terminal rows are never rewritten."""
    return latest.where(F.col("status").isin("failed", "interrupted")).select("parent", (F.col("version") + 1).alias("version"), F.lit("queued").alias("status"))


def processing_status(attempt: Column, qualification: Column, verdict: Column) -> Column:
    """One label for a document, from its conversion first, then its qualification, then the verdict."""
    return (
        F.when(attempt.isNull(), "not_started").when(attempt == "queued", "conversion_queued").when(attempt == "running", "conversion_running")
        .when(attempt == "failed", "conversion_failed").when(attempt == "interrupted", "conversion_interrupted")
        .when(qualification.isNull(), "converted").when(qualification == "queued", "qualification_queued").when(qualification == "running", "qualification_running")
        .when(qualification == "failed", "qualification_failed").when(verdict == "conformant_within_scope", "qualified").otherwise("qualified_with_findings")
    )


def reconciled(records: DataFrame, jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """id, action of every record that a pass changes; the passes go in order, and the first one to hold decides."""
    failed = failed_while_active(records, failures).select("id", F.lit("failed_execution").alias("action"))
    lost = orphaned(records, jobs, now).select("id", F.lit("orphaned").alias("action"))
    adopted = adopt(records, jobs, now).select("id", "action")
    ranked = failed.withColumn("rank", F.lit(1)).unionByName(lost.withColumn("rank", F.lit(2))).unionByName(adopted.withColumn("rank", F.lit(3)))
    return ranked.groupBy("id").agg(F.min_by("action", "rank").alias("action"))
