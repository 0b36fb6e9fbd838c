"""Queries on stores: micro-batches that are written once, artifacts judged by their table, and guarded changes of a version."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import artifacts
from ..sources.testdata import table
from ..streaming import stores
from .registry import query


def _fresh(spark, name):
    """A new folder where the driver and the executors both can write."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/attesta-{name}-{uuid.uuid4().hex}"


@query("""SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS different, true AS rises FROM events GROUP BY event_type""")
def l02_l03_consumed_epochs(spark, sf_dir):
    """The table as a stream, consumed in micro-batches whose progress is observed."""
    schema = table(spark, sf_dir, "events").select("event_id", "event_type").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")
    at = _fresh(spark, "epochs")
    sink, told = stores.Epochs(spark, f"{at}/out"), []
    stores.consumed(stream, sink, f"{at}/state", told.append)
    rises = stores.monotonic(sink.progress()) and [t["completed"] for t in told] == [r["completed"] for r in sink.records()]
    rows = sink.rows("event_id long, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("different"), F.lit(rises).alias("rises"))


_ROLES = [("user", True), ("assistant", True), ("system", False)]


@query("""WITH r AS (SELECT conv_id, CASE WHEN role = 'user' AND conv_id % 8 = 3 AND turn > 1 THEN 'prompt' ELSE role END AS name FROM conversations WHERE turn < 3),
c AS (SELECT conv_id, name, count(*) AS n FROM r GROUP BY 1, 2),
j AS (SELECT conv_id, count(*) FILTER (name NOT IN ('user', 'assistant', 'system')) AS unknown, max(n) AS most, count(*) FILTER (name IN ('user', 'assistant')) AS have FROM c GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS job, CASE WHEN code IS NULL THEN 'succeeded' ELSE 'failed' END AS status, code
FROM (SELECT conv_id, CASE WHEN unknown > 0 THEN 'artifact_unknown' WHEN most > 1 THEN 'artifact_duplicated' WHEN have < 2 THEN 'artifact_required_missing' END AS code FROM j)""")
def a45_j10_artifacts(spark, sf_dir):
    """The first turns of each conversation as the artifacts of a job, written as files and judged by the table of names."""
    c = table(spark, sf_dir, "conversations").where("turn < 3")
    name = F.when((F.col("role") == "user") & (F.col("conv_id") % 8 == 3) & (F.col("turn") > 1), "prompt").otherwise(F.col("role"))
    path = _fresh(spark, "artifacts")
    artifacts.write(c.select(F.col("conv_id").alias("job"), name.alias("name"), F.col("text").cast("binary").alias("content")), path)
    wanted = spark.createDataFrame(_ROLES, "name string, required boolean")
    return artifacts.judged(artifacts.listed(spark, path), wanted).select("job", "status", "code")


# Orders change from open to done; every tenth change expects another status, and every fifteenth order is changed twice.
@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderkey % 10 = 4 AS wrong, o_orderkey % 15 = 7 AS twice FROM orders),
c AS (SELECT *, CASE WHEN status = 'completed' THEN 'terminal_row' WHEN wrong OR twice THEN 'guard_failed' END AS code, id % 3 <> 0 AS asked FROM r)
SELECT id, CASE WHEN asked AND code IS NULL THEN 'interrupted' ELSE status END AS status, CASE WHEN asked THEN code END AS code, 2 AS version, 'version_conflict' AS loser FROM c""")
def j09_j10_guarded_versions(spark, sf_dir):
    """Two writers read one version: the first one's changes make the next, the second one gets a code."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    held = stores.Versions(spark, _fresh(spark, "versions"))
    held.propose(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")), 0)
    rows = held.rows(1)
    some = rows.where("id % 3 <> 0").select("id", F.when(F.col("id") % 10 == 4, "absent").otherwise(F.col("status")).alias("from_status"), F.lit("interrupted").alias("status"))
    changes = some.unionAll(some.where("id % 15 = 7"))
    after, codes = stores.guarded(rows, changes, "id")
    held.propose(after, 1)
    loser = held.propose(rows, 1)
    return held.rows().join(codes, "id", "left").select("id", "status", "code", F.lit(held.latest()).alias("version"), F.lit(loser).alias("loser"))
