"""A sink of artifacts driven by a table of their names: files per job, whole runs that count or don't, and what a failed run has left.

``df.write.format("artifacts").mode("append").option("path", ...).save()`` takes job, name and content. Tasks write files and a manifest each. A
run counts once its marker is there, which names the manifests of the attempts that were committed; a run that fails leaves a marker
of that instead, and what it has written can be looked at. The driver sees one name per task.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "run string, manifest string, job string, name string, file string, bytes long, sha256 string"
# Fixed codes of jobs whose artifacts don't add up.
MISSING, UNKNOWN, TWICE = "artifact_required_missing", "artifact_unknown", "artifact_duplicated"


@dataclass
class _Written(WriterCommitMessage):
    manifest: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path, run

    def _open(self, name: str):
        files, at = fs.FileSystem.from_uri(f"{self.path}/{name}")
        files.create_dir(posixpath.dirname(at), recursive=True)
        return files.open_output_stream(at)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        manifest = f"{self.run}-{task.partitionId()}-{task.attemptNumber()}"
        with self._open(f"manifests/{manifest}.jsonl") as listed:
            for k, row in enumerate(rows):
                content = bytes(row["content"] or b"")
                file = f"files/{self.run}/{quote(str(row['job']), safe='')}/{task.partitionId()}-{task.attemptNumber()}-{k}-{quote(str(row['name']), safe='')}"
                with self._open(file) as out:
                    out.write(content)
                listed.write((json.dumps({"run": self.run, "manifest": manifest, "job": row["job"], "name": row["name"], "file": file, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}) + "\n").encode())
                listed.flush()
        return _Written(manifest)

    def _mark(self, status: str, manifests: list[str]) -> None:
        with self._open(f"runs/{self.run}.jsonl") as out:
            out.write("".join(json.dumps({"run": self.run, "status": status, "manifest": m}) + "\n" for m in manifests or [None]).encode())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._mark("committed", [m.manifest for m in messages if m])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._mark("aborted", [m.manifest for m in messages if m])


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "job string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), uuid.uuid4().hex)


def write(rows: DataFrame, path: str) -> None:
    """Write job, name, content as one run, which counts as a whole or not at all."""
    rows.sparkSession.dataSource.register(Artifacts)
    rows.select(F.col("job").cast("string"), F.col("name").cast("string"), F.col("content").cast("binary")).write.format("artifacts").mode("append").option("path", path).save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """job, name, file, bytes, sha256, run and status of all artifacts: those of committed runs are ``complete``, of others ``partial``.

    Of a committed run only the attempts that were committed are listed; a line of a manifest that was cut is left out.
    """
    lines = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(f"{path}/manifests")
    runs = spark.read.schema("run string, status string, manifest string").json(f"{path}/runs")
    counted = runs.where("status = 'committed'").select("manifest", F.lit(True).alias("__counts"))
    done = runs.where("status = 'committed'").select("run").distinct().withColumn("__done", F.lit(True))
    met = lines.where("file IS NOT NULL").join(counted, "manifest", "left").join(done, "run", "left").where("__counts OR __done IS NULL")
    return met.select("job", "name", "file", "bytes", "sha256", "run", F.when(F.col("__counts"), "complete").otherwise("partial").alias("status"))


def judged(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """job, run, status and code of each job's run: a complete run that has each required artifact once, and none that the table
    (name, required) hasn't, is ``succeeded``; others have ``failed``, with what they have left listed all the same."""
    table = F.broadcast(wanted.select("name", F.col("required").alias("__required"), F.lit(True).alias("__known")))
    required = wanted.where("required").count()
    each = artifacts.join(table, "name", "left").groupBy("job", "run", "status", "name").agg(F.count("*").alias("n"), F.max("__required").alias("required"), F.max("__known").alias("known"))
    whole = each.groupBy("job", "run", "status").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.max("n").alias("most"), F.count_if("required").alias("have"), F.sort_array(F.collect_set("name")).alias("names"))
    code = F.when(F.col("status") == "partial", "run_aborted").when(F.col("unknown") > 0, UNKNOWN).when(F.col("most") > 1, TWICE).when(F.col("have") < required, MISSING)
    return whole.withColumn("code", code).select("job", "run", F.when(F.col("code").isNull(), "succeeded").otherwise("failed").alias("status"), "code", "names")
