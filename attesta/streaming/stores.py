"""Stores that many writers append to: micro-batches written once each, and versions of which one writer wins.

Data goes to a folder of its own first; a small file, made only if it isn't there yet, then says that it counts. A writer that dies in
between leaves a folder that nothing points to. Where the file system makes files exclusively (HDFS does), so do the stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed codes, and the states that a row doesn't leave.
CONFLICT, TERMINAL_ROW, GUARD = "version_conflict", "terminal_row", "guard_failed"
TERMINAL = ["completed", "failed", "interrupted", "succeeded"]


class _Folder:
    """Small files of a folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, content: dict) -> bool:
        """Whether the file could be made: it wasn't there."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            if self._fs.exists(self._at(name)):
                return False
            raise e
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def read(self, name: str) -> dict:
        where = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(where)).decode())
        finally:
            where.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Epochs:
    """A sink for ``foreachBatch``: a micro-batch that comes again, after a failure or a restart, is written once.

    Each one leaves a record of progress: how many rows it had, and how many there are so far.
    """

    def __init__(self, spark: SparkSession, path: str, phase: str = "source_analysis", total: int | None = None) -> None:
        self.folder, self.phase, self.total = _Folder(spark, path), phase, total

    def write(self, batch: DataFrame, epoch: int) -> None:
        if str(epoch) in self.folder.names("committed"):
            return
        data, seen = f"data/{epoch}-{uuid.uuid4().hex}", Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder.path}/{data}")
        n = seen.get["n"]
        done = sum(p["rows"] for p in self.records() if p["epoch"] < epoch)
        self.folder.create(f"committed/{epoch}", {"epoch": epoch, "data": data, "phase": self.phase, "rows": n, "completed": done + n, "total": self.total})

    def records(self) -> list[dict]:
        """Of each micro-batch that counts: epoch, data, phase, rows, completed, total."""
        return sorted((self.folder.read(f"committed/{name}") for name in self.folder.names("committed")), key=lambda r: r["epoch"])

    def rows(self, schema: str) -> DataFrame:
        """The rows of all micro-batches that count."""
        spark, found = self.folder.spark, self.records()
        if not found:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.folder.path}/{r['data']}" for r in found])

    def progress(self) -> DataFrame:
        """phase, epoch, completed, total, as rows."""
        rows = [(r["phase"], r["epoch"], r["completed"], r["total"]) for r in self.records()]
        return self.folder.spark.createDataFrame(rows, "phase string, epoch long, completed long, total long")


def consumed(stream: DataFrame, sink: Epochs, checkpoint: str, each: Callable[[dict], None] | None = None) -> None:
    """Run a stream over all that is there into the sink; ``each`` is told of every record of progress, in order, once per run."""
    told = {r["epoch"] for r in sink.records()}

    def write(batch: DataFrame, epoch: int) -> None:
        sink.write(batch, epoch)
        if each and epoch not in told:
            told.add(epoch)
            each(next(r for r in sink.records() if r["epoch"] == epoch))

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def guarded(rows: DataFrame, changes: DataFrame, key: str, terminal: list[str] = TERMINAL) -> tuple[DataFrame, DataFrame]:
    """The rows after ``changes`` (key, from_status, status), and what became of each change (key, code).

    A row that is terminal stays; another one changes if it has the status that the change expects. A change of a row that isn't there
    fails by its guard, and so do two changes of one row. Columns besides the status stay.
    """
    once = changes.groupBy(key).agg(F.count("*").alias("__n"), F.first("from_status").alias("__from"), F.first("status").alias("__to"))
    met = rows.join(once, key, "left")
    ended, asked = F.col("status").isin(*terminal), F.col("__n").isNotNull()
    applies = asked & ~ended & (F.col("__n") == 1) & F.col("status").eqNullSafe(F.col("__from"))
    after = met.select(*[F.when(applies, F.col("__to")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in rows.columns])
    before = rows.select(key, F.col("status").alias("__status"))
    code = F.when(F.col("__status").isin(*terminal), TERMINAL_ROW).when(~((F.col("__n") == 1) & F.col("__status").eqNullSafe(F.col("__from"))) | F.col("__status").isNull(), GUARD)
    return after, once.join(before, key, "left").select(key, code.alias("code"))


class Versions:
    """A table in versions: a writer says which version its change is of, and only the first one to say so wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = _Folder(spark, path)

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(map(int, self.folder.names("committed")), default=0)

    def rows(self, version: int | None = None) -> DataFrame:
        at = self.folder.read(f"committed/{version or self.latest()}")
        return self.folder.spark.read.schema(at["schema"]).parquet(f"{self.folder.path}/{at['data']}")

    def propose(self, rows: DataFrame, base: int) -> str | None:
        """Make ``rows`` the version after ``base``; a code where another writer has done so."""
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{data}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        if base == self.latest() and self.folder.create(f"committed/{base + 1}", {"data": data, "schema": schema}):
            return None
        self.folder.delete(data)
        return CONFLICT

    def update(self, change: Callable[[DataFrame], DataFrame], most: int = 5) -> int:
        """Apply a change to the last version, again where another writer was faster; the version made."""
        for _ in range(most):
            base = self.latest()
            if self.propose(change(self.rows(base)), base) is None:
                return base + 1
        raise RuntimeError(CONFLICT)


def monotonic(progress: DataFrame, order: Column | str = "epoch") -> bool:
    """Whether records of progress never fall, nor pass their total."""
    from ..operators.islands import progress_violations

    rows = progress.withColumn("__stream", F.lit(0)).withColumn("phase", F.lit(0)).withColumn("total", F.coalesce("total", F.lit(2**62)))
    return progress_violations(rows, ["__stream"], [order]).where("reason IS NOT NULL").isEmpty()
