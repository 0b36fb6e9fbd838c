"""Tables that one round of a fixpoint hands to the next."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
#: Spark removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _sweep() -> None:
    for path, spark in _written.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already; the folder's owner has to clear it
            return


def cut(df: DataFrame) -> DataFrame:
    """``df``, worked out once, written to the shared folder and read back: lineages stay short, and a lost executor loses none of it.

    The shuffle files of its query go as soon as it is written. The folder is ``spark.checkpoint.dir``; where it is unset and all run on one machine, a default. Tables go when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    path = f"{(folder or '/tmp/checkpoints').rstrip('/')}/attesta-round-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written[path] = spark
    seen = Observation()
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = seen.get["n"]
    return out


def rows(table: DataFrame) -> int:
    """How many rows a table from ``cut`` has: counted as it was written."""
    return table._rows
