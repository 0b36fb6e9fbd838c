"""Sinks and recovery: NDJSON, append-only checkpoints, and what is left of a broken run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_evidence(rows: DataFrame, path: str) -> None:
    """A JSON line per row, compressed; an existing folder is never overwritten."""
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def append_records(rows: DataFrame, path: str) -> None:
    """Finished records are added to those that are there."""
    rows.write.mode("append").parquet(path)


def pending(work: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of ``work`` that the checkpoint doesn't hold yet."""
    try:
        done = spark.read.parquet(path)
        done.schema  # noqa: B018
    except Exception:
        return work
    return work.join(done.select(key).distinct(), key, "left_anti")


def recovered(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Lines as records; a line that can't be read keeps its bytes in hex, with a reason."""
    read = lines.withColumn("record", F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("record").isNull() | F.col("record._corrupt_record").isNotNull()
    return read.withColumns({"reason": F.when(bad, "checkpoint_unreadable"), "raw_hex": F.when(bad, F.hex(F.encode(column, "UTF-8")))})


def write_per_key(rows: DataFrame, path: str, key: str) -> None:
    """A folder for each key, written once."""
    rows.write.mode("errorifexists").partitionBy(key).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; files that end in .gz are unpacked."""
    return spark.read.schema(schema).json(path)


def captured(rows: DataFrame, path: str, **provenance: str) -> bool:
    """Write ``rows`` with their provenance as columns, unless the folder is there: then nothing is written, and False returned."""
    try:
        rows.withColumns({k: F.lit(v) for k, v in provenance.items()}).write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False
    return True


def lookup_files(lookups: DataFrame, key: str) -> DataFrame:
    """key, name, content of what is kept of each lookup (key, image, request, response, raw: binary, null if there is none).

    A lookup with a ``response`` succeeded: image, request and response. One that failed keeps image, request and the raw bytes, if any came.
    """
    file = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    last = F.when(F.col("response").isNotNull(), file("response.json", F.col("response"))).when(F.col("raw").isNotNull(), file("response.bin", F.col("raw")))
    files = F.array_compact(F.array(file("crop.png", F.col("image")), file("request.json", F.col("request")), last))
    return lookups.select(key, F.inline(files))
