"""Every query against its SQL in DuckDB, over the smallest tables, and streaming against batch."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.plans import catalog, record_queries
from attesta.streaming import protocol

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v != v or str(v) in ("<NA>", "NaT"):
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].map(plain).values.tolist()))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(db.sql(catalog.ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_no_cross_product(spark):
    for name in ("c01_assign_glyphs", "c20_iou_pairs", "c34_padded_overlaps", "c14_c32_mapped_spans"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stream_equals_batch(spark, tmp_path):
    events = record_queries.protocol_events(spark, SF)
    want = {tuple(r) for r in protocol.validate(events, 400).collect()}
    cut = events.approxQuantile("seq", [0.5], 0)[0]
    events.where(F.col("seq") <= cut).coalesce(1).write.parquet(str(tmp_path / "in"))
    events.where(F.col("seq") > cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run = protocol.validate_stream_pandas(stream, 400).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {tuple(r) for r in spark.table("told").collect()} == want
