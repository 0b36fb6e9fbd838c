"""Streaming sinks that are restarted, versions with two writers, artifacts of runs that fail, and lookups that don't answer."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import lookups
from attesta.sources import artifacts
from attesta.streaming import stores


def test_epochs_are_written_once_over_a_restart(spark, tmp_path):
    for part in range(4):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink, told = stores.Epochs(spark, str(tmp_path / "out"), total=40), []
    plain = sink.folder.create

    def dies(name, content):
        if content["epoch"] == 2:
            raise OSError("killed between data and marker")
        return plain(name, content)

    sink.folder.create = dies
    with pytest.raises(Exception, match="killed"):
        stores.consumed(stream, sink, str(tmp_path / "state"), told.append)
    assert sorted(r["id"] for r in sink.rows("id long").collect()) == sorted(r["id"] for r in sink.rows("id long").distinct().collect()) and len(told) == 2
    again = stores.Epochs(spark, str(tmp_path / "out"), total=40)
    stores.consumed(stream, again, str(tmp_path / "state"), told.append)
    assert sorted(r["id"] for r in again.rows("id long").collect()) == list(range(40))
    assert [t["completed"] for t in told] == [10, 20, 30, 40] and stores.monotonic(again.progress())
    again.write(spark.range(5), 3)
    assert again.rows("id long").count() == 40
    assert not stores.monotonic(spark.createDataFrame([("p", 0, 5, 9), ("p", 1, 4, 9)], "phase string, epoch long, completed long, total long"))


def test_two_writers_one_wins(spark, tmp_path):
    table = stores.Versions(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "queued", "a"), (2, "completed", "b"), (3, "running", None)], "id long, status string, note string")
    assert table.propose(rows, 0) is None and table.latest() == 1
    changes = spark.createDataFrame([(1, "queued", "running"), (2, "completed", "queued"), (3, "queued", "failed"), (9, "queued", "failed")], "id long, from_status string, status string")
    after, codes = stores.guarded(table.rows(), changes, "id")
    assert {r["id"]: r["code"] for r in codes.collect()} == {1: None, 2: stores.TERMINAL_ROW, 3: stores.GUARD, 9: stores.GUARD}
    twice = changes.where("id = 1").unionAll(changes.where("id = 1"))
    assert stores.guarded(table.rows(), twice, "id")[1].first()["code"] == stores.GUARD
    assert table.propose(after, 1) is None
    assert table.propose(rows, 1) == stores.CONFLICT  # it read version 1 as well
    assert sorted(map(tuple, table.rows().collect())) == [(1, "running", "a"), (2, "completed", "b"), (3, "running", None)]
    assert sorted(r["status"] for r in table.rows(1).collect()) == ["completed", "queued", "running"]
    assert table.update(lambda t: t.withColumn("note", F.lit("x"))) == 3 and {r["note"] for r in table.rows().collect()} == {"x"}
    assert len(table.folder.names("data")) == 3  # a loser leaves nothing


WANTED = [("report", True), ("corrections", True), ("derived_html", False)]


def test_artifacts_of_runs_that_succeed_and_fail(spark, tmp_path):
    path = str(tmp_path / "sink")
    wanted = spark.createDataFrame(WANTED, "name string, required boolean")
    rows = [("1", "report", b"r1"), ("1", "corrections", b""), ("1", "derived_html", b"<p>"), ("2", "report", b"r2"), ("3", "report", None), ("3", "corrections", b"c"), ("3", "other", b"o"), ("4/..", "report", b"r"), ("4/..", "report", b"r"), ("4/..", "corrections", b"c")]
    frame = spark.createDataFrame([(j, n, c and bytearray(c)) for j, n, c in rows], "job string, name string, content binary")
    artifacts.write(frame.repartition(3), path)
    got = {r["job"]: (r["status"], r["code"]) for r in artifacts.judged(artifacts.listed(spark, path), wanted).collect()}
    assert got == {"1": ("succeeded", None), "2": ("failed", artifacts.MISSING), "3": ("failed", artifacts.UNKNOWN), "4/..": ("failed", artifacts.TWICE)}
    told = {(r["job"], r["name"]): r for r in artifacts.listed(spark, path).collect()}
    assert (tmp_path / "sink" / told["1", "report"]["file"]).read_bytes() == b"r1" and told["1", "corrections"]["bytes"] == 0

    @F.udf("binary")
    def breaks(job):
        if job == "7":
            raise ValueError("broken")
        return b"x"

    bad = spark.createDataFrame([(str(k), "report") for k in (5, 6, 7)], "job string, name string").coalesce(1).withColumn("content", breaks("job"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        with pytest.raises(Exception, match="broken|WRITE|abort"):
            artifacts.write(bad, path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    after = {r["job"]: (r["status"], r["code"]) for r in artifacts.judged(artifacts.listed(spark, path), wanted).collect()}
    assert {k: v for k, v in after.items() if k in got} == got
    assert {v for k, v in after.items() if k not in got} <= {("failed", "run_aborted")} and "7" not in after


def test_lookups(spark):
    requests = spark.createDataFrame([(1, k, f"r{k}") for k in range(5)] + [(2, 0, "slow"), (3, 0, "short"), (4, 0, "raises"), (None, 0, "null")], "page int, n int, request string")

    def ask(batch):
        if batch == ["slow"]:
            time.sleep(5)
        if batch == ["raises"]:
            raise KeyError("no")
        return [] if batch == ["short"] else [x.upper() for x in batch]

    got = {(r["page"], r["n"]): (r["answer"], r["attempt"], r["failure"]) for r in lookups.asked(requests, ask, ["page"], "n", rows=2, most=2, seconds=0.5).collect()}
    assert got == {(1, k): (f"R{k}", 1, None) for k in range(5)} | {(2, 0): (None, 2, lookups.TIMEOUT), (3, 0): (None, 2, lookups.LENGTH), (4, 0): (None, 2, "KeyError"), (None, 0): ("NULL", 1, None)}


def test_zipped_answers(spark):
    requests = spark.createDataFrame([(1, 5), (1, 9), (2, 1), (3, 1), (None, 1)], "page int, n int")
    answers = spark.createDataFrame([(1, 1, 0, "only one", None), (1, 2, 7, "b", None), (1, 2, 3, "a", None), (2, 1, 0, None, "http"), (2, 9, 0, "too late", None), (8, 1, 0, "unasked", None), (None, 1, 0, "n", None)], "page int, attempt int, position int, answer string, failure string")
    told, strangers = lookups.zipped(requests, answers, ["page"], "n")
    assert {(r["page"], r["n"]): (r["answer"], r["attempt"], r["failure"]) for r in told.collect()} == {(1, 5): ("a", 2, None), (1, 9): ("b", 2, None), (2, 1): (None, 1, "http"), (3, 1): (None, None, lookups.ABSENT), (None, 1): ("n", 1, None)}
    assert [tuple(r) for r in strangers.collect()] == [(8,)]
    assert threading.active_count() < 50
