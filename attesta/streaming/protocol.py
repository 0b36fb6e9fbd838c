"""Validation of ordered event streams, in batch and in Structured Streaming by the same state machine."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Event types, and phases in their order.
TYPES = ["progress", "artifact", "result", "error"]
PHASES = ["source_analysis", "docling_alignment", "candidate_evaluation", "correction_proposal", "correction_export"]
TERMINAL = ("result", "error")
EVENT = "stream string, seq long, type string, name string, sequence int, bytes long, phase int, completed long, total long"
OUT = "stream string, seq long, accepted boolean, reason string"


def initial() -> dict[str, Any]:
    return {"ended": False, "failed": None, "next": {}, "bytes": 0, "progress": None}


def step(state: dict[str, Any], event: dict[str, Any], budget: int) -> str | None:
    """The reason why an event is refused, or null; the state moves on. After a refusal nothing more is accepted."""
    reason = state["failed"] and "after_failure"
    if not reason and state["ended"]:
        reason = "event_after_terminal"
    if not reason and event["type"] not in TYPES:
        reason = "event_type_unknown"
    if not reason and event["type"] == "artifact":
        if event["sequence"] != state["next"].get(event["name"], 0):
            reason = "artifact_sequence_invalid"
        elif state["bytes"] + (event["bytes"] or 0) > budget:
            reason = "artifact_budget_exceeded"
        else:
            state["next"][event["name"]] = event["sequence"] + 1
            state["bytes"] += event["bytes"] or 0
    if not reason and event["type"] == "progress":
        now, was = (event["phase"], event["completed"], event["total"]), state["progress"]
        if was and (now[0] < was[0] or (now[0] == was[0] and (now[2] != was[2] or now[1] < was[1]))):
            reason = "progress_regressed"
        else:
            state["progress"] = list(now)
    if not reason and event["type"] in TERMINAL:
        state["ended"] = True
    if reason and not state["failed"]:
        state["failed"] = reason
    return reason


def _told(key: str, rows: pd.DataFrame, state: dict[str, Any], budget: int) -> pd.DataFrame:
    out = []
    for event in rows.sort_values("seq", kind="stable").to_dict("records"):
        reason = step(state, event, budget)
        out.append((key, event["seq"], reason is None, reason))
    return pd.DataFrame(out, columns=["stream", "seq", "accepted", "reason"])


def validate(events: DataFrame, budget: int) -> DataFrame:
    """stream, seq, accepted, reason of each event, streams apart."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _told(group["stream"].iloc[0], group, initial(), budget)

    return events.groupBy("stream").applyInPandas(run, OUT)


class Validator(StatefulProcessor):
    """The same over a stream: the state of each key is kept as JSON."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("protocol", "json string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else initial()
        whole = pd.concat(list(rows))
        out = _told(key[0], whole, state, self.budget)
        self.state.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def validate_stream(events: DataFrame, budget: int) -> DataFrame:
    """``validate`` for a streaming frame; in each micro-batch a stream's events are taken by rising seq."""
    return events.groupBy("stream").transformWithStateInPandas(Validator(budget), outputStructType=OUT, outputMode="append", timeMode="none")


def validate_stream_pandas(events: DataFrame, budget: int) -> DataFrame:
    """``validate_stream`` on the older state API, for state stores that the newer one doesn't run on."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple[str], rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else initial()
        out = _told(key[0], pd.concat(list(rows)), state, budget)
        held.update((json.dumps(state),))
        yield out

    return events.groupBy("stream").applyInPandasWithState(run, OUT, "json string", "append", GroupStateTimeout.NoTimeout)


def admitted(parts: DataFrame, keys: list[str], order: str, size: str, budget: Column | int) -> DataFrame:
    """Append ``admitted``: whether the running total up to the row stays within the budget; what follows an excess stays out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("admitted", F.sum(size).over(w) <= budget)


def chunks(artifacts: DataFrame, content: str, size: int) -> DataFrame:
    """Each content in ordered base64 chunks: name, sequence, content_base64."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / size)).cast("int")
    at = artifacts.select("name", content, F.explode(F.sequence(F.lit(0), n - 1)).alias("sequence"))
    return at.select("name", "sequence", F.translate(F.base64(F.substring(F.col(content).cast("binary"), F.col("sequence") * size + 1, F.lit(size))), "\r\n", "").alias("content_base64"))


def reassembled(parts: DataFrame) -> DataFrame:
    """name, content, bytes, sha256, chunks of artifacts whose sequences count from 0 without gaps."""
    held = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("sequence", "content_base64"))).alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, F.unbase64(x["content_base64"])))
    dense = F.transform("p", lambda x: x["sequence"]) == F.sequence(F.lit(0), F.size("p") - 1)
    return held.where(dense).select("name", whole.alias("content"), F.size("p").alias("chunks")).select("name", "content", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "chunks")
