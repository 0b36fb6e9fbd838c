"""Which texts hold which of many parts, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of parts that one automaton holds; more parts are dealt to several passes.
PART_CHARS = 4_000_000


def contained(texts: DataFrame, parts: DataFrame, text_id: str, part_id: str) -> DataFrame:
    """Pairs (text_id, part_id), both long, where ``text`` holds ``part``. Empty or null parts and texts hold nothing.

    Parts are collected group by group, each of a bounded size; a group's automaton is sent to all tasks.
    """
    usable = parts.where(F.length("part") > 0).select(F.col(part_id).cast("long").alias("id"), "part")
    size = usable.agg(F.coalesce(F.sum(F.length("part")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-size // PART_CHARS))
    out = None
    for g in range(groups):
        held = [(r["id"], r["part"]) for r in usable.where(F.pmod(F.xxhash64("part"), F.lit(groups)) == g).toLocalIterator()]

        def run(batches: Iterator[pa.RecordBatch], held: list = held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            by: dict[str, list[int]] = {}
            for number, part in held:
                by.setdefault(part, []).append(number)
            for part, numbers in by.items():
                automaton.add_word(part, numbers)
            if by:
                automaton.make_automaton()
            for batch in batches:
                found = [(i, number) for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True) if by and text for number in sorted({n for _, ns in automaton.iter(text) for n in ns})]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], [text_id, part_id])

        met = texts.select(F.col(text_id).cast("long").alias("id"), "text").mapInArrow(run, f"{text_id} long, {part_id} long")
        out = met if out is None else out.union(met)
    return out
