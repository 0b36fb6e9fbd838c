"""What is told of a text's characters where a row holds the whole text: nothing is shuffled, and no row is made of a character that isn't told of.

Rows are doc_id and text; characters stand on lines of so many. Results are those of the operators over rows of characters
(``islands``, ``metrics``), which texts that share an id still go through: ``by_text`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import cycle
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut, rows

#: Ids that are broadcast at most, and characters that a task handles at once.
FEW, BLOCK = 100_000, 400_000
_KINDS = pa.array(["digit", "letter", "other"])


def by_text(docs: DataFrame, held: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``held`` of the texts whose id no other one has, and ``spread`` of the others."""
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__again")))
    if not rows(again):
        return held(docs)
    ids = F.broadcast(again) if rows(again) <= FEW else again
    same = docs["doc_id"].eqNullSafe(ids["__again"])
    return held(docs.join(ids, same, "left_anti")).unionByName(spread(docs.join(ids, same, "left_semi")))


def _each(texts: DataFrame, tell: Callable[[str], object], name: str, kind: str) -> DataFrame:
    """doc_id and what is told of each text that isn't empty."""
    texts = texts.where("text <> ''").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([tell(t.as_py()) for t in batch["text"]], pa.bool_() if kind == "boolean" else pa.string())], ["doc_id", name])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {name} {kind}")


def ordered_digest(texts: DataFrame, width: int) -> DataFrame:
    """SHA-256 of each character with its column, joined by line feeds."""
    columns = [f":{i}" for i in range(width)]
    return _each(texts, lambda t: sha256("\n".join(map(add, t, cycle(columns))).encode()).hexdigest(), "digest", "string")


def _falls(text: str) -> bool:
    chars = sorted(set(text))
    return any(text.rfind(a) > text.find(b) for a, b in zip(chars, chars[1:], strict=False))


def out_of_order(texts: DataFrame) -> DataFrame:
    """Whether the places fail to rise along the characters in order: those of one character rise, so its last is held against the next one's first."""
    return _each(texts, _falls, "out_of_order", "boolean")


def dense(texts: DataFrame) -> DataFrame:
    """Whether the characters but blanks stand without gaps; texts of blanks alone have no row."""
    inner = F.trim("text")
    return texts.where(inner != "").select("doc_id", (~F.contains(inner, F.lit(" "))).alias("dense"))


def grouped_lines(texts: DataFrame, width: int, having: str) -> DataFrame:
    """doc_id, line, text and n of the lines that a pattern is found in."""
    lines = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("line", "text"))
    return lines.where(F.col("text").rlike(having)).select("doc_id", F.col("line").cast("long").alias("line"), "text", F.length("text").cast("long").alias("n"))


def kind_runs(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, run, kind, first, last of consecutive digits, letters or others on one line."""
    # A character each: 0 to 9, a for letters, a blank for others.
    kinds = F.regexp_replace(F.regexp_replace("text", r"\p{L}", "a"), "[^a0-9]", " ")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, run long, kind string, first long, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole["kinds"]).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                chars = np.frombuffer("".join(whole["kinds"].slice(a, b - a).to_pylist()).encode(), np.uint8)
                codes = np.where(chars == ord("a"), 1, np.where(chars == ord(" "), 2, 0))
                starts = np.cumsum(sizes[a:b]) - sizes[a:b]
                of = np.repeat(np.arange(b - a), sizes[a:b])
                place = np.arange(len(chars)) - starts[of]
                begins = place % width == 0
                begins[1:] |= np.diff(codes) != 0
                at = np.flatnonzero(begins)
                last = np.concatenate([at[1:], [len(chars)]]) - 1
                number = np.arange(len(at)) - np.searchsorted(at, starts)[of[at]]
                yield pa.RecordBatch.from_arrays([whole["doc_id"].take(pa.array(of[at] + a)), pa.array(number), _KINDS.take(pa.array(codes[at])), pa.array(place[at]), pa.array(place[last])], ["doc_id", "run", "kind", "first", "last"])

    return texts.where("text <> ''").select("doc_id", kinds.alias("kinds")).mapInArrow(run, schema)
