"""Best-fit packing of whole documents: fill a bin greedily, then exchange its smallest document for two that fit more tightly.

Which documents meet doesn't matter to a bin, only their lengths do. So bins are planned over the histogram of lengths, which
has no more rows than a window has tokens: a bin's lengths are chosen as for single documents, and the same bin is made again while
every length in it lasts as often as it needs it, which is what packing one bin after the other would do. Each piece then finds its
place by its rank among the pieces of its length. Nothing else is global, and the number of bins doesn't depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialise, slices, texts_of
from .packing import token_ids

WINDOW = 2048
END = 0
#: Characters whose tokens are held at once; a larger document stands alone.
STEP_CHARS = 1_000_000


@dataclass(frozen=True)
class Bins:
    """Bins of one kind: how many there are, and the lengths in each, in order."""

    many: int
    lengths: tuple[int, ...]


class _Stock:
    """How many unpacked documents there are of each length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)

    def largest(self, most: int, taken: dict[int, int]) -> int:
        """The largest length up to ``most`` of which one is left besides those taken; 0 if there is none."""
        at = bisect.bisect_right(self.lengths, most)
        while at:
            at -= 1
            n = self.lengths[at]
            if self.counts[n] > taken.get(n, 0):
                return n
        return 0

    def take(self, bins: Bins) -> None:
        for n in bins.lengths:
            self.counts[n] -= bins.many
            if not self.counts[n]:
                self.lengths.remove(n)


def _bin(stock: _Stock, window: int) -> tuple[list[int], int]:
    """The lengths of the next bin, and how often it can be made."""
    chosen: list[int] = []
    taken: dict[int, int] = {}
    room = window
    while room and (n := stock.largest(room, taken)):
        # As many of one length as fit and are there.
        copies = min(room // n, stock.counts[n] - taken.get(n, 0))
        chosen += [n] * copies
        taken[n] = taken.get(n, 0) + copies
        room -= n * copies
    needed = dict(taken)
    if room and len(chosen) > 1:
        smallest, gap = chosen[-1], room + chosen[-1]
        best, pair = smallest, None
        for a in stock.lengths[: bisect.bisect_right(stock.lengths, gap // 2)]:
            if stock.counts[a] <= taken.get(a, 0):
                continue
            b = stock.largest(gap - a, taken | {a: taken.get(a, 0) + 1})
            if b >= a and a + b > best:
                best, pair = a + b, (b, a)
                if best == gap:
                    break
        if pair:
            chosen[-1:] = pair
            for n in pair:
                needed[n] = needed.get(n, 0) + 1
    return chosen, min(stock.counts[n] // c for n, c in needed.items())


def plan(counts: dict[int, int], window: int = WINDOW) -> list[Bins]:
    """Bins that hold so many documents of each length (1 to ``window``).

    A kind of bin uses a length up to less than it needs of it for one more, so there are a few kinds for each length at most.
    """
    stock, out = _Stock(counts), []
    while stock.lengths:
        chosen, many = _bin(stock, window)
        out.append(Bins(many, tuple(chosen)))
        stock.take(out[-1])
    return out


def places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For each length and kind of bin that has it: the rank of the first such piece, how many a bin has, its first bin and offset."""
    rows, first, ranks = [], 0, {}
    for kind in bins:
        offset = 0
        for n in dict.fromkeys(kind.lengths):
            each = kind.lengths.count(n)
            rows.append((n, ranks.get(n, 0), each, first, offset))
            ranks[n] = ranks.get(n, 0) + each * kind.many
            offset += n * each
        first += kind.many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "bin", "offset"), table.T, strict=True))


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of each document's ids: longer documents are cut, so that the first piece takes what isn't a whole window.

    ``task`` and ``nth`` number the pieces of a length in the task that made them; ids are those of the text by the tokenizer at
    ``path`` (null: an empty text), then id 0.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            texts, doc_ids = texts_of(batch["text"]), batch["doc_id"].to_pylist()
            for a, b in slices([len(t) for t in texts], STEP_CHARS):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], token_ids(texts[a:b], path), strict=True):
                    ids = np.append(ids, END).astype("<u4")
                    cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
                    for piece, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[x:y]
                        rows.append((doc_id, piece, x, y - x, zlib.crc32(part), task, int(seen[y - x])) + ((part.tolist(),) if with_ids else ()))
                        seen[y - x] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and ids if asked for.

    Sequences are numbered from 0; the offsets in one have no gaps. Ids of documents may be null or repeat: each row is
    packed. An empty table gives no rows; other columns are left out. The driver sees the histogram of lengths and the kinds
    of bins, whose numbers the window bounds.
    """
    held = materialise(pieces(docs, path, window, id_col, text_col, with_ids))
    counted = held.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counted.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, window)))
    ranked = held.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    names, extra = ["doc_id", "piece", "start", "length", "ids_crc32"], ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = table.value
        # Ranks of one length are less than the number of pieces: both fit into one key.
        keys = place["length"] << 50 | place["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch[c]).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 50 | rank, side="right") - 1
            bin_, copy = np.divmod(rank - place["rank"][at], place["each"][at])
            told = [pa.array(place["bin"][at] + bin_), pa.array(place["offset"][at] + copy * length)]
            rest = [batch[c] for c in names] + told + [batch[c] for c in extra]
            yield pa.RecordBatch.from_arrays(rest, [*names, "sequence_id", "offset", *extra])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return ranked.select(*names[:3], F.col("length").cast("long"), "ids_crc32", "rank", *extra).mapInArrow(run, schema)
