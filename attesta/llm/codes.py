"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, in exact integers.

Components become integers; vectors are cut into equal parts, and each part position has a codebook of its own. Codebooks are
small (entries times dimensions) and go to all tasks; Arrow batches compute the distances of all their parts to all entries by
expanding the norm, with exact products of 64-bit integers, and take the first least one. A round's sums by entry are added up in
the task, then in a grouped shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors whose distances are held at once.
STEP = 2048
LONGEST = 2**63 - 1
#: Labels whose sums may be broadcast; more are joined by a shuffle.
LABELS = 100_000


def integers(column: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors of an Arrow list column that can take part, padded with zeros; and which those are.

    Vectors that are null or hold null or non-finite components take no part. Integers beyond 63 bits stop at the last one.
    """
    kept = np.asarray(column.is_valid())
    lists = column.filter(pa.array(kept))
    lengths = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten()
    values = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    whole = np.ones(len(lists), bool)
    whole[owner[~np.isfinite(values)]] = False
    kept[np.flatnonzero(kept)[~whole]] = False
    inside = whole[owner]
    numbers = np.cumsum(whole) - 1
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    floors = np.floor(values[inside] * scale)
    limit = 2.0**63
    cut = np.clip(floors, -limit, np.nextafter(limit, 0)).astype(np.int64)
    cut[floors >= limit] = LONGEST
    out = np.zeros((int(whole.sum()), width), np.int64)
    out[numbers[owner[inside]], at[inside]] = cut
    return out, kept


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    exact = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)), -int(part.min(initial=0)), -int(book.min(initial=0)))
    if 4 * exact * exact * max(1, part.shape[1]) > LONGEST:
        part, book = part.astype(object), book.astype(object)  # integers of any length: larger than any embedding's
    apart = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]
    which = apart.argmin(1)
    return which, apart[np.arange(len(part)), which]


class _Books:
    """The codebooks of all part positions: [part, entry, place]."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        width = self.books.shape[2]
        for p, book in enumerate(self.books):
            yield p, *nearest(vectors[:, p * width : (p + 1) * width], book)


def _usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has neither null nor non-finite components."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad)


def train(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks as integers [part, entry, place], from the vectors of the smallest ids and some rounds over all vectors.

    Only codebooks and their sums come to the driver: ``entries`` times the dimension, for any number of rows. Shorter
    vectors are padded with zeros to the longest one, whose length is rounded up to a multiple of ``parts``. Fewer vectors than
    ``entries`` give fewer entries, none give none. Equal ids stand by their components, null ids last.
    """
    spark = ship(vectors.sparkSession)
    usable = _usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    first = usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    longest = usable.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    start, _ = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width * parts, scale)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    column = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    for _ in range(rounds if first and width else 0):
        held = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = held.value  # noqa: B023  read in the same round
            # Sums of a task in two halves of 32 bits each: neither overflows below 2^31 rows.
            low, high = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
            counts = np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                rows, _ = integers(batch["v"], books.shape[0] * books.shape[2], scale)
                for a in range(0, len(rows), STEP):
                    step = rows[a : a + STEP]
                    for p, which, _ in _Books(books).assign(step):
                        part = step[:, p * books.shape[2] : (p + 1) * books.shape[2]]
                        np.add.at(low[p], which, part & 0xFFFFFFFF)
                        np.add.at(high[p], which, part >> 32)
                        counts[p] += np.bincount(which, minlength=books.shape[1])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(low[p, e].tolist(), pa.list_(pa.int64())), pa.array(high[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "low", "high"])

        told = column.mapInArrow(sums, "part long, entry long, n long, low array<long>, high array<long>")
        each = told.select("part", "entry", "n", F.posexplode(F.arrays_zip("low", "high")).alias("place", "s"))
        total = F.sum(F.col("s.low").cast("decimal(38,0)")) + F.sum(F.col("s.high").cast("decimal(38,0)")) * F.lit(1 << 32)
        for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), total.cast("decimal(38,0)").alias("total")).toLocalIterator():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        held.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """The hash of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Return vec_id, label, code and error of each vector that takes part; an error beyond 63 bits stops at the last one."""
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    held = spark.sparkContext.broadcast(books)
    two = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            numbers, kept = integers(batch["v"], books.shape[0] * books.shape[2], scale)
            codes, errors = np.zeros((len(numbers), books.shape[0]), np.int64), [0] * len(numbers)
            for a in range(0, len(numbers), STEP):
                step = numbers[a : a + STEP]
                total = np.zeros(len(step), object)
                for p, which, apart in _Books(books).assign(step):
                    codes[a : a + STEP, p] = which
                    total = total + apart.astype(object)
                errors[a : a + STEP] = [min(x, LONGEST) for x in total.tolist()]
            written = ["".join(c) for c in two[codes].tolist()]
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(mask), batch["label"].filter(mask), pa.array(written, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Return vec_id, code, error, label_error and codebooks_sha256 of each vector that takes part.

    The input is read once for each round and three times more: give it a table. Ids may be null or repeat: each row counts.
    An empty table gives no rows; other columns are left out. Sums by label are joined by null-safe equality, broadcast only
    where there are few labels.
    """
    books = train(vectors, vector_col, id_col)
    coded = encode(vectors, books, vector_col, id_col, label_col)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long")
    labels = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    if vectors.select(label_col).distinct().limit(LABELS + 1).count() <= LABELS:
        labels = F.broadcast(labels)
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
