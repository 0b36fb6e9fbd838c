"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Characters of text that a worker handles in one vectorised step.
CHUNK = 400_000
#: Rows of some 60 bytes at most that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Partitions that so few rows are kept in: each one more is a task and a file of every later step.
FEW_PARTS = 36


def _return_memory() -> None:
    """Have the C library give large freed blocks back at once: a Python worker lives on from stage to stage."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of glibc; setting it also stops it from growing
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a default where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return folder or "/tmp/checkpoints"


_written: dict[str, SparkSession] = {}
#: Spark removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _sweep() -> None:
    """Remove what was written, when the driver ends: results are read from it until then."""
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already; the folder's owner has to clear it
            return


def keep_until_the_end(spark: SparkSession, path: str) -> str:
    """Have a path removed when the driver ends."""
    if not _written:
        atexit.register(_sweep)
    _written[path] = spark
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts the lineage, and a lost executor loses none of it.

    The shuffle files of its query go as soon as the table is written.
    """
    spark = df.sparkSession
    path = keep_until_the_end(spark, f"{shared_folder(spark).rstrip('/')}/attesta-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` has written and nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)
        _written.pop(t._written_to, None)


def if_few(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks what has as many rows as a written table for broadcast where these are few; else leaves it as it is."""
    return F.broadcast if table.count() <= BROADCAST_ROWS else lambda df: df


def gathered(table: DataFrame, most: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Brings what has about as many rows as a written table into few partitions where these are few; else leaves it as it is."""
    return (lambda df: df.coalesce(FEW_PARTS)) if table.count() <= (BROADCAST_ROWS if most is None else most) else lambda df: df


def fresh(name: str, columns: list[str]) -> str:
    """A column's name that is none of those given."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_training(doc_id: Column) -> Column:
    """Whether a row may be learnt from: the crc32 of its id, as text, isn't divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``most`` at most; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (multiply, xor, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """64-bit hashes of ranges of a sequence of small integers, from prefix sums of ``key[c] * BASE ** i``.

    Equal ranges have equal hashes wherever they stand.
    """

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray, keys: np.ndarray | None = None) -> None:
        n = len(values)
        self._grow(n + 1)
        terms = keys[values] if keys is not None else mixed(values.astype(np.uint64) + np.uint64(0x51ED270B))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms * self._powers[:n], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            n += n // 8
            for name, base in (("_powers", cls.BASE), ("_inverse", pow(cls.BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._inverse[starts])

    def rolling(self, length: int) -> np.ndarray:
        """The hash of each range of that length, by its start."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self._inverse[:n])


#: One 64-bit key for each byte.
BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def spread(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places firsts[i], firsts[i] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(firsts - (ends - lengths), lengths)


_places = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that follow each other in some bytes: each place in a word has a multiplier of its own, drawn by mixing.

    Multipliers that are powers of one number would let words of a regular build collide, as those of ``RangeHash`` do.
    """
    global _places
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    most = int(sizes.max())
    if most > len(_places):
        _places = mixed(np.arange(1, most + most // 8 + 1, dtype=np.uint64)) | np.uint64(1)
    flat = np.arange(int(sizes.sum()))
    firsts = np.cumsum(sizes) - sizes
    terms = BYTE_KEYS[data[flat + np.repeat(starts - firsts, sizes)]] * _places[flat - np.repeat(firsts, sizes)]
    return mixed(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64))
