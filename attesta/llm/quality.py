"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text that the dictionary of good text compresses to less than that of bad text is likely good. The difference
of the two sizes, divided by the text's own, is calibrated to a probability on labelled rows that the
dictionaries weren't built from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_training, texts_of

#: Bounds of the training sample: rows for each label (half for the dictionary, half for calibration), and bytes of a row (longer rows aren't drawn).
SAMPLE_ROWS = 2_400
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 65_536
PART = 4096
LEVEL = 3
THRESHOLD = 0.3
#: Added to a text's size, so that a few bytes don't decide on a short text.
PRIOR_BYTES = 60


@lru_cache(maxsize=1)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    out = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT) if data else None
        if d:
            d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return tuple(out)


def difference(good: bytes, bad: bytes, texts: list[bytes]) -> np.ndarray:
    """Size by the bad dictionary less size by the good one, over the text's own."""
    a, b = _compressors(good, bad)
    return np.array([(len(b.compress(t)) - len(a.compress(t))) / (len(t) + PRIOR_BYTES) for t in texts])


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[i : i + PART] for t in texts for i in range(0, len(t), PART)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression, by Newton's method with a small ridge."""
    scale = x.std() or 1.0
    design, beta = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[bytes, bytes, float, float]:
    """The two dictionaries, and slope and intercept of the calibration."""
    learnt = labels.where(in_training(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    many = {r["y"]: r["n"] for r in learnt.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_draw = Window.partitionBy("y").orderBy(F.xxhash64(F.col("id"), F.lit(8)), "id")
    drawn = learnt.withColumn("n", F.row_number().over(by_draw)).where(F.col("n") <= SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    # One text of each drawn id, however many rows have it: no more than SAMPLE_ROWS of a label come to the driver.
    rows = texts.join(F.broadcast(drawn), "id").groupBy("y", "n").agg(F.min("text").alias("text")).toPandas().sort_values(["y", "n"])
    parts = {(y, half): [t.encode() for t in rows[(rows["y"] == y) & (rows["n"] % 2 == half)]["text"]] for y in (0, 1) for half in (0, 1)}
    good, bad = _dictionary(parts[1, 0]), _dictionary(parts[0, 0])
    held = {y: parts[y, 1] for y in (0, 1)}
    if not good or not bad or not held[0] or not held[1]:
        return b"", b"", 0.0, float(np.log((many.get(1, 0) + 1) / (many.get(0, 0) + 1)))
    x = np.concatenate([difference(good, bad, held[y]) for y in (0, 1)])
    y = np.repeat([0, 1], [len(held[0]), len(held[1])])
    # Each label weighs as much as it has rows, however many of them were drawn.
    weight = np.where(y == 1, many[1] / len(held[1]), many[0] / len(held[0]))
    return (good, bad, *_logistic(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Append ``held_out, score, predicted`` to the rows of ``docs``; columns of these names are replaced.

    Learnt from a bounded sample of labelled rows of ``training`` (``docs`` by default) whose id's crc32 isn't
    divisible by 5. ``score`` is the probability of label 1; a null text counts as empty and gets that of no
    evidence. Where too little is labelled, every score is the share of label 1. A null id is neither learnt
    from nor held out; repeated rows stay; an empty table gives no rows.
    """
    good, bad, slope, intercept = train(docs if training is None else training, labels, id_col, text_col, label_col)
    base = docs.drop("score", "predicted").withColumn("held_out", F.coalesce(~in_training(F.col(id_col)), F.lit(False)))
    base = base.select(*[c for c in base.columns if c != "held_out"], "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in texts_of(batch[text_col])]
            x = difference(good, bad, texts) if good else np.zeros(len(texts))
            p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, score double, predicted int")
