"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. A symbol seen after a context costs its share
there; an escape, as likely as the number of different symbols seen, leads to the next shorter context, with
the symbols already ruled out excluded; below the empty context all bytes are alike. The statistics are frozen after
training, so the code length of a byte depends on its context alone and is compiled into a table. A text's code length
is the sum over all its bytes; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_training, slices, texts_of

ORDER = 3
#: Bounds of the training sample: rows for each language, and bytes of a row (longer rows aren't drawn).
SAMPLE_ROWS = 600
SAMPLE_BYTES = 65_536
#: Contexts that are compiled: the most frequent ones with so many symbols, up to a number for each length.
MIN_COUNT = 6
MAX_CONTEXTS = 4_000
#: Bytes of the compiled table at most; with very many languages fewer contexts are compiled.
TABLE_BYTES = 96 << 20
UNDETERMINED = "und"
_letter = regex.compile(r"\p{L}")


def _grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it, as one integer; a text begins after three line feeds."""
    b = np.frombuffer(b"\n" * ORDER + data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the 4-grams found in the sample, and how often each language has each."""
    rows = docs.where(in_training(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("draw")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # Of a large language only rows with a low draw, twice as many as needed, go on to be ranked.
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return [], np.zeros(0, np.uint32), np.zeros((0, 0), np.int32)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * SAMPLE_ROWS + 100) / n))) for lang, n in totals.items()])
    rows = rows.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("n") <= SAMPLE_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), texts_of(batch["text"]), strict=True):
                by.setdefault(lang, []).append(_grams(text.encode()))
            for lang, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    grams, at = np.unique(found["gram"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(grams), len(langs)), np.int32)
    counts[at, np.searchsorted(langs, found["lang"].to_numpy(str)) if langs else at] = found["n"]
    return langs, grams.astype(np.uint32), counts


class Model:
    """Code lengths in bits, by context and byte, of each language."""

    #: Contexts whose distributions are worked out at once.
    STEP = 256

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        symbols, langs = (grams & 255).astype(np.int64), counts.shape[1]
        most = max(1, min(MAX_CONTEXTS, TABLE_BYTES // (ORDER * 256 * 4 * langs)))
        self.table = np.zeros((256, 256, 256), np.uint16)  # the last three bytes -> the longest known context
        # Which contexts are known, by length; each is numbered after those of the lengths before.
        levels = []
        known = 1
        for order in range(1, ORDER + 1):
            contexts = (grams.astype(np.int64) >> 8) & ((1 << 8 * order) - 1)
            keys, at = np.unique(contexts, return_inverse=True)
            total = np.bincount(at, counts.sum(1), len(keys))
            keep = np.sort(np.argsort(-total, kind="stable")[:most])
            keep = keep[total[keep] >= MIN_COUNT]
            number = np.full(len(keys), -1)
            number[keep] = np.arange(len(keep))
            levels.append((keys[keep], number[at]))
            known += len(keep)
        self.bits = np.zeros((known, 256, langs), np.float32)  # distributions first, turned into bits at the end
        self._level(0, np.zeros(len(grams), np.int64), symbols, counts, np.full(1, -1))
        base = 1
        for order, (keys, number) in enumerate(levels, 1):
            a, b, c = keys >> 16, (keys >> 8) & 255, keys & 255
            parents = np.zeros(len(keys), np.int64) if order == 1 else self.table[0, 0, c].astype(np.int64) if order == 2 else known2[b, c].astype(np.int64)
            self._level(base, number, symbols, counts, parents)
            ids = base + np.arange(len(keys))
            if order == 1:
                self.table[:, :, c] = ids
            elif order == 2:
                self.table[:, b, c] = ids
                known2 = self.table[0].copy()
            else:
                self.table[a, b, c] = ids
            base += len(keys)
        np.log2(self.bits, out=self.bits)
        np.negative(self.bits, out=self.bits)
        self.table, self.bits = self.table.reshape(-1), self.bits.reshape(-1, langs)

    def _level(self, base: int, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, parents: np.ndarray) -> None:
        """Distributions of the contexts of one length, numbered from ``base``, from those of their next shorter ones."""
        order = np.argsort(context, kind="stable")
        bounds = np.searchsorted(context[order], np.arange(0, len(parents) + self.STEP, self.STEP))
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            part = parents[i * self.STEP : (i + 1) * self.STEP]
            rows = order[lo:hi]
            seen = np.zeros((len(part), 256, counts.shape[1]))
            np.add.at(seen, (context[rows] - i * self.STEP, symbol[rows]), counts[rows])
            shorter = np.full(seen.shape, 1 / 256) if base == 0 else self.bits[part].astype(np.float64)
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            rest = np.where(seen > 0, 0, shorter)
            left = rest.sum(1, keepdims=True)
            escape = np.where(left > 0, np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0), 0)
            share = np.where(left > 0, seen / np.maximum(total + kinds, 1), seen / np.maximum(total, 1))
            self.bits[base + i * self.STEP : base + i * self.STEP + len(part)] = share + escape * rest / np.maximum(left, 1e-300)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        out = np.zeros((len(texts), self.bits.shape[1]))
        for a, b in slices([len(t) for t in texts]):
            grams = np.concatenate([_grams(t) for t in texts[a:b]])
            cost = self.bits[self.table[grams >> 8].astype(np.int64) * 256 + (grams & 255)]
            sums = np.zeros((len(cost) + 1, cost.shape[1]))
            np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
            ends = np.cumsum([len(t) for t in texts[a:b]])
            out[a:b] = np.diff(sums[np.concatenate(([0], ends))], axis=0)
        return out


def predict(docs: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Append ``held_out, lang_pred, score`` to the rows of ``docs``; columns of these names are replaced.

    Learnt from ``training`` (``docs`` itself by default): a bounded sample of rows with a language, a text and an id whose
    crc32 isn't divisible by 5. A text that is null or has no letter is ``und`` with score 0, as is any text where
    nothing could be learnt. ``score``: the weight of the best language among all, each weighing
    2 ** -(code length). Equal lengths go to the first language by name. A null id is neither learnt from nor held
    out; repeated rows stay; an empty table gives no rows.
    """
    langs, grams, counts = train(docs if training is None else training, id_col, text_col, lang_col)
    names = ["held_out", "lang_pred", "score"]
    base = docs.drop("lang_pred", "score").withColumn("held_out", F.coalesce(~in_training(F.col(id_col)), F.lit(False)))
    base = base.select(*[c for c in base.columns if c != "held_out"], "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(grams, counts) if langs else None  # in each task anew: a worker that lives on keeps nothing
        for batch in batches:
            texts = texts_of(batch[text_col])
            if langs:
                bits = model.lengths([t.encode() for t in texts])
                best = bits.argmin(1) if len(bits) else np.zeros(0, int)
                scores = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) if len(bits) else bits
            told = [bool(langs) and _letter.search(t) is not None for t in texts]
            preds = [langs[best[i]] if ok else UNDETERMINED for i, ok in enumerate(told)]
            values = [float(scores[i]) if ok else 0.0 for i, ok in enumerate(told)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(values, pa.float64())], [*batch.schema.names, *names[1:]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, lang_pred string, score double")
