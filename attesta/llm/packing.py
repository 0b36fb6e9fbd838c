"""Packing by lexical retrieval: documents that share rare tokens meet in a sequence.

Documents are routed by the least hash of their runs of five words, which two of them share as likely as their sets of runs agree
(single words won't do: most texts of a language hold its common ones, so most would share a route). In a partition they are ordered
by the least hash of their words, which brings those of one language together, then by that of their runs and, where many
share it, by the greatest one, and taken in shards of bounded size; so what is lexically close meets in a shard. Each shard
has an inverted index: postings of the tokens that its documents share, weighted by BM25; a seed is scored from the postings of all its terms. Each seed fills its window with the
best unused neighbours; where the last one is too long, its rest becomes the next seed. What a document has in whole
windows stands alone, but is indexed and searched by. What a shard leaves is the first seed of the next; the rest at a partition's
end goes to sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import slices, texts_of

WINDOW = 2048
END = 1
#: Bounds of a shard: documents, and characters (a larger document stands alone).
SHARD_DOCS = 512
SHARD_CHARS = 1_000_000
#: A term in more than one of so many arrays has a row of weights for its postings.
DENSE = 16
K1, B = 1.2, 0.75


@functools.cache
def _special(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@functools.cache
def _library(path: str) -> bpe.Encode:
    """The tokenizer's encoding of words: many in one call, with a byte 0 behind each, which is a piece of its own."""
    ranks = bpe.read_ranks(path)
    made = functools.cache(lambda pattern: tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    end = ranks[b"\0"]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\0".join([*words, b""])
        if joined.count(b"\0") > len(words):  # some word holds the byte itself
            coded = [made(public_tokenizers.PATTERN).encode_ordinary(w.decode()) for w in words]
            return np.array([x for ids in coded for x in ids], np.int32), np.array([len(ids) for ids in coded])
        ids = np.array(made(r"\x00|[^\x00]+").encode_ordinary(joined.decode()), np.int32)
        ends = np.flatnonzero(ids == end)
        return ids[ids != end], np.diff(ends, prepend=-1) - 1

    return encode


def token_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text by the tokenizer of a JSON file; its special tokens count where a text has them."""
    special = _special(path)
    if not any(s in t for t in texts for s in special):
        yield from bpe.encode_texts(texts, path, _library(path))
        return
    parts = [bpe.regex.split("(" + "|".join(map(bpe.regex.escape, special)) + ")", t) for t in texts]
    coded = bpe.encode_texts([x for p in parts for x in p[0::2]], path, _library(path))
    for p in parts:
        out = []
        for i, x in enumerate(p):
            out.append(np.array([special[x]], np.int32) if i % 2 else next(coded))
        yield np.concatenate(out)


class Index:
    """An inverted index of some token arrays: postings by term, with the BM25 weight of the term in each array.

    Postings of a term that more than one in ``DENSE`` arrays hold are a row of weights, others a list of arrays and weights.
    """

    def __init__(self, items: list[np.ndarray]) -> None:
        self.size = n = len(items)
        owner = np.repeat(np.arange(n), [len(x) for x in items])
        # Pairs of term and array come sorted by term, so each term's postings are a range.
        pairs, tf = np.unique(np.concatenate([np.empty(0, np.int64), *items]).astype(np.int64) * max(n, 1) + owner, return_counts=True)
        docs, (_, first, number, df) = pairs % max(n, 1), np.unique(pairs // max(n, 1), return_index=True, return_inverse=True, return_counts=True)
        sizes = np.array([len(x) for x in items], np.float64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.docs, self.first, self.df = docs, first, df
        self.weights = idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / sizes.mean())) if len(docs) else np.empty(0)
        # Terms of each array; a term of one array alone finds nothing.
        dense = df * DENSE > n
        row = np.cumsum(dense) - 1
        filled = dense[number]
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        self.rows[row[number[filled]], docs[filled]] = self.weights[filled]
        self.dense_of, self.dense_bounds = self._by_array(row[number], docs, filled & (df[number] > 1))
        self.terms, self.bounds = self._by_array(number, docs, ~filled & (df[number] > 1))

    def _by_array(self, terms: np.ndarray, docs: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(kept)
        at = at[np.argsort(docs[at], kind="stable")]
        return terms[at], np.searchsorted(docs[at], np.arange(self.size + 1))

    def score(self, i: int) -> np.ndarray:
        """What the terms of item i, each once, score in each item; 0 in itself."""
        terms = self.terms[self.bounds[i] : self.bounds[i + 1]]
        lengths = self.df[terms]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + lengths, lengths)
        out = np.bincount(self.docs[at], self.weights[at], self.size).astype(np.float64)
        held = np.zeros(len(self.rows), np.float32)
        held[self.dense_of[self.dense_bounds[i] : self.dense_bounds[i + 1]]] = 1
        out += held @ self.rows
        out[i] = 0
        return out

    @property
    def scores(self) -> np.ndarray:
        """All scores as a matrix, to look at small indexes."""
        return np.stack([self.score(i) for i in range(self.size)])

    def neighbours(self, i: int) -> np.ndarray:
        """The other items that share a term with item i, by falling score, ties by number."""
        scores = self.score(i)
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


#: A piece: the number of its row, where it starts there, and its ids.
Piece = tuple[int, int, np.ndarray]


class Packer:
    """Fills windows from shards; the open window goes over from one shard to the next."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.open: list[Piece] = []
        self.room = window

    def _put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece; yields each window that it fills."""
        row, start, ids = piece
        while len(ids):
            part = ids[: self.room]
            self.open.append((row, start, part))
            start, ids = start + len(part), ids[len(part) :]
            self.room -= len(part)
            if not self.room:
                yield self.open
                self.open, self.room = [], self.window

    def shard(self, docs: list[tuple[int, np.ndarray]]) -> Iterator[list[Piece]]:
        tails: list[Piece] = []
        indexed: list[np.ndarray] = []
        for row, ids in docs:
            whole = len(ids) // self.window * self.window
            for at in range(0, whole, self.window):
                yield [(row, at, ids[at : at + self.window])]
            if whole < len(ids):
                tails.append((row, whole, ids[whole:]))
                indexed.append(ids)
        index = Index(indexed)
        unused = np.ones(len(tails), bool)
        sizes = np.array([len(t[2]) for t in tails])
        following = 0
        while True:
            while following < len(tails) and not unused[following]:
                following += 1
            if following == len(tails):
                return
            seed = following
            unused[seed] = False
            yield from self._put(tails[seed])
            # Neighbours fill what is left of the window; one that is cut is the seed of the next.
            while self.room < self.window:
                near = index.neighbours(seed)
                near = near[unused[near]]
                cut = None
                for i in near.tolist():
                    if sizes[i] <= self.room:
                        unused[i] = False
                        yield from self._put(tails[i])
                        if self.room == self.window:
                            break
                    elif cut is None:
                        cut = i
                if self.room == self.window or cut is None:
                    break
                unused[cut] = False
                yield from self._put(tails[cut])
                seed = cut

    def rest(self) -> Iterator[list[Piece]]:
        """What is left, in sequences whose lengths are falling powers of two."""
        pieces, self.open = self.open, []
        left = self.window - self.room
        self.room = self.window
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                row, start, ids = pieces.pop(0)
                out.append((row, start, ids[:size]))
                if len(ids) > size:
                    pieces.insert(0, (row, start + size, ids[size:]))
                size -= len(out[-1][2])
            yield out


def routed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hashes of a text that say where it goes, null for a null text.

    route and second: the least and the greatest hash of its runs of five words (of fewer, all of them); common: the least
    hash of its words, which is mostly that of a common word of its language.
    """
    words = rows.withColumn("__w", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    starts = F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 4, F.lit(1)))
    runs = words.withColumn("__r", F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get("__w", i + k) for k in range(1, 5)])))
    return runs.withColumns({"route": F.array_min("__r"), "second": F.array_max("__r"), "common": F.array_min("__w")}).drop("__w", "__r")


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are those of its text by the tokenizer at ``path`` (null: an empty text), then id 1. Each lies in
    exactly one piece. Sequences are full, or as long as a power of two; offsets in one count from 0 without gaps.
    Ids of documents may be null or repeat; an empty table gives no rows; other columns are left out.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(window), TaskContext.get().partitionId() << 40
        ids_of: dict[int, tuple[int | None, int]] = {}
        rows = 0

        def told(windows: Iterator[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for pieces in windows:
                offset = 0
                for row, start, ids in pieces:
                    doc_id, total = ids_of[row]
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset) + ((ids.tolist(),) if with_ids else ()))
                    offset += len(ids)
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            texts, doc_ids = texts_of(batch["text"]), batch["doc_id"].to_pylist()
            # A character gives four tokens at most, so this bounds them too.
            for a, b in slices([len(t) for t in texts], SHARD_CHARS):
                for c in range(a, b, SHARD_DOCS):
                    d = min(b, c + SHARD_DOCS)
                    shard = []
                    for doc_id, ids in zip(doc_ids[c:d], token_ids(texts[c:d], path), strict=True):
                        ids = np.append(ids, np.int32(END))
                        ids_of[rows] = (doc_id, len(ids))
                        shard.append((rows, ids))
                        rows += 1
                    yield told(packer.shard(shard))
                    still = {p[0] for p in packer.open}
                    ids_of = {k: v for k, v in ids_of.items() if k in still}
        yield told(packer.rest())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A route may hold very many rows: adaptive execution splits the partitions of a rebalance.
    rows = routed(rows).hint("rebalance", "route").sortWithinPartitions("common", "route", "second", "doc_id").select("doc_id", "text")
    return rows.mapInArrow(run, ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names))
