"""Byte-level BPE over whole texts.

Encoding is a monoid: halves of a word are encoded recursively and neighbours joined. A join re-encodes a window
around the seam, and widens it until the tokens outside provably keep their place: a sequence of tokens is the
encoding of its bytes exactly if each two neighbours are the encoding of theirs. Within each side that holds
already, so two checks at the window's edges prove the whole join. Decoding concatenates up a tree.

Texts are split into words, and equal words found, by array operations over many texts at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, texts_of, word_hashes

#: Encodings that a worker keeps: words, and pieces of words or pairs of tokens. Each store is emptied when it is full.
KEPT_WORDS = 600_000
KEPT_PIECES = 100_000
#: Tokens of a leaf of the decoding tree.
LEAF = 4096
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
ABSENT = 1 << 40


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a tokenizer's JSON: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of ranks or from a tokenizer's JSON whose merges are in the order of their ids."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special, of = {t["content"] for t in whole.get("added_tokens", [])}, _byte_characters()
        return {bytes(map(of.__getitem__, token)): i for token, i in whole["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes the bytes of one word by ranks; sequences of tokens are tuples of their ids."""

    DIRECT = 3  # bytes that are encoded directly
    SHORT = 6  # bytes of the pieces that are kept

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.shift = max(ranks.values()).bit_length()
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}

    def direct(self, data: bytes) -> tuple[int, ...]:
        """By definition: merge the neighbours whose union has the lowest rank, the first ones on a tie."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        ranks = [rank(data[i : i + 2], ABSENT) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != ABSENT:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], ABSENT)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], ABSENT)
        return tuple(map(self.ranks.__getitem__, parts))

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; empty where it is the two themselves, so that their border is stable."""
        found = self.direct(self.tokens[a] + self.tokens[b])
        if len(self.pairs) >= KEPT_PIECES:
            self.pairs.clear()
        found = self.pairs[a << self.shift | b] = () if found == (a, b) else found
        return found

    def stable(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << self.shift | b)
        return not (self.pair(a, b) if found is None else found)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation of two encoded sequences."""
        a, b = left[-1], right[0]
        middle = self.pairs.get(a << self.shift | b)
        if middle is None:
            middle = self.pair(a, b)
        if not middle:
            return left + right
        if (len(left) == 1 or middle[0] == a or self.stable(left[-2], middle[0])) and (len(right) == 1 or middle[-1] == b or self.stable(middle[-1], right[1])):
            return left[:-1] + middle + right[1:]
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.direct(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            if (i == 0 or middle[0] == left[i] or self.stable(left[i - 1], middle[0])) and (j == len(right) or middle[-1] == right[j - 1] or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def ids(self, data: bytes) -> tuple[int, ...]:
        """Halves are encoded and joined; short ones are kept."""
        found = self.pieces.get(data)
        if found is not None:
            return found
        n = len(data)
        if n <= self.DIRECT:
            found = self.direct(data)
        else:
            found = self.join(self.ids(data[: n // 2]), self.ids(data[n // 2 :]))
        if n <= self.SHORT:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[data] = found
        return found


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, digit, space or other."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    where = np.array(points, np.int64)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[where[m.start() : m.end()]] = kind
    return out


class Words:
    """The words of some texts, as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` has them.

    A word begins where the class of characters changes, unless a blank (U+0020) stands before it, which then
    belongs to it; the last character of white space before a word stands apart from the white space in front of
    it; an apostrophe that begins a word takes the endings that the pattern names as a word of their own.
    """

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = len(points)
        self.doc_starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.doc_starts[1:])
        begins = np.zeros(n + 1, bool)
        begins[self.doc_starts] = True
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.doc_words = np.zeros(len(texts) + 1, np.int64)
            return
        kind = _classes()[points]
        space, blank = kind == SPACE, points == 0x20
        after_space = np.concatenate(([False], space[:-1])) & ~begins[:n]
        after_blank = np.concatenate(([False], blank[:-1])) & ~begins[:n]
        changed = np.concatenate(([True], kind[1:] != kind[:-1])) | begins[:n]
        word_next = np.concatenate((~space[1:], [False])) & ~begins[1:]
        start = np.where(space, ~after_space | word_next, changed & ~after_blank)
        quotes = np.flatnonzero(start & (points == 0x27))
        if len(quotes):
            padded = np.concatenate((points, np.zeros(2, np.uint32)))
            ended = np.concatenate((begins, [True, True]))
            one, two = padded[quotes + 1], padded[quotes + 2]
            in_one = ~ended[quotes + 1]
            in_two = in_one & ~ended[quotes + 2]
            single = in_one & np.isin(one, [ord(c) for c in "stmd"])
            double = in_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, length in ((single, 2), (double, 3)):
                at = quotes[hit]
                for k in range(1, length):
                    start[at + k] = False
                at = at[at + length < n]
                start[at + length] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n)
        self.doc_words = np.searchsorted(self.starts, self.doc_starts)
        self._widths = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)

    def distinct(self) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The different words as UTF-8, and the number of each word among them. Words are compared byte by byte."""
        data, at = self.text.encode(), np.append(self.starts, self.ends[-1:])
        if len(data) > len(self.text):
            at = np.concatenate(([0], np.cumsum(self._widths, dtype=np.int64)))[at]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy()


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    """Concatenate the tokens of leaves, then neighbours, up a tree."""
    level = [b"".join(map(tokens.__getitem__, ids[i : i + LEAF])) for i in range(0, len(ids), LEAF)]
    while len(level) > 1:
        level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


@functools.cache
def _tokens(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


class Grown:
    """An array that grows at its end; its room doubles, so what it holds is seldom copied."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            held = self.held
            self.room = np.empty(max(2 * len(self.room), end), held.dtype)
            self.room[: self.size] = held
        self.room[self.size : end] = values
        self.size = end

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]


#: Encodes some words: the ids of all, one after the other, and how many each has.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class Kept:
    """Encodings of words: a table of places by hash (linear probing), and the words' bytes, to compare, and ids, each laid end to end.

    A step costs what its words do, however many are kept. A word takes some 60 bytes.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << max(1, (2 * KEPT_WORDS - 1).bit_length()), -1, np.int32)
        self.hashes, self.bytes, self.byte_ends, self.ids, self.id_ends = map(Grown, (np.uint64, np.uint8, np.int64, np.int32, np.int64))
        self.byte_ends.add(np.zeros(1, np.int64))
        self.id_ends.add(np.zeros(1, np.int64))

    def find(self, words: pa.LargeBinaryArray, encode: Encode) -> np.ndarray:
        """The number of each of some different words; words that aren't there are put in."""
        if self.hashes.size + len(words) > KEPT_WORDS:
            self.clear()
        if 2 * len(words) > len(self.table):
            self.table = np.full(1 << (2 * len(words) - 1).bit_length(), -1, np.int32)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        hashes, lengths = word_hashes(data, offsets[:-1], offsets[1:]), np.diff(offsets)
        out = np.full(len(words), -1)
        last = np.uint64(len(self.table) - 1)
        left, at = np.arange(len(words)), (hashes & last).astype(np.int64)
        while len(left):
            number = self.table[at]
            met = np.flatnonzero(number >= 0)  # a word that meets an empty place isn't there
            left, at, number = left[met], at[met], number[met]
            # An equal hash proves nothing: lengths and bytes decide.
            begin = self.byte_ends.held[number]
            same = np.flatnonzero((self.hashes.held[number] == hashes[left]) & (self.byte_ends.held[number + 1] - begin == lengths[left]))
            sizes = lengths[left[same]]
            if len(same):
                differ = data[spread(offsets[left[same]], sizes)] != self.bytes.held[spread(begin[same], sizes)]
                same = same[np.add.reduceat(differ, np.cumsum(sizes) - sizes, dtype=np.int64) == 0]
            out[left[same]] = number[same]
            others = out[left] < 0
            left, at = left[others], at[others] + 1 & len(self.table) - 1
        new = np.flatnonzero(out < 0)
        if len(new):
            ids, counts = encode(words.take(pa.array(new)).to_pylist())
            out[new] = self.hashes.size + np.arange(len(new))
            self._put(out[new], (hashes[new] & last).astype(np.int64))
            self.hashes.add(hashes[new])
            self.bytes.add(data[spread(offsets[new], lengths[new])])
            self.byte_ends.add(self.byte_ends.held[-1] + np.cumsum(lengths[new]))
            self.ids.add(ids)
            self.id_ends.add(self.id_ends.held[-1] + np.cumsum(counts))
        return out

    def _put(self, numbers: np.ndarray, at: np.ndarray) -> None:
        """Write numbers to the first empty place from ``at`` on; of those that meet at one, one stays and the others go on."""
        while len(numbers):
            empty = self.table[at] < 0
            self.table[at[empty]] = numbers[empty]
            others = self.table[at] != numbers
            numbers, at = numbers[others], at[others] + 1 & len(self.table) - 1


@functools.cache
def _kept(path: str) -> Kept:
    return Kept()


def _by_tree(path: str) -> Encode:
    ids = encoder(path).ids

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [ids(w) for w in words]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int32, int(counts.sum())), counts

    return encode


def encode_texts(texts: list[str], path: str, encode: Encode | None = None) -> Iterator[np.ndarray]:
    """The ids of each text; its words are encoded by ``encode``, or by the tree reduction."""
    kept, encode = _kept(path), encode or _by_tree(path)
    for a, b in slices([len(t) for t in texts]):
        words = Words(texts[a:b])
        if not len(words.starts):
            yield from (np.zeros(0, np.int32) for _ in range(b - a))
            continue
        distinct, which = words.distinct()
        number = kept.find(distinct, encode)
        starts = kept.id_ends.held[number]
        lengths = (kept.id_ends.held[number + 1] - starts)[which]
        out = kept.ids.held[spread(starts[which], lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[words.doc_words]
        for i in range(b - a):
            yield out[bounds[i] : bounds[i + 1]]


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, ids_sha256, decoded_sha256 for each row.

    ``path``: a file of ranks, on every machine. ids_sha256 is of the decimal ids joined by blanks, decoded_sha256 of
    the bytes decoded from the ids. A null text counts as empty; ids of rows may be null or repeat; an empty
    table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        numbers = list(map(str, range(len(tokens))))
        for batch in batches:
            counts, coded, decoded = [], [], []
            for ids in encode_texts(texts_of(batch["text"]), path):
                listed = ids.tolist()
                counts.append(len(listed))
                coded.append(hashlib.sha256(" ".join(map(numbers.__getitem__, listed)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(listed, tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
