"""Suffix-array dedup: bytes covered by a string of 400 bytes, or of a number of words, that also starts elsewhere.

1. Anchors. Every window of 400 bytes has one anchor: of the 64-byte strings in it, the last one with the least hash.
   Equal windows have equal anchors at equal places in them, so only windows whose anchor occurs at two places
   can repeat, and only windows of one anchor must be compared. In a stretch that repeats itself after at most 64 bytes
   every window repeats; only the windows of its first period are compared with others.
2. The regions around such anchors, a few hundred bytes each, are dealt to tasks by anchor; equal regions of an anchor
   are kept once. Regions are joined to texts of about half a megabyte, sorted by suffixes in two stages; windows
   whose neighbours in that order have a common prefix of their length repeat.
3. An anchor with very many regions is dealt to several tasks. What one task finds to repeat is settled; its
   other windows, and one window of each of its classes, are open. Open windows of a region go in blocks of places that
   neighbour each other, with a BLAKE2 digest of the core that all windows of the block hold. Equal windows stand at equal places
   about their anchor, thus in blocks of one core: a block whose core no other block has is done, and only the
   windows of the others are taken apart and meet by digests of their own.

Copies of a whole text are compared by its SHA-256 and go through all this once. Given a number of words, windows are
so many words instead of bytes, and anchors strings of 10 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import BYTE_KEYS, RangeHash, drop, fresh, materialise, slices
from .suffixes import repeated_windows

LENGTH = 400
GRAM = 64
#: Words of an anchor.
WORD_GRAM = 10
#: Bytes that are suffix-sorted at once, and regions of one anchor that go to one task.
SORTED_BYTES = 400_000
TASK_REGIONS = 512
#: Open windows that share a core.
BLOCK = 16
#: Bytes of regions that leave a worker at once.
SENT_BYTES = 4_000_000
#: Keys of texts, with an id, that are broadcast at most: 24 bytes each.
BROADCAST_ROWS = 500_000
_HIGH = np.uint64(0xFFFFFFFF00000000)
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _least(hashes: np.ndarray, width: int) -> Places:
    """First and last of the neighbouring ranges of ``width`` hashes that have one least hash, and its place."""
    # Ordered by half of the hash; of equal ones the last place counts, wherever the window stands in its text.
    ordered = (hashes & _HIGH) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(hashes), -1, dtype=np.int64).astype(np.uint64)
    span = 1
    while 2 * span <= width:
        ordered = np.minimum(ordered[: len(ordered) - span], ordered[span:])
        span *= 2
    if span < width:
        ordered = np.minimum(ordered[: len(ordered) - (width - span)], ordered[width - span :])
    firsts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    places = 0xFFFFFFFF - (ordered[firsts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return firsts, np.append(firsts[1:], len(ordered)) - 1, places


def _without_periods(same: np.ndarray, found: Places, width: int, gram: int) -> tuple[Places, list[tuple[int, int]]]:
    """Take the windows of periodic stretches, but those of their first period, out of the ranges; also their first and last windows.

    ``same[i]``: whether places i and i + 1 hold the same gram, byte by byte. Grams that touch and are the same make a stretch periodic.
    """
    firsts, lasts, places = found
    step = np.diff(places)
    chained = same & (step > 0) & (step <= gram)
    edge = np.flatnonzero(np.concatenate(([True], (chained[1:] != chained[:-1]) | (step[1:] != step[:-1]), [True]))) if len(step) else np.zeros(0, np.int64)
    whole, keep = [], np.ones(len(places), bool)
    firsts, lasts = firsts.copy(), lasts.copy()
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if not chained[i]:
            continue
        d, a, z = int(step[i]), int(places[i]), int(places[j]) - width + 1
        if z - a < 4 * d:
            continue
        whole.append((a, z))
        inside = slice(np.searchsorted(lasts, a + d), np.searchsorted(firsts, z, "right"))
        keep[inside] = (firsts[inside] < a + d) | (lasts[inside] > z)
        lasts[inside] = np.where(firsts[inside] < a + d, a + d - 1, lasts[inside])
        firsts[inside] = np.where((lasts[inside] > z) & (firsts[inside] >= a + d), z + 1, firsts[inside])
    return (firsts[keep], lasts[keep], places[keep]), whole


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run of bytes other than ASCII white space; each character from U+3000 on is one by itself."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    own = data >= 0xE3
    # A continuation byte belongs to the last lead byte before it.
    lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
    inside = own[lead] if len(data) else own
    first = ~space & (np.concatenate(([True], space[:-1] | inside[:-1]))[: len(data)] | own)
    first &= ~(inside & ~own)
    starts = np.flatnonzero(first)
    after = np.append(space | first, True)
    nothing = np.flatnonzero(after)
    return starts, nothing[np.searchsorted(nothing, starts, "right")]


def anchors_of(data: bytes, length: int, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Hash and place of each anchor of a text, begin and end of its region, and spans that repeat within themselves."""
    values = np.frombuffer(data, np.uint8)
    if words:
        starts, ends = words_of(values)
        gram, width = min(WORD_GRAM, words), words - min(WORD_GRAM, words) + 1
    else:
        starts, ends = np.arange(len(data)), np.arange(1, len(data) + 1)
        gram, width = min(GRAM, length), length - min(GRAM, length) + 1
    if len(starts) < gram + width - 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none, []
    sums = RangeHash(values, BYTE_KEYS)
    hashes = sums.of(starts[: len(starts) - gram + 1], ends[gram - 1 :])
    firsts, lasts, places = _least(hashes, width)
    same = hashes[places[1:]] == hashes[places[:-1]]
    for i in np.flatnonzero(same).tolist():
        p, q = places[i], places[i + 1]
        same[i] = data[starts[p] : ends[p + gram - 1]] == data[starts[q] : ends[q + gram - 1]]
    (firsts, lasts, places), whole = _without_periods(same, (firsts, lasts, places), width, gram)
    last = gram + width - 2
    return hashes[places].astype(np.int64), starts[places], starts[firsts], ends[lasts + last], [(int(starts[a]), int(ends[z + last])) for a, z in whole]


def _anchors(texts: DataFrame, length: int, words: int | None) -> DataFrame:
    """anchor, key, at, lo, hi of each anchor of each text (columns key, text); without an anchor: lo and hi of a span that repeats in itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch["key"].to_pylist(), [t.encode() for t in batch["text"].to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                parts = [anchors_of(t, length, words) for t in texts[a:b]]
                owners = np.concatenate((np.repeat(np.arange(b - a), [len(p[0]) for p in parts]), np.repeat(np.arange(b - a), [len(p[4]) for p in parts])))
                columns = [np.concatenate([p[k] for p in parts]) for k in range(4)]
                own = np.array([s for p in parts for s in p[4]], np.int64).reshape(-1, 2)
                n = len(own)
                anchor = pa.array(np.append(columns[0], np.zeros(n, np.int64)), mask=np.arange(len(owners)) >= len(columns[0]))
                rest = [np.concatenate(x).astype(np.int32) for x in ((columns[1], own[:, 0]), (columns[2], own[:, 0]), (columns[3], own[:, 1]))]
                yield pa.RecordBatch.from_arrays([anchor, pa.array(keys[a:b], pa.binary()).take(pa.array(owners)), *map(pa.array, rest)], ["anchor", "key", "at", "lo", "hi"])

    return texts.mapInArrow(run, "anchor long, key binary, at int, lo int, hi int")


#: A region: the text's key, where it stands there, its bytes, whether its anchor is split, the anchor, and where that stands in the region.
Region = tuple[bytes, int, bytes, bool, int, int]
#: A block of open windows: the core's digest, the text's key, and of each window its digest, whether it is settled, its begin and end.
Block = tuple[bytes, bytes, list[bytes], list[bool], list[int], list[int]]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _settle(group: list[Region], length: int, words: int | None) -> tuple[list[tuple], list[Block]]:
    """Repeats among regions: spans (key, begin, end), and blocks of open windows."""
    by: dict[tuple[int, int, bytes], list[int]] = {}
    for i, (_, _, region, _, anchor, at) in enumerate(group):
        by.setdefault((anchor, at, region), []).append(i)
    rows_of = list(by.values())
    # A blank keeps the words of two regions apart.
    joined = b" ".join(group[rows[0]][2] for rows in rows_of)
    data = np.frombuffer(joined, np.uint8)
    bounds = np.cumsum([0] + [len(group[rows[0]][2]) + 1 for rows in rows_of])
    size = words or length
    block = min(BLOCK, size - min(WORD_GRAM if words else GRAM, size) + 1)
    starts, ends = words_of(data) if words else (np.arange(len(data)), np.arange(1, len(data) + 1))
    begin, end = starts[: max(0, len(starts) - size + 1)], ends[size - 1 :]
    owner = np.searchsorted(bounds, begin, "right") - 1
    unit = np.flatnonzero(end < bounds[owner + 1])
    begin, end, owner = begin[unit], end[unit], owner[unit]
    repeats, shown = repeated_windows(data, begin, end - begin)
    edges = np.searchsorted(owner, np.arange(len(rows_of) + 1))
    spans, left = [], []
    for k, rows in enumerate(rows_of):
        a, b = int(edges[k]), int(edges[k + 1])
        flags = repeats[a:b] if len(rows) == 1 else np.ones(b - a, bool)
        x, z = begin[a:b] - bounds[k], end[a:b] - bounds[k]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
        for i, j in zip(x[edge[0::2]].tolist(), z[edge[1::2] - 1].tolist(), strict=True):
            spans += [(group[row][0], group[row][1] + i, group[row][1] + j) for row in rows]
        key, lo, region, split, _, at = group[rows[0]]
        still = np.flatnonzero(~repeats[a:b] | shown[a:b]) if split else np.zeros(0, np.int64)
        if not len(still):
            continue
        middle = int(np.searchsorted(starts, bounds[k] + at))
        number = (middle - unit[a:b][still]) // block
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first = middle - block * int(number[i])
            core = joined[starts[first] : ends[first - block + size]]
            xs, zs = x[still[i:j]].tolist(), z[still[i:j]].tolist()
            digests = [_digest(region[f:t]) for f, t in zip(xs, zs, strict=True)]
            left.append((_digest(core), key, digests, flags[still[i:j]].tolist(), [lo + f for f in xs], [lo + t for t in zs]))
    return spans, left


def _sorted_regions(regions: DataFrame, length: int, words: int | None) -> DataFrame:
    """Spans (key, begin, end; core is null), and blocks (core, key, and arrays of what is told of each open window) of split anchors."""
    names = ["key", "begin", "end", "core", "digests", "settled", "begins", "ends"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Region] = []
        size, last = 0, None

        def told() -> pa.RecordBatch:
            spans, left = _settle(held, length, words)
            rows = [(*s, None, None, None, None, None) for s in spans] + [(key, None, None, core, *windows) for core, key, *windows in left]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names)

        for batch in batches:
            for anchor, part, parts, key, lo, at, region in zip(*[batch[c].to_pylist() for c in ("anchor", "part", "parts", "key", "lo", "at", "region")], strict=True):
                if (anchor, part) != last and size >= SORTED_BYTES:
                    yield told()
                    held, size = [], 0
                last = (anchor, part)
                held.append((key, lo, region, parts > 1, anchor, at))
                size += len(region)
        if held:
            yield told()

    dealt = regions.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    schema = "key binary, begin long, end long, core binary, digests array<binary>, settled array<boolean>, begins array<long>, ends array<long>"
    return dealt.select("anchor", "part", "parts", "key", "lo", "at", "region").mapInArrow(run, schema)


def _texts_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text and the columns of ``wanted`` (key, doc_id, ...): one text for each key, that of the row it names; null ids too."""
    ids = wanted.select(F.col("doc_id").alias("__id"), F.col("key").alias("__wanted"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = base.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__wanted")), "left_semi")
    return texts.select("key", "text").join(wanted.drop("doc_id"), "key").dropDuplicates(["key"])


def spans(docs: DataFrame, length: int = LENGTH, words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: key (``text_key``) and spans (begin, end) of what repeats in each text; of a text with copies, all of it.

    With ``words``, windows are so many words; then copies without a window don't count as copies. A null text counts as empty.
    """
    ship(docs.sparkSession)
    least = words or length  # a word has a byte at least
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= least).withColumn("key", text_key(F.col("text")))
    first = materialise(base.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min(F.octet_length("text")).cast("long").alias("n_bytes")))
    anchors = materialise(_anchors(base.select("key", "text"), length, words))
    place = F.xxhash64("key", "at")
    met = anchors.where("anchor IS NOT NULL").groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    # Written out: only then does the join have plain shuffles on both sides, whose large tasks Spark splits.
    met = materialise(met.select("anchor", F.ceil(F.col("n") / TASK_REGIONS).cast("int").alias("parts")))
    marked = anchors.join(met, "anchor").groupBy("key").agg(F.collect_set(F.struct("anchor", "at", "lo", "hi", "parts")).alias("anchors"))
    listed = materialise(marked.join(first.select("key", "doc_id"), "key"))
    drop(met)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "part", "parts", "key", "lo", "at", "region"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

        for batch in batches:
            for key, text, found in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["anchors"], strict=True):
                data, draw = text.encode(), int.from_bytes(key[:4], "little")
                for anchor, at, lo, hi, parts in zip(*[found.values.field(k).to_pylist() for k in range(5)], strict=True):
                    rows.append((anchor, (draw + lo) % parts, parts, key, lo, at - lo, data[lo:hi]))
                    size += hi - lo
                    if size >= SENT_BYTES:
                        yield told()
                        rows, size = [], 0
        yield told()

    regions = _texts_of(base, listed).select("key", "text", "anchors").mapInArrow(cut, "anchor long, part int, parts int, key binary, lo long, at long, region binary")
    settled = materialise(_sorted_regions(regions, length, words))
    drop(listed)
    done = settled.where("core IS NULL").select("key", "begin", "end")
    blocks = settled.where("core IS NOT NULL")
    # Written out, as ``met``: a core may be that of many blocks.
    cores = materialise(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    left = materialise(blocks.join(cores, "core").select("key", F.inline(F.arrays_zip("digests", "settled", "begins", "ends"))))
    drop(cores)
    again = left.groupBy("digests").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digests")
    late = left.where("NOT settled").join(again, "digests").select("key", F.col("begins").alias("begin"), F.col("ends").alias("end"))
    within = anchors.where("anchor IS NULL").select("key", F.col("lo").cast("long").alias("begin"), F.col("hi").cast("long").alias("end"))
    copied = first.where("copies > 1").select("key", F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end"))
    if words:
        copied = copied.join(anchors.select("key").distinct(), "key", "left_semi")
    out = materialise(done.union(late).union(within).union(copied).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")))
    drop(settled, left, anchors, first)
    return out


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in found:
        if out and s["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["begin"], s["end"]))
    return out


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _whole_characters(data: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, widened to whole characters."""
    out: list[tuple[int, int]] = []
    for a, b in removed:
        while a and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a, b = out.pop()[0], b
        out.append((a, b))
    return out


def _apart(docs: DataFrame, cuts: DataFrame, text_col: str, spans_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``docs`` with their spans, and those that have none, which don't move where the cut texts are few."""
    key = fresh("__key", docs.columns)
    cuts = cuts.withColumnsRenamed({"key": key, "spans": spans_col})
    own = text_key(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key)
    if cuts.count() > BROADCAST_ROWS:
        return docs.join(cuts, own, "left").drop(key), None
    keys = F.broadcast(cuts.select(key))
    return docs.join(keys, own, "left_semi").join(cuts, own).drop(key), docs.join(keys, own, "left_anti")


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text for each row.

    ``text`` is what stays, without the characters that are cut in part. A null text counts as empty. Repeated rows are
    copies: each one's windows start elsewhere too. Texts shorter than ``length`` keep all. Ids may be null or repeat; an
    empty table gives no rows; other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    touched, others = _apart(base, spans(docs, length, id_col=id_col, text_col=text_col), "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, listed in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data, removed = text.encode(), _merged(listed or [])
                kept = kept_bytes(data, _whole_characters(data, removed)).decode()
                out.append((len(data), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept_bytes(data, removed)).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]], names)

    cut = touched.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    if others is None:
        return cut
    none = F.lit(0).cast("long")
    return cut.union(others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, count_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its texts, and a column of their lengths in characters brought up to date.

    With ``words``, what is cut are strings of so many words (``words_of``) that stand elsewhere too, however many bytes they
    have, in place of those of ``length`` bytes. A character that is cut in part goes whole. Null texts stay null; all rows stay.
    """
    spans_col = fresh("__spans", docs.columns)
    touched, others = _apart(docs, spans(docs, length, words, id_col, text_col), text_col, spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index(text_col), []
            for text, listed in zip(batch[text_col].to_pylist(), batch[spans_col].to_pylist(), strict=True):
                data = text.encode() if text and listed else b""
                texts.append(kept_bytes(data, _whole_characters(data, _merged(listed))).decode() if data else text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = touched.mapInArrow(run, docs.schema)
    if others is not None:
        out = out.union(others)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col else out
