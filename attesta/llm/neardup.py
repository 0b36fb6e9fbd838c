"""Near duplicates by MinHash: fast similarity sketches, banding, exact verification, connected components.

1. Each text becomes a shingle set; rows with equal sets form one node, so copies never meet each other again.
2. Nodes that agree in a band share a bucket. Of the first nodes of its buckets, each node is verified against the one that it
   shares most bands with: links that hold are contracted into components.
3. Pairs in a bucket that lie in different components are left. Members are dealt into chunks, each two chunks
   meet once, and a pair goes on if its size ratio allows a link and its sketches don't rule it out (5 standard
   deviations). In a few rounds, over some of the buckets each, each node tries the likeliest of these partners; what is still in different components
   then is verified pair by pair, so a bucket loses no link however many members it has.
4. Components of all verified links give each row the smallest doc_id that it reaches.

Buckets hold 64 bits of a node and pairs 256 bytes of its sketch. Only pairs to be verified meet with their texts: a
text goes to the task of its partner, whose partners are dealt to several tasks where they are many, and words are compared
there byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import sketch
from .common import BROADCAST_ROWS, drop, fresh, gathered, if_few, materialise, slices, texts_of
from .components import components, merged

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of a chunk of a bucket, and shingles of the partners of a node that go to one task.
CHUNK_NODES = 2048
TASK_SHINGLES = 100_000
#: Rounds, at most, in which each node tries the likeliest of its partners alone.
ROUNDS = 4
#: One of so many buckets is looked at in each of these rounds: a node stands in several.
SOME = 4
#: Texts to compare that are few: then few tasks get them.
FEW_TEXTS = 50_000
#: Bytes of text whose words are compared at once.
HELD_BYTES = 500_000
_WORDS = sketch.BINS // 64


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def most_apart(percent: int) -> int:
    """The bins in which the marks of a link differ at most, but for 5 standard deviations."""
    share = (1 - percent / 100) * 3 / 4
    return int(sketch.BINS * share + 5 * (sketch.BINS * share * (1 - share)) ** 0.5)


def text_number(text: Column) -> Column:
    """Tells apart rows that have one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, bands: int = sketch.BANDS) -> DataFrame:
    """doc_id, number, n, node, hi (8 bytes of the node), bands, marks of each row (doc_id, number, text); the last four are null for an empty set."""
    names = ["doc_id", "number", "n", "node", "hi", "bands", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in texts_of(batch["text"])]
            for a, b in slices([len(t) for t in texts]):
                sizes, nodes, keys, kept = [], [], [], []
                for elements in sketch.shingle_sets(texts[a:b]):
                    sizes.append(len(elements))
                    if not len(elements):
                        nodes.append(None), keys.append(None), kept.append(None)
                        continue
                    values = sketch.sketch(elements)
                    nodes.append(_digest(elements))
                    keys.append(sketch.band_keys(values, bands))
                    kept.append(sketch.marks(values))
                his = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["number"].slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(his, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "number", "text").mapInArrow(run, "doc_id long, number long, n long, node binary, hi long, bands array<long>, marks array<long>")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union for two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _plausible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and marks of two joined nodes allow a link."""
    differs = lambda i: F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])
    apart = sum((F.bit_count(differs(i).bitwiseOR(differs(i + _WORDS))) for i in range(_WORDS)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= most_apart(percent))


def verify(pairs: DataFrame, base: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (written; columns a, b: structs of node, doc_id, number, n) that are links, as nodes a and b; a pair may come repeatedly."""
    # The partners of a node go to its task, or to several where they are many; its own text goes to each of these.
    close = gathered(pairs)
    parts = materialise(close(pairs.groupBy(F.col("a.node").alias("hub")).agg(F.ceil(F.sum("b.n") / TASK_SHINGLES).cast("int").alias("parts"))))
    dealt = pairs.join(if_few(parts)(parts), F.col("a.node") == F.col("hub")).withColumn("part", F.pmod(F.xxhash64("b.node"), F.col("parts")).cast("int"))
    members = dealt.select("hub", "part", F.lit(True).alias("member"), F.col("b.node").alias("node"), F.col("b.doc_id").alias("__id"), F.col("b.number").alias("__number"))
    hubs = dealt.select("hub", "part", F.lit(False).alias("member"), F.col("hub").alias("node"), F.col("a.doc_id").alias("__id"), F.col("a.number").alias("__number")).distinct()
    wanted = materialise(close(members.union(hubs)))
    rows = base.join(if_few(wanted)(wanted), (F.col("doc_id") == F.col("__id")) & (F.col("number") == F.col("__number")))
    rows = gathered(wanted, FEW_TEXTS)(rows.select("hub", "part", "member", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            found, hub = [], None
            for (of, part, member, node, _), elements in zip(held, sketch.exact_sets([x[4] for x in held]), strict=True):
                if not member:
                    hub = (of, part, elements)
                elif hub and hub[:2] == (of, part) and linked(hub[2], elements, percent):
                    found.append((of, node))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("hub", "part", "member", "node")], (t.encode() for t in texts_of(batch["text"])), strict=True):
                if size >= HELD_BYTES:
                    yield told()
                    hub = next((x for x in reversed(held) if not x[2]), None)
                    held = [hub] if hub and hub[:2] == row[:2] else []
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield told()

    out = materialise(rows.mapInArrow(run, "a binary, b binary"))
    drop(parts, wanted)
    return out


def _across(told: DataFrame, nodes: DataFrame, percent: int, round_: int) -> DataFrame:
    """Plausible pairs (a, b: 8 bytes of nodes) of different components that share a bucket (told: key, hi, label).

    In round 0 all of them; in others, for each node b the one whose marks agree best in some of the buckets, which differ by round.
    """
    best = round_ > 0
    looked_at = told.where(F.lit(not best) | (F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(SOME)) == 0))
    sizes = looked_at.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    sizes = materialise(gathered(told)(sizes.select("key", F.ceil(F.col("m") / CHUNK_NODES).cast("int").alias("chunks"))))
    own = ["n", "marks"] if best else ["n", "marks", "bands"]
    members = materialise(told.join(if_few(sizes)(sizes), "key"))
    close = gathered(members)
    dealt = if_few(members)(members).join(nodes.select("hi", *own), "hi").withColumn("i", F.pmod(F.xxhash64("hi", F.lit(3)), F.col("chunks")).cast("int"))
    chunks = close(dealt.groupBy("key", "chunks", "i").agg(F.collect_list(F.struct("hi", "label", *own)).alias("rows")))
    met = chunks.select("key", "rows", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    met = met.groupBy("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).agg(F.collect_list(F.struct("i", "rows")).alias("sides"))
    most = most_apart(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y, sides in zip(batch["key"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), batch["sides"], strict=True):
                chunk = np.concatenate([np.full(len(s["rows"]), s["i"].as_py()) for s in sides.values])
                rows = pa.concat_arrays([s["rows"].values for s in sides.values])
                hi, label, n = (rows.field(k).to_numpy() for k in range(3))
                marks = rows.field(3).flatten().to_numpy().reshape(len(hi), -1).view(np.uint64)
                bands = None if best else rows.field(4).flatten().to_numpy().reshape(len(hi), -1)
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(hi) if best else len(hi) - 1):
                    j = slice(0 if best else i + 1, None)
                    ok = (label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
                    if x != y:
                        ok &= chunk[j] != chunk[i]
                    at = np.flatnonzero(ok) + j.start
                    differs = marks[at] ^ marks[i]
                    apart = np.bitwise_count(differs[:, :_WORDS] | differs[:, _WORDS:]).sum(1)
                    at, apart = at[apart <= most], apart[apart <= most]
                    if not best and len(at):
                        # A pair that shares several bands is told in the first of them.
                        first = bands[i][(bands[at] == bands[i]).argmax(1)] == key
                        at, apart = at[first], apart[first]
                    elif len(at):
                        near = np.lexsort((hi[at], apart))[:1]
                        at, apart = at[near], apart[near]
                    if len(at):
                        out.append((hi[at], np.full(len(at), hi[i]), apart))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["a", "b", "apart"])

    pairs = met.select("key", "x", "y", "sides").mapInArrow(run, "a long, b long, apart long")
    if best:
        pairs = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("near")).select("near.a", "b")
    else:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = materialise(close(pairs) if best else pairs)
    drop(sizes, members)
    return out


def _found(base: DataFrame, percent: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows with their nodes, and the first row (first_id, first_number) of the class of each node."""
    rows = materialise(sketches(base, bands))
    live = rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
    # The first row of each node stands for it.
    first = F.min(F.struct("doc_id", "number", "n", "hi", "marks", "bands"))
    nodes = materialise(live.groupBy("node").agg(first.alias("r")).select("node", "r.*"))
    banded = nodes.select("hi", F.explode(F.array_distinct("bands")).alias("key"))
    heads = materialise(banded.groupBy("key").agg(F.min("hi").alias("head"), F.max("hi").alias("last")).where("head < last").select("key", "head"))
    shared = materialise(banded.join(if_few(heads)(heads), "key"))
    drop(heads)
    told_of = ("node", "doc_id", "number", "n")

    def pairs_of(near: DataFrame, marks: bool) -> DataFrame:
        """Pairs of 8 bytes with what ``verify`` needs, and with ``marks`` only those whose sizes and marks allow a link; an end may stand for several nodes."""
        ends = [nodes.select(F.col("hi").alias(f"__{side}"), F.struct(*told_of, *["marks"] * marks).alias(f"e{side}")) for side in "ab"]
        some = if_few(near)
        met = some(near).join(ends[1], F.col("b") == F.col("__b"))
        # Rows with marks are too wide for a broadcast.
        met = (met if marks else some(met)).join(ends[0], F.col("a") == F.col("__a"))
        met = met.where(_plausible("ea", "eb", percent)) if marks else met
        return met.select(*[F.struct(*[F.col(f"e{side}.{c}") for c in told_of]).alias(side) for side in "ab"])

    # Of its buckets' heads, the one that a node shares most bands with is likely the most similar: only that one is tried.
    star = shared.where("hi <> head").groupBy("hi", "head").agg(F.count(F.lit(1)).alias("n"))
    star = materialise(star.groupBy("hi").agg(F.max(F.struct("n", "head")).alias("most")).select(F.col("most.head").alias("a"), F.col("hi").alias("b")))
    pairs = materialise(pairs_of(star, True))
    links = verify(pairs, base, percent)
    found = components(links)
    drop(star, pairs, links)
    # Families whose members are linked in part contract in a few rounds, before all pairs that are left are tried.
    left = ROUNDS
    while left >= 0:
        # Nodes without a link are components by themselves.
        some = if_few(found)
        label = some(nodes.join(some(found), "node").select("hi", F.xxhash64("label").alias("label")))
        told = materialise(shared.select("key", "hi").join(label, "hi", "left").select("key", "hi", F.coalesce("label", "hi").alias("label")))
        met = _across(told, nodes, percent, left)
        # Sizes and marks were looked at there.
        pairs = materialise(pairs_of(met, False))
        more = verify(pairs, base, percent)
        drop(told, met, pairs)
        if more.isEmpty():
            drop(more)
            left = 0 if left > 0 else -1
            continue
        both = merged(found, more)
        drop(more, found)
        found = both
        left -= 1
    drop(shared)
    least = nodes.join(found, "node").groupBy("label").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    own = found.join(least, "label").select("node", "first")
    # Written out, so that the join with all rows stands alone and Spark can split the task of a node with very many rows.
    classes = materialise(nodes.join(own, "node", "left").select("node", F.coalesce("first.doc_id", "doc_id").alias("first_id"), F.coalesce("first.number", "number").alias("first_number")))
    slim = materialise(rows.select("doc_id", "number", "n", "node"))
    drop(rows, nodes, found)
    return slim, classes


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_number(F.col(text_col)).alias("number"), F.col(text_col).alias("text"))


def classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = sketch.BANDS) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept for each row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a text of fewer than five words is
    one shingle, one without words has none and is linked with nothing. ``component_id`` is the smallest doc_id that
    links reach, ``kept`` whether that is the row's own. Repeated rows are copies of each other; a row without an
    id stands alone, kept, its component null; an empty table gives no rows; other columns are left out.
    """
    rows, found = _found(_base(docs, id_col, text_col), percent, bands)
    with_node = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").join(found, "node").select("doc_id", "n", F.col("first_id").alias("component_id"))
    alone = rows.where("node IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_node.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = sketch.BANDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with its smallest id, of repeated rows one; rows without an id all stay.

    Where rows of one id and different texts are that smallest id, one of them stays.
    """
    rows, found = _found(_base(docs, id_col, text_col), percent, bands)
    live = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").join(found, "node")
    first = (F.col("doc_id") == F.col("first_id")) & (F.col("number") == F.col("first_number"))
    mine, other = fresh("__first_id", docs.columns), fresh("__first_number", docs.columns)
    keys = [F.col("doc_id").alias(mine), F.col("number").alias(other)]
    gone = materialise(live.where(~first).select(*keys).distinct())
    again = materialise(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))
    drop(rows, found)
    same = (F.col(id_col).cast("long") == F.col(mine)) & (text_number(F.col(text_col)) == F.col(other))
    some = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    out = docs.join(some(gone), same, "left_anti")
    if again.isEmpty():
        return out
    twice = out.join(some(again), same, "left_semi").withColumn(mine, F.col(id_col).cast("long")).withColumn(other, text_number(F.col(text_col)))
    return out.join(some(again), same, "left_anti").union(twice.dropDuplicates([mine, other]).drop(mine, other))
