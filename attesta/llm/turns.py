"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``, by a retained-subsequence DP.

A DP over the turns that are retained, kept or reroled: what lies between two of them is deleted at the price of a difference of
prefix sums, so a running minimum per state (the role of the last retained turn, or none yet) prices every gap at once; the two
roles say what has to be inserted between them, and of equal costs the least audit stays. Audits that have read the same turns
are never prefixes of each other where both end with a turn's letter, so the least one stays the least whatever follows.

A conversation may hold any share of all rows. Rows are sorted by ranges of all keys, not dealt by conversation, and taken in
blocks of bounded size. A block becomes a matrix from the state before it to the state behind it; matrices are chained in order,
one row per block. Repaired texts are put together block by block. Only the digest of a conversation of several blocks is
sequential by its nature: its chunks stream through one task, which holds one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import materialise

#: Bits of the number of rows of a block.
BLOCK_BITS = 10
#: Bytes of repaired text from which a chunk is written.
CHUNK_BYTES = 1 << 20
#: Prices of edits.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
#: Inserted turns between the roles of two retained ones ('' before the first); other pairs can't follow each other.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Inserted turns behind the last retained one.
BEHIND = {"": 0, "s": 2, "u": 1, "a": 0}
#: The role of a turn that is inserted, or reroled, behind a retained one.
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}
LEGAL = {"su", "ua", "au"}
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

#: Of the state before some turns, the cost and the audit of the cheapest edits by the state behind them.
Best = dict[str, tuple[int, str]]


def price(turns: list[tuple[str, int]], before: str) -> Best:
    """The cheapest edits of some turns, each a role's initial and a fault, by the role of the last retained turn."""
    # Costs are held less the price of deleting all turns so far, so a gap that grows changes none of them.
    best: dict[str, tuple[int, str, int]] = {before: (0, "", 0)}
    for i, (initial, fault) in enumerate(turns):
        if fault in (BLANK, DUPLICATE):
            continue
        found = []
        for role in ("s", "u", "a"):
            if initial != role and role == "s":
                continue
            edit, letter = (0, "K") if initial == role else (REROLE, "R")
            options = [(g + INSERT * n + edit, q) for q, (g, _, _) in best.items() if (n := BETWEEN.get((q, role), -1)) >= 0]
            if not options:
                continue
            least = min(options)[0]
            audits = [best[q][1] + "D" * (i - best[q][2]) + "I" * BETWEEN[q, role] + letter for cost, q in options if cost == least]
            found.append((role, least + TRUNCATED * (fault == CUT) - DELETE, min(audits)))
        for role, cost, audit in found:
            held = best.get(role)
            if held is None or cost < held[0] or cost == held[0] and audit < held[1] + "D" * (i + 1 - held[2]):
                best[role] = (cost, audit, i + 1)
    n = len(turns)
    return {role: (cost + DELETE * n, audit + "D" * (n - upto)) for role, (cost, audit, upto) in best.items()}


def repair(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """The cost and the audit of a whole conversation."""
    return min((cost + INSERT * BEHIND[role], audit + "I" * BEHIND[role]) for role, (cost, audit) in price(turns, "").items())


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by the crc32 of ``conv_id:turn``; ``gone`` marks rows that are dropped."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("kind", (F.crc32(key.cast("binary")) % 20).cast("int"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.explode(F.array_repeat(kind == 0, F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("gone"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows, sorted and numbered: ``pos`` rises in the order of conversations and turns, and ``blk`` says the block."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    keys = ["conv_id", "turn", "mark"]
    rows = rows.withColumn("mark", mark).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return rows.withColumns({
        "blk": F.shiftright("pos", BLOCK_BITS), "initial": F.substring("role", 1, 1),
        "blank": ~F.col("text").rlike(VISIBLE), "cut": ~F.col("text").rlike(ENDED),
    })


_SUMMARY = "conv_id {id}, blk long, blanks long, duplicates long, cuts long, illegal long, first string, last string, low long, high long, turns long, matrix array<struct<before:string,behind:string,cost:long,audit:string>>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: its counts, what its borders have to be compared with, and its matrix."""
    for batch in batches:
        out = []
        for head, block in zip(batch["head"].to_pylist(), batch["block"].to_pylist(), strict=True):
            faults = [t["fault"] for t in block]
            initials = [t["initial"] for t in block]
            turns = [t["turn"] for t in block if t["turn"] is not None]
            told = list(zip(initials, faults, strict=True))
            matrix = [{"before": q, "behind": r, "cost": c, "audit": a} for q in ([""] if head else NEXT) for r, (c, a) in price(told, q).items()]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            out.append((*(faults.count(k) for k in (BLANK, DUPLICATE, CUT)), illegal, initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)), matrix))
        names = ["blanks", "duplicates", "cuts", "illegal", "first", "last", "low", "high", "turns", "matrix"]
        told = pa.struct([("before", pa.string()), ("behind", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(told)]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["blk"], *arrays], ["conv_id", "blk", *names])


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLAN = "conv_id {id}, blk long, single boolean, before string, piece string, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string"


class _Chain:
    """The blocks of one conversation, chained from the first to the last."""

    def __init__(self, conv: object) -> None:
        self.conv, self.blocks = conv, []
        self.counts = [0, 0, 0, 0]
        self.low = self.high = self.last = self.turn = None
        self.turns = 0
        #: By state: cost, audit, and the way to it as (way, state before, piece).
        self.best: dict[str, tuple[int, str, tuple | None]] = {"": (0, "", None)}

    def add(self, row: dict) -> None:
        self.blocks.append(row["blk"])
        for k, name in enumerate(("blanks", "duplicates", "cuts", "illegal")):
            self.counts[k] += row[name]
        if self.last is not None:
            self.counts[3] += self.last + row["first"] not in LEGAL
        self.last = row["last"]
        if row["turns"]:
            self.turns += row["turns"] - (self.high == row["low"] and self.high is not None)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        best: dict[str, tuple[int, str, tuple | None]] = {}
        for way in row["matrix"]:
            if way["before"] in self.best:
                cost, audit, path = self.best[way["before"]]
                found = (cost + way["cost"], audit + way["audit"], (path, way["before"], way["audit"]))
                if way["behind"] not in best or found[:2] < best[way["behind"]][:2]:
                    best[way["behind"]] = found
        self.best = best

    def rows(self) -> list[tuple]:
        ends = [(cost + INSERT * BEHIND[q], audit + "I" * BEHIND[q], q) for q, (cost, audit, _) in self.best.items()]
        cost, audit, state = min(ends)
        path, pieces, tail = self.best[state][2], [], "I" * BEHIND[state]
        while path:
            path, before, piece = path
            pieces.append((before, piece + tail))
            tail = ""
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        out = []
        for k, (blk, (before, piece)) in enumerate(zip(self.blocks, reversed(pieces), strict=True)):
            stats = (gaps, *self.counts, cost, audit) if k == 0 else (None,) * 7
            out.append((self.conv, blk, len(self.blocks) == 1, before, piece, *stats))
        return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come in order: a row for each with the edits that the whole conversation's cheapest way takes there."""
    chain, kind = None, None
    names = ["conv_id", "blk", "single", "before", "piece", *_STATS, "audit"]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if chain is None or chain.conv != row["conv_id"]:
                out += chain.rows() if chain else []
                chain = _Chain(row["conv_id"])
            chain.add(row)
        if out:
            yield told(out)
    if chain:
        yield told(chain.rows())


class _Writer:
    """The repaired lines of one block: digested where the block is all there is, else in chunks."""

    def __init__(self, row: dict) -> None:
        self.conv, self.blk, self.single = row["conv_id"], row["blk"], row["single"]
        self.edits, self.at, self.state = row["piece"], 0, row["before"]
        self.digest, self.empty = hashlib.sha256(), True
        self.lines: list[bytes] = []
        self.size = self.seq = 0

    def _line(self, role: str, text: str) -> None:
        line = f"\n{role}:{text}".encode()
        if self.single:
            self.digest.update(line[self.empty :])
            self.empty = False
        else:
            self.lines.append(line)
            self.size += len(line)

    def insertions(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            role = NEXT[self.state]
            self._line(role, "")
            self.state = role[0]

    def add(self, role: str, text: str) -> Iterator[tuple]:
        self.insertions()
        letter = self.edits[self.at]
        self.at += 1
        if letter != "D":
            role = role if letter == "K" else NEXT[self.state]
            self._line(role, text)
            self.state = role[0]
        if self.size >= CHUNK_BYTES:
            yield self._chunk()

    def _chunk(self) -> tuple:
        self.seq += 1
        out = (self.conv, self.blk, self.seq, b"".join(self.lines), None)
        self.lines, self.size = [], 0
        return out

    def end(self) -> Iterator[tuple]:
        self.insertions()
        if self.single:
            yield (self.conv, self.blk, 0, None, self.digest.hexdigest())
        elif self.lines:
            yield self._chunk()


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "blk", "seq", "chunk", "repaired_sha256"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each block's edits before its turns: its digest, or its text in chunks."""
    writer, kind = None, None
    for batch in batches:
        kind, out, size = batch.schema.field("conv_id").type, [], 0
        for row in batch.to_pylist():
            if row["piece"] is not None:
                out += writer.end() if writer else []
                writer = _Writer(row)
                continue
            for chunk in writer.add(row["role"], row["text"]):
                out.append(chunk)
                size += len(chunk[3])
            if size >= 8 * CHUNK_BYTES:
                yield _batch(out, kind)
                out, size = [], 0
        if out:
            yield _batch(out, kind)
    if writer and (out := list(writer.end())):
        yield _batch(out, kind)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come in order: the digest of each conversation."""
    conv, digest, kind = None, None, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            chunk = row["chunk"]
            if digest is None or conv != row["conv_id"]:
                if digest:
                    out.append((conv, 0, 0, None, digest.hexdigest()))
                conv, digest, chunk = row["conv_id"], hashlib.sha256(), chunk[1:]
            digest.update(chunk)
        if out:
            yield _batch(out, kind)
    if digest:
        yield _batch([(conv, 0, 0, None, digest.hexdigest())], kind)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> tuple[DataFrame, DataFrame]:
    """Return a row per conversation, and the edits by block: ``conv_id``, ``blk``, ``before`` and ``piece``.

    Rows are damaged first (unless ``damage`` is false). Turns of one conversation stand by ``turn`` (nulls first), those of one
    turn by the digest of role and text; equal rows can change places. Null roles and texts count as one blank; a null
    conversation is one too. A role without an initial of s, u, a can't be kept. A conversation whose rows are all dropped gives
    zeros, an empty audit and the digest of the empty text; an empty table gives no rows; other columns are left out.
    A conversation's blocks and audit pass through one task (a row for each 1024 turns), as do the chunks of its text, one after
    the other; its turns don't.
    """
    ship(rows.sparkSession)
    rows = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    plain = damaged(rows) if damage else rows.withColumn("gone", F.lit(False))
    held = materialise(_ordered(plain))
    kind = held.schema["conv_id"].dataType.simpleString()
    live = held.where("not gone")
    firsts = live.where("not blank").groupBy("conv_id", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"), F.lit(False).alias("head"))
    heads = live.groupBy("conv_id").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("new"), F.lit(True).alias("head"))
    marks = firsts.unionAll(heads).groupBy("pos").agg(F.max("new").alias("new"), F.max("head").alias("head"))
    fault = F.when(F.col("blank"), BLANK).when(~F.coalesce("new", F.lit(False)), DUPLICATE).when(F.col("cut"), CUT).otherwise(NO_FAULT)
    turns = live.select("conv_id", "blk", "pos", "turn", "initial", "blank", "cut").join(marks, "pos", "left")
    turns = turns.select("conv_id", "blk", F.coalesce("head", F.lit(False)).alias("head"), F.struct("pos", "turn", "initial", fault.alias("fault")).alias("t"))
    blocks = turns.groupBy("conv_id", "blk").agg(F.max("head").alias("head"), F.sort_array(F.collect_list("t")).alias("block"))
    summaries = blocks.mapInArrow(_summaries, _SUMMARY.format(id=kind))
    plan = materialise(summaries.repartition("conv_id").sortWithinPartitions("conv_id", "blk").mapInArrow(_chained, _PLAN.format(id=kind)))

    edits = plan.select("conv_id", "blk", F.lit(-1).cast("long").alias("pos"), "single", "before", "piece", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = live.select("conv_id", "blk", "pos", F.lit(None).cast("boolean").alias("single"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("piece"), "role", "text")
    chunk = f"conv_id {kind}, blk long, seq long, chunk binary, repaired_sha256 string"
    written = materialise(edits.unionAll(lines).repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", "pos").mapInArrow(_written, chunk))
    several = written.where("chunk is not null").repartition("conv_id").sortWithinPartitions("conv_id", "blk", "seq").mapInArrow(_digested, chunk)
    digests = written.where("repaired_sha256 is not null").unionAll(several)

    told = held.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in _STATS], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    told = told.unionByName(plan.where("audit is not null").select("conv_id", *_STATS, "audit"), allowMissingColumns=True)
    told = told.unionByName(digests.select("conv_id", "repaired_sha256"), allowMissingColumns=True)
    whole = told.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*_STATS, "audit", "repaired_sha256"]])
    empty = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _STATS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    out = whole.select(*[(empty[c] if c in empty else F.col(c)).alias(c) for c in whole.columns])
    return out, plan.select("conv_id", "blk", "before", "piece")
