"""Content streams with forms and several fonts, as rows: each stream is read once, what it draws is followed by joins.

``streams``: source, stream (a number), kind, own, content (bytes), and for forms bbox and matrix, for pages height.
``entries``: source, owner, kind, name, target (see ``operators.forms``).
``fonts``: source, font (its number), code_bytes, and a reason where it can't be used.
``codes``: source, font, code, name, gid, u: the glyph of a code, and its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import forms
from ..operators.rounds import cut
from .pdf_streams import IDENTITY, INVISIBLE, times, tokens

# Operators that show text, those that aren't read, and the reasons for them.
SHOWING, UNREAD = {"Tj", "TJ", "'", '"'}, {"'", '"', "BI", "sh"}
UNSUPPORTED = "page_content_unsupported"
#: Bytes of chunks whose codes a task looks up at once.
BLOCK = 1_000_000
ITEMS = "source {key}, stream long, op int, part int, skipped int, kind string, name string, matrix array<double>, ctm array<double>, chunk binary, reason string"


def _six(operands: list[Any]) -> tuple[float, ...] | None:
    return tuple(map(float, operands)) if len(operands) == 6 and all(isinstance(x, float) for x in operands) else None


def items_of(content: bytes) -> list[dict[str, Any]]:
    """What matters in a stream, in order: text to show, draws, faults, and its end, each with the operators since the last one.

    Fonts, text matrices and rendering modes are those of the stream alone, and saving the state keeps none of them. Matrices of
    the state are null from where one is invalid or one is restored that wasn't saved. Invisible text is left out.
    """
    out: list[dict[str, Any]] = []
    operands: list[Any] = []
    font = matrix = None
    mode, op, last = 0, -1, -1
    ctm: tuple[float, ...] | None = IDENTITY
    saved: list[tuple[float, ...] | None] = []

    def put(kind: str, part: int = 0, **more: Any) -> None:
        nonlocal last
        out.append({"op": max(op, 0), "part": part, "skipped": op - last, "kind": kind, "ctm": ctm} | more)
        last = op

    names = set()
    try:
        for value in tokens(content):
            if not isinstance(value, str) or value.startswith("/"):
                operands.append(value)
                continue
            op += 1
            names.add(value)
            if value == "q":
                saved.append(ctm)
            elif value == "Q":
                if not saved:
                    put("state", reason="graphics_state_stack_unbalanced")
                ctm = saved.pop() if saved else None
            elif value == "cm":
                own = _six(operands)
                if own is None:
                    put("state", reason="form_xobject_matrix_invalid")
                ctm = times(own, ctm) if own and ctm else None
            elif value == "Tf":
                font = operands[0]
            elif value == "Tm":
                matrix = tuple(map(float, operands))
            elif value == "Tr":
                mode = operands[0] if len(operands) == 1 and isinstance(operands[0], float) else -1.0
                if mode not in range(8):
                    put("fault", reason="text_rendering_mode_unsupported")
            elif value == "Do":
                put("draw", name=operands[0])
            elif value in ("Tj", "TJ"):
                chunks = [x for x in (operands[-1:] if value == "Tj" else operands[0]) if isinstance(x, bytes)]
                for part, chunk in enumerate([] if mode in INVISIBLE else chunks):
                    put("text", part, name=font, matrix=matrix, chunk=chunk)
            operands = []
    except (ValueError, IndexError, TypeError) as e:
        put("start", reason=str(e) if str(e) in ("string_unterminated", "array_unbalanced") else "content_stream_invalid")
    if names & UNREAD:
        out.append({"op": 0, "part": 0, "skipped": 0, "kind": "start", "ctm": None, "reason": UNSUPPORTED})
    if names & SHOWING:
        out.append({"op": 0, "part": 0, "skipped": 0, "kind": "shows", "ctm": None})
    op += 1
    out.append({"op": op, "part": 0, "skipped": op - last - 1, "kind": "end", "ctm": None})
    return out


def scanned(streams: DataFrame) -> DataFrame:
    """The items of each stream; a null content counts as empty."""
    schema = ITEMS.format(key=streams.schema["source"].dataType.simpleString())
    double = pa.list_(pa.float64())
    kinds = {"op": pa.int32(), "part": pa.int32(), "skipped": pa.int32(), "kind": pa.string(), "name": pa.string(), "matrix": double, "ctm": double, "chunk": pa.binary(), "reason": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch["content"].to_pylist()):
                found = items_of(content or b"")
                at = pa.array([k] * len(found), pa.int32())
                told = [pa.array([i.get(c) for i in found], kind) for c, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch["source"].take(at), batch["stream"].take(at), *told], ["source", "stream", *kinds])

    return streams.where("kind IN ('page', 'form')").select("source", F.col("stream").cast("long"), "content").mapInArrow(run, schema)


def _codes(chunk: bytes, width: int) -> np.ndarray:
    """The codes of a chunk; a rest that is no whole code is left out."""
    raw = np.frombuffer(chunk, np.uint8)[: len(chunk) // width * width].reshape(-1, width)
    out = np.zeros(len(raw), np.int64)
    for column in raw.T:
        out = out * 256 + column
    return out


def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of codes in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of each row's table, in order, and their states: 0 where one can be read, 1 without a glyph, 2 without a text."""
    column = batch["table"]
    flat, ends = column.values, column.offsets.to_pylist()
    codes = flat.field("code").to_numpy(zero_copy_only=False).astype(np.int64)
    no_glyph = pc.equal(pc.fill_null(flat.field("gid"), 0), 0).to_numpy(zero_copy_only=False)
    no_text = pc.equal(pc.fill_null(flat.field("u"), ""), "").to_numpy(zero_copy_only=False)
    states = np.where(no_glyph, 1, np.where(no_text, 2, 0))
    for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False):
        yield (codes[a:b], states[a:b]) if there else (codes[:0], states[:0])


def _failing(rows: DataFrame) -> DataFrame:
    """source, page, at, font_key, k, fault of the first code of each chunk that can't be read; chunks without one have no row."""
    keys = ["source", "page", "at", "font_key"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", k int, fault string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, faults = [], [], []
            for i, (chunk, width, (table, states)) in enumerate(zip(batch["chunk"], batch["code_bytes"].to_pylist(), _tables(batch), strict=True)):
                place, there = _found(table, _codes(chunk.as_py(), width))
                if not there.all() or states[place].any():
                    state = np.where(there, states[place], 1) if len(table) else np.ones(len(place), np.int64)
                    at.append(i)
                    places.append(int(np.argmax(state > 0)))
                    faults.append(("embedded_glyph_required", "agl_mapping_required")[state[places[-1]] - 1])
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(taken) for c in keys], pa.array(places, pa.int32()), pa.array(faults, pa.string())], [*keys, "k", "fault"])

    return rows.select(*keys, "code_bytes", "chunk", "table").mapInArrow(run, schema)


def _slots(rows: DataFrame) -> DataFrame:
    """The rows with ``slots``, the place of each code of the chunk in the table, instead of the chunk: all of them are there."""
    kept = [c for c in rows.columns if c not in ("chunk", "code_bytes", "stream", "op", "part", "at")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", slots array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Places take four bytes a code, so few chunks are handled at once.
            block = np.cumsum(pc.binary_length(whole["chunk"]).to_numpy(zero_copy_only=False)) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                batch = whole.slice(a, b - a)
                found = [_found(table, _codes(chunk.as_py(), width))[0].astype(np.int32) for chunk, width, (table, _) in zip(batch["chunk"], batch["code_bytes"].to_pylist(), _tables(batch), strict=True)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], slots], [*kept, "slots"])

    return rows.select(*kept, "code_bytes", "chunk").mapInArrow(run, schema)


class Scan:
    """All streams of some documents, read once, and the forms in them."""

    def __init__(self, streams: DataFrame, entries: DataFrame) -> None:
        self.streams, self.entries = streams, entries
        self.items = cut(scanned(streams))
        self.draws = self.items.where("kind = 'draw'").select("source", "stream", "op", "name", "ctm")
        self.outcomes = cut(forms.showing_text(streams, entries, self.draws, self.items.where("kind = 'shows'")))

    def opaque_regions(self) -> tuple[DataFrame, DataFrame]:
        """What pages draw besides text, and the first fault of pages where that can't be told.

        Regions: source, page, op, kind, resource, target, x0, y0, x1, y1 (from the top), text_traced, reason. Faults: source, page, op, reason.
        """
        pages = self.streams.where("kind = 'page'").select("source", "stream", F.col("stream").alias("ctx"), "height")
        each = forms.targets(pages, self.draws, self.streams, self.entries)
        shapes = self.streams.select("source", F.col("stream").alias("target"), "bbox", "matrix")
        told = self.outcomes.select("source", F.col("stream").alias("target"), F.col("ctx").alias("target_ctx"), "outcome")
        each = each.join(self.draws.select("source", "stream", "op", "ctm"), ["source", "stream", "op"]).join(shapes, ["source", "target"], "left").join(told, ["source", "target", "target_ctx"], "left")
        form = F.col("target_kind") == "form"
        unit = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
        bbox = F.when(form, F.col("bbox")).otherwise(unit)
        own = F.when(form & F.col("matrix").isNotNull(), F.col("matrix")).otherwise(F.array(*map(F.lit, IDENTITY)))
        sound = F.coalesce((F.size("bbox") == 4) & (F.col("bbox")[0] < F.col("bbox")[2]) & (F.col("bbox")[1] < F.col("bbox")[3]), F.lit(False))
        reason = (
            F.when(F.col("target_kind").isNull(), forms.MISSING).when(~F.col("target_kind").isin("form", "image"), "xobject_subtype_unsupported").when(form & ~sound, "form_xobject_bbox_invalid")
            .when(form & F.col("matrix").isNotNull() & (F.size("matrix") != 6), "form_xobject_matrix_invalid").when(F.col("outcome").isin(forms.CYCLE, forms.MISSING), F.col("outcome"))
        )
        each = each.select("*", reason.alias("reason"), bbox.alias("b"), own.alias("m"))
        states = self.items.where("kind = 'state'").select("source", F.col("stream").alias("page"), "op", "reason").join(pages.select("source", F.col("stream").alias("page")), ["source", "page"])
        starts = self.items.where("kind = 'start' AND reason <> '" + UNSUPPORTED + "'").select("source", F.col("stream").alias("page"), F.lit(-1).alias("op"), "reason").join(pages.select("source", F.col("stream").alias("page")), ["source", "page"])
        faults = starts.unionAll(states).unionAll(each.where("reason IS NOT NULL").select("source", F.col("stream").alias("page"), "op", "reason"))
        faults = faults.groupBy("source", "page").agg(F.min(F.struct("op", "reason")).alias("f")).select("source", "page", "f.op", "f.reason")
        m, c = F.col("m"), F.col("ctm")
        at = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
        placed = [(c[0] * x + c[2] * y + c[4], F.col("height") - (c[1] * x + c[3] * y + c[5])) for i in (0, 2) for j in (1, 3) for x, y in [at(F.col("b")[i], F.col("b")[j])]]
        xs, ys = [p[0] for p in placed], [p[1] for p in placed]
        regions = each.where("reason IS NULL").select(
            "source", F.col("stream").alias("page"), "op", F.when(form, "form_xobject").otherwise("image_xobject").alias("kind"), F.col("name").alias("resource"), "target",
            F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), F.coalesce(F.col("outcome") == forms.TEXT, F.lit(False)).alias("text_traced"),
            F.when(form, "form_xobject_vector_content_unqualified").otherwise("image_xobject_content_unqualified").alias("reason"),
        )
        return regions.join(faults, ["source", "page"], "left_anti"), faults

    def glyphs(self, fonts: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The glyphs of each page, the fonts that are left out, and the pages that can't be read.

        Glyphs: source, page, sequence, operation, font_key, font, code, name, gid, u, matrix; sequences and operations count on
        through the forms that are entered. Exclusions: source, page, font_key, font, reason, operations, sequences: a font with one
        code that can't be read is left out as a whole, what came before included. Faults: source, page, reason, the first one met.
        """
        entered, met = forms.drawn(self.streams, self.entries, self.draws, self.outcomes)
        at = F.concat("path", F.array("op", "part"))
        # Chunks stay where they are: they are met by their places once a step needs their bytes.
        items = self.items.withColumn("size", F.length("chunk")).drop("ctm", "chunk")
        each = cut(entered.join(items, ["source", "stream"]).select("source", "page", "stream", "ctx", "op", "part", "kind", "name", "matrix", "size", "skipped", "reason", at.alias("at"), F.size("path").alias("depth")))
        order = Window.partitionBy("source", "page").orderBy("at")
        counted = each.where("kind <> 'start' AND kind <> 'shows' AND kind <> 'state'")
        # An end stands for the operators behind the last item; states only count on.
        steps = each.where("kind <> 'start' AND kind <> 'shows'").select("source", "page", "at", "stream", "op", "part", "kind", "ctx", "name", "matrix", "size", "reason", (F.sum("skipped").over(order) - 1).alias("operation"))
        named = self.entries.where("kind = 'Font'").select("source", F.col("owner").alias("ctx"), "name", F.col("target").alias("font"))
        text = steps.where("kind = 'text'").drop("kind", "reason").join(named, ["source", "ctx", "name"], "left").join(fonts.select("source", "font", "code_bytes", F.col("reason").alias("load")), ["source", "font"], "left")
        firsts = text.where("font IS NOT NULL").groupBy("source", "page", "name").agg(F.min_by("font", "at").alias("first"))
        key = F.when(F.col("font") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit("@"), "font"))
        load = F.when(F.col("font").isNotNull() & F.col("code_bytes").isNull() & F.col("load").isNull(), "embedded_font_type_unsupported").otherwise(F.col("load"))
        text = cut(text.join(firsts, ["source", "page", "name"], "left").withColumns({"font_key": key, "load": load}).drop("first", "ctx"))
        width = F.coalesce("code_bytes", F.lit(1))
        usable = text.where("font IS NOT NULL AND load IS NULL")
        used = usable.select("source", "font").distinct()
        each_code = F.sort_array(F.collect_list(F.struct("code", "name", "gid", "u")))
        tables = cut(codes.where("code IS NOT NULL").join(used, ["source", "font"], "left_semi").groupBy("source", "font").agg(each_code.alias("table")))
        chunks = self.items.where("kind = 'text'").select("source", "stream", "op", "part", "chunk")
        with_bytes = lambda rows: rows.join(chunks, ["source", "stream", "op", "part"]).join(tables, ["source", "font"], "left")
        failed = cut(_failing(with_bytes(usable.select("source", "page", "stream", "op", "part", "at", "font_key", "font", "code_bytes"))).groupBy("source", "page", "font_key").agg(F.min(F.struct("at", "k", "fault")).alias("f")).select("source", "page", "font_key", F.col("f.at").alias("failed_at"), F.col("f.fault").alias("fault")))
        text = text.join(failed, ["source", "page", "font_key"], "left")
        live = F.col("load").isNull() & (F.col("failed_at").isNull() | (F.col("at") <= F.col("failed_at")))
        # A font that is out already counts by bytes.
        taken = F.when(live, F.floor(F.col("size") / width)).otherwise(F.col("size"))
        text = cut(text.withColumn("taken", taken.cast("long")).withColumn("base", F.sum("taken").over(order) - F.col("taken")))
        own = text.select("source", "page", "at", F.when(F.col("name").isNull(), "text_font_missing").when(F.col("font").isNull(), "font_resource_missing").when(live & (F.col("size") % width != 0), "font_code_width_mismatch").alias("reason"))
        begun = each.where("kind = 'start'").select("source", "page", F.slice("at", F.lit(1), F.size("at") - 2).alias("at"), "reason")
        trace = begun.unionAll(each.where("kind = 'fault'").select("source", "page", "at", "reason")).unionAll(own.where("reason IS NOT NULL")).unionAll(met.select("source", "page", F.col("path").alias("at"), "reason"))
        _, drawn = self.opaque_regions()
        late = trace.groupBy("source", "page").agg(F.min(F.struct("at", "reason")).alias("f")).select("source", "page", F.col("f.reason").alias("late"))
        left_out = text.where("load IS NOT NULL OR failed_at IS NOT NULL").where("font IS NOT NULL")
        out = left_out.select("source", "page", "font_key", "font", F.coalesce("load", "fault").alias("reason"), "operation", "base", "taken")
        pages = self.streams.where("kind = 'page'").select("source", F.col("stream").alias("page"))
        # A page with operators has to show something, or to leave a font out.
        some = text.where("font IS NOT NULL AND taken > 0 OR load IS NOT NULL").select("source", "page").distinct().withColumn("some", F.lit(True))
        busy = counted.where("depth = 0").groupBy("source", "page").agg(F.sum("skipped").alias("ops"))
        told = pages.join(drawn.select("source", "page", F.col("reason").alias("early")), ["source", "page"], "left").join(late, ["source", "page"], "left").join(some, ["source", "page"], "left").join(busy, ["source", "page"], "left")
        silent = F.when(F.col("some").isNull() & (F.coalesce("ops", F.lit(0)) > 0), UNSUPPORTED)
        faults = cut(told.select("source", "page", F.coalesce("early", "late", silent).alias("reason")).where("reason IS NOT NULL"))
        sound = text.where("font IS NOT NULL AND load IS NULL AND failed_at IS NULL").join(faults, ["source", "page"], "left_anti")
        glyphs = _slots(with_bytes(sound.select("source", "page", "stream", "op", "part", "at", "font_key", "font", "code_bytes", "base", "operation", "matrix")))
        glyphs = glyphs.select("*", F.posexplode("slots").alias("k", "slot")).withColumn("c", F.get("table", F.col("slot")))
        glyphs = glyphs.select("source", "page", (F.col("base") + F.col("k")).alias("sequence"), "operation", "font_key", "font", "c.code", "c.name", "c.gid", "c.u", "matrix")
        gone = F.flatten(F.collect_list(F.when(F.col("taken") > 0, F.sequence(F.col("base"), F.col("base") + F.col("taken") - 1)).otherwise(F.array().cast("array<long>"))))
        exclusions = out.groupBy("source", "page", "font_key", "font", "reason").agg(F.sort_array(F.collect_set("operation")).alias("operations"), F.sort_array(gone).alias("sequences"))
        return glyphs, exclusions.join(faults, ["source", "page"], "left_anti"), faults
