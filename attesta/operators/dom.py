"""The elements of HTML documents as rows, and the audit of links against them.

A document is parsed once, in a mapped call; whether an element is there exactly once, and on its page, are groupings by keys of three
parts, whatever the number of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational
from .html import VOID

# Attributes of published formulas, the prefix of a page's anchor, and the codes of links that fail.
REF, SPAN, CORRECTION, PAGE = "data-docling-ref", "data-docling-charspan", "data-correction-id", "page-"
IDENTITY_MISSING = "linked_math_identity_missing"
CODES = {"missing": "linked_math_missing", "wrong_page": "linked_math_page_mismatch", "duplicated": "linked_math_duplicated"}


class _Nodes(HTMLParser):
    """Elements of some tags in the order of their start: attributes, path, anchors above, own markup and text."""

    def __init__(self, tags: set[str]) -> None:
        super().__init__(convert_charrefs=False)
        self.tags, self.rows = tags, []
        self.open: list[dict] = []
        self.seen: dict[tuple[int, str], int] = {}
        self.count = 0

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], closes: bool) -> None:
        self._text(self.get_starttag_text())
        above = self.open[-1] if self.open else None
        within = (above["number"] if above else -1, tag)
        self.seen[within] = self.seen.get(within, 0) + 1
        # The first of two attributes of one name counts.
        named = dict(reversed([(k, v or "") for k, v in attrs]))
        node = {
            "number": self.count, "parent": above["number"] if above else None, "path": f"{above['path'] if above else ''}/{tag}[{self.seen[within]}]", "tag": tag, "attributes": list(named.items()),
            "anchors": above["anchors"] + ([above["id"]] if above["id"] else []) if above else [], "id": named.get("id"), "markup": [self.get_starttag_text()] if tag in self.tags else None,
        }
        self.count += 1
        if tag in self.tags:
            self.rows.append(node)
        if not closes:
            self.open.append(node)

    def _text(self, text: str) -> None:
        for node in self.open:
            if node["markup"] is not None:
                node["markup"].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # HTML knows no self-closing elements but within formulas and drawings.
        inside = any(n["tag"] in ("math", "svg") for n in self.open) or tag in VOID
        self._start(tag, attrs, inside)

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self.open):
            while True:
                if self.open[-1]["tag"] == tag:
                    self._text(f"</{tag}>")
                    self.open.pop()
                    return
                self.open.pop()

    def handle_data(self, data: str) -> None:
        self._text(data)

    def handle_entityref(self, name: str) -> None:
        self._text(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._text(f"&#{name};")


def elements_of(html: str, tags: set[str]) -> list[dict]:
    parser = _Nodes(tags)
    parser.feed(html)
    parser.close()
    return parser.rows


def elements(pages: DataFrame, key: str, html: str, tags: list[str]) -> DataFrame:
    """key, number, parent, path, tag, attributes, anchors (ids of the elements above), markup, page of each element of some tags.

    ``number`` counts all elements of the document in the order of their start; ``page`` is that of the nearest anchor of a page above.
    A null document has no elements.
    """
    pairs = pa.map_(pa.string(), pa.string())
    kinds = {"number": pa.int32(), "parent": pa.int32(), "path": pa.string(), "tag": pa.string(), "attributes": pairs, "anchors": pa.list_(pa.string()), "markup": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["html"].to_pylist()):
                found = elements_of(text or "", set(tags))
                at = pa.array([k] * len(found), pa.int32())
                told = [pa.array(["".join(n[c]) if c == "markup" else n[c] for n in found], kind) for c, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch[key].take(at), *told], [key, *kinds])

    rows = pages.select(key, F.col(html).alias("html"))
    out = rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, number int, parent int, path string, tag string, attributes map<string,string>, anchors array<string>, markup string")
    numbers = F.filter(F.transform("anchors", lambda a: F.nullif(F.regexp_extract(a, rf"^{re.escape(PAGE)}(\d+)$", 1), F.lit(""))), lambda x: x.isNotNull())
    return out.withColumn("page", F.try_element_at(numbers, F.lit(-1)).cast("int"))


def _status(n: str = "n", here: str = "here") -> Column:
    n, here = F.coalesce(n, F.lit(0)), F.coalesce(here, F.lit(0))
    return F.when((n == 1) & (here == 1), "matched").when(n == 1, "wrong_page").when(n == 0, "missing").otherwise("duplicated")


def audited_links(doc: str, regions: DataFrame, items: DataFrame, corrections: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc, region_id, corrected, ref, span, matches, status and code of each linked region: is its formula in the document once, on its page?

    ``regions``: doc, region_id, page, ref, start, end, text, linked, verdict; those that aren't linked or can't be verified aren't audited.
    ``items``: doc, ref, label, text: the texts of the document as published. ``corrections``: doc, target_id, status, ref, start, end,
    after, derived_ref, derived_start, derived_end, region_ids, proofs (region_id, start, end, text); accepted ones count.
    ``nodes``: the math elements of the documents (``elements``).

    A region's place in the published text is its own, moved by the corrections before it; one that overlaps a correction has none. A corrected
    region is looked for by its correction too, and its correction has to prove this very region. Identities that don't hold
    are ``identity_missing``; several accepted corrections of a region leave the one with the greatest target_id.
    """
    math = nodes.where("tag = 'math'").select(doc, "page", "anchors", *[F.try_element_at("attributes", F.lit(a)).alias(n) for a, n in ((REF, "ref"), (SPAN, "span"), (CORRECTION, "target_id"))]).where("ref IS NOT NULL AND span IS NOT NULL")
    audited = regions.where("linked AND verdict <> 'non_verifiable'")
    accepted = corrections.where("status = 'accepted'")
    each = accepted.select(doc, F.explode("region_ids").alias("region_id"), F.struct("target_id", F.coalesce("derived_ref", "ref").alias("ref"), "derived_start", "derived_end", "after", "proofs").alias("c"))
    own = each.groupBy(doc, "region_id").agg(F.max_by("c", "c.target_id").alias("c"))
    audited = audited.join(own, [doc, "region_id"], "left")

    plain = audited.where("c IS NULL").drop("c")
    spans = plain.where("ref IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select(F.struct(doc, "ref").alias("k"), F.col("region_id").alias("id"), "start", "end")
    edits = accepted.where("ref IS NOT NULL").select(F.struct(doc, "ref").alias("k"), F.col("start").alias("e_start"), F.col("end").alias("e_end"), (F.length("after") - F.col("end") + F.col("start")).alias("delta"))
    moved = relational.mapped_spans(spans, edits, "k").select(F.col(f"k.{doc}").alias(doc), F.col("id").alias("region_id"), "new_start", "new_end")
    texts = items.select(doc, "ref", "label", F.col("text").alias("whole"))
    inside = lambda a, b: (F.col(a) >= 0) & (F.col(a) < F.col(b)) & (F.col(b) <= F.length("whole"))
    cut = lambda a, b: F.substring(F.col("whole"), F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    plain = plain.join(moved, [doc, "region_id"], "left").join(texts, [doc, "ref"], "left")
    formula = F.col("label") == "formula"
    plain = plain.select(
        doc, "region_id", "page", F.lit(False).alias("corrected"), "ref", F.lit(None).cast("string").alias("target_id"), F.concat_ws(":", F.when(formula, 0).otherwise(F.col("new_start")), F.when(formula, F.length("whole")).otherwise(F.col("new_end"))).alias("span"),
        F.coalesce(inside("new_start", "new_end") & (cut("new_start", "new_end") == F.col("text")), F.lit(False)).alias("valid"),
    )
    changed = audited.where("c IS NOT NULL").drop("ref").select("*", "c.*").join(texts, [doc, "ref"], "left")
    proof = F.try_element_at(F.filter("proofs", lambda p: p["region_id"] == F.col("region_id")), F.lit(1))
    proven = (proof["start"] == F.col("start")) & (proof["end"] == F.col("end")) & (proof["text"] == F.col("text"))
    changed = changed.select(
        doc, "region_id", "page", F.lit(True).alias("corrected"), "ref", "target_id", F.concat_ws(":", "derived_start", "derived_end").alias("span"),
        F.coalesce(inside("derived_start", "derived_end") & (cut("derived_start", "derived_end") == F.col("after")) & proven & F.col("target_id").isNotNull(), F.lit(False)).alias("valid"),
    )
    wanted = plain.unionAll(changed)
    at = F.concat(F.lit(PAGE), F.col("page").cast("string"))
    # A node counts for a page if it stands anywhere under the page's anchor.
    counts = lambda keys: wanted.where("valid").select(doc, "region_id", at.alias("at"), *keys).join(math.select(doc, "anchors", *keys), [doc, *keys]).groupBy(doc, "region_id").agg(F.count("*").alias("n"), F.count_if(F.array_contains("anchors", F.col("at"))).alias("here"))
    found = counts(["ref", "span"]).withColumn("corrected", F.lit(False)).unionAll(counts(["ref", "span", "target_id"]).withColumn("corrected", F.lit(True)))
    out = wanted.join(found, [doc, "region_id", "corrected"], "left").withColumn("status", F.when(~F.col("valid"), "identity_missing").otherwise(_status()))
    codes = F.coalesce(*[F.when(F.col("status") == s, c) for s, c in (CODES | {"identity_missing": IDENTITY_MISSING}).items()])
    return out.select(doc, "region_id", "corrected", "ref", F.when(F.col("valid"), F.col("span")).alias("span"), F.when(F.col("valid"), F.coalesce("n", F.lit(0))).alias("matches"), "status", codes.alias("code"))


def publication_faults(doc: str, accepted: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc, target_id, code of accepted corrections (doc, target_id, page, markup) that aren't published as one element, on their page, with
    their own markup; and of elements that no accepted correction has."""
    shown = nodes.where("tag = 'math'").select(doc, F.try_element_at("attributes", F.lit(CORRECTION)).alias("target_id"), F.col("page").alias("p"), F.col("markup").alias("m")).where("target_id IS NOT NULL")
    each = shown.groupBy(doc, "target_id").agg(F.count("*").alias("n"), F.max("p").alias("p"), F.max("m").alias("m"))
    met = accepted.select(doc, "target_id", "page", "markup", F.lit(True).alias("wanted")).join(each, [doc, "target_id"], "full")
    code = (
        F.when(F.col("wanted").isNull(), "correction_node_unexpected").when(F.col("n").isNull(), "correction_node_missing").when(F.col("n") > 1, "correction_node_duplicated")
        .when(~F.col("p").eqNullSafe(F.col("page")), "correction_page_mismatch").when(~F.col("m").eqNullSafe(F.col("markup")), "correction_markup_mismatch")
    )
    return met.select(doc, "target_id", code.alias("code")).where("code IS NOT NULL")
