"""Content streams, ToUnicode maps, candidate documents and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.sources import candidate, cmaps, pdf_streams, sinks

FONTS = {"/F1": {"width": 1, "map": {c: chr(c) for c in range(32, 127)}}, "/F2": {"width": 2, "map": {1: "α", 2: "β"}}}


def texts(stream):
    glyphs, boxes, reason = pdf_streams.shown(stream, FONTS, 800.0)
    return "".join(g["u"] for g in glyphs), boxes, reason


def test_content_streams():
    assert texts(rb"BT /F1 10 Tf (a\(b\)\101) Tj ET") == ("a(b)A", [], None)
    assert texts(b"BT /F2 10 Tf [<0001> -20 <0002>] TJ ET") == ("αβ", [], None)
    assert texts(b"BT 3 Tr /F1 10 Tf (hidden) Tj ET") == ("", [], None)
    assert texts(b"BT /F2 10 Tf <0001> Tj /F1 9 Tf (ok) Tj /F2 10 Tf <0009> Tj ET") == ("ok", [], "/F2:glyph_undecodable")  # what the font gave before goes too
    assert texts(b"q 2 0 0 3 10 20 cm /Im1 Do Q") == ("", [{"name": "/Im1", "x0": 10.0, "y0": 777.0, "x1": 12.0, "y1": 780.0}], None)
    assert texts(b"BT /F1 10 Tf (open Tj ET")[2] == "string_unterminated"
    assert texts(b"1 cm")[2] == "content_stream_invalid"


def test_to_unicode():
    head = b"1 begincodespacerange <00> <ff> endcodespacerange "
    assert pdf_streams.to_unicode(head + b"1 beginbfchar <41> <03B1> endbfchar 1 beginbfrange <50> <52> <0061> endbfrange", 1) == ({0x41: "α", 0x50: "a", 0x51: "b", 0x52: "c"}, None)
    assert pdf_streams.to_unicode(head + b"2 beginbfchar <41> <03B1> endbfchar", 1)[1] == "to_unicode_cmap_invalid"
    assert pdf_streams.to_unicode(head + b"2 beginbfchar <41> <03B1> <41> <03B2> endbfchar", 1)[1] == "to_unicode_cmap_invalid"
    assert pdf_streams.to_unicode(b"1 begincodespacerange <00> <10> endcodespacerange 1 beginbfchar <41> <03B1> endbfchar", 1)[1] == "to_unicode_cmap_invalid"
    assert pdf_streams.to_unicode(head + b"1 beginbfchar <41> <> endbfchar", 1)[1] == "to_unicode_cmap_invalid"
    assert pdf_streams.to_unicode(head, 2)[1] == "to_unicode_cmap_unsupported"
    assert pdf_streams.to_unicode(head + b"1 beginbfrange <50> <51> [<0061> <0062>] endbfrange", 1)[1] == "to_unicode_cmap_unsupported"
    assert pdf_streams.to_unicode(b"1 beginbfchar <41> <03B1> endbfchar", 1) == ({0x41: "α"}, None)
    assert pdf_streams.encoding({1: "/a"}, [5, "/x", "/y", 1, "/z"]) == {1: "/z", 5: "/x", 6: "/y"}


def test_failing_pages_keep_a_row(spark):
    pages = spark.createDataFrame([(1, bytearray(b"BT /F1 1 Tf (x) Tj ET")), (2, bytearray(b"(bad")), (3, None)], "page int, content binary")
    got = {r["page"]: (r["u"], r["reason"]) for r in pdf_streams.glyph_rows(pages, ["page"], FONTS, 10.0).collect()}
    assert got == {1: ("x", None), 2: (None, "string_unterminated"), 3: (None, "no_glyphs")}


def test_glyph_rows_come_in_small_batches(spark, monkeypatch):
    """A task holds few glyphs as rows at once, whatever the pages' lengths (F4)."""
    import pyarrow as pa

    monkeypatch.setattr(pdf_streams, "GLYPHS", 7)
    contents = [b"BT /F1 10 Tf (%s) Tj [(ab) 3 (c)] TJ ET" % (b"xyz" * n) for n in range(9)] + [b"", b"(bad", b"BT /F1 1 Tf [] Tj /no Tj ET"]
    taken = []

    class Pages:
        schema = spark.createDataFrame([], "page int, content binary").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)

    pdf_streams.glyph_rows(Pages(), ["page"], FONTS, 10.0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(contents)), pa.int32()), pa.array(contents, pa.binary())], ["page", "content"])
    out = list(taken[0](iter([batch])))
    assert max(len(b) for b in out) <= 14
    rows = [r for b in out for r in b.to_pylist()]
    for page, content in enumerate(contents):
        glyphs, _, reason = pdf_streams.shown(content, FONTS, 10.0)
        want = [{"page": page, "sequence": i, **g, "reason": reason} for i, g in enumerate(glyphs)] or [{"page": page, "reason": reason or "no_glyphs"}]
        assert [{k: v for k, v in r.items() if k in want[0]} for r in rows if r["page"] == page] == want


def test_candidate_documents(spark, tmp_path):
    box = {"l": 1, "t": 9, "r": 5, "b": 3, "coord_origin": "BOTTOMLEFT"}
    doc = {"name": "d", "pages": {"1": {"page_no": 1, "image": {"uri": "data:image/png;x"}}}, "texts": [{"self_ref": "#/texts/0", "label": "text", "text": "see $x$ and $y", "prov": [{"page_no": 1, "bbox": box, "charspan": [0, 14]}]}, {"self_ref": "#/texts/1", "label": "formula", "text": "z", "prov": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    read = candidate.read(spark, str(tmp_path))
    assert len([r for r in read.select("name", "_corrupt_record").collect() if r["_corrupt_record"]]) == 1
    good = read.where("_corrupt_record IS NULL").select("name", F.struct(*[c for c in read.columns if c != "_corrupt_record"]).alias("document"))
    got = {r["region_id"]: (r["text"], r["reason"]) for r in candidate.regions(good, "name").collect()}
    assert got == {"#/texts/0:inline:0": ("$x$", "inline_math_bbox_unavailable"), "#/texts/0:inline:1": ("$y", "inline_math_delimiter_unpaired"), "#/texts/1": ("z", "formula_provenance_missing")}
    assert good.select(candidate.pages_valid(F.col("document.pages")), candidate.items_valid(F.col("document.texts"), F.col("document.pages"))).first()[:] == (True, False)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "done")
    assert sinks.pending(rows, spark, path, "id").count() == 2
    sinks.append_records(rows.where("id = 1"), path)
    assert [r["id"] for r in sinks.pending(rows, spark, path, "id").collect()] == [2]
    sinks.write_evidence(rows, str(tmp_path / "evidence"))
    assert spark.read.json(str(tmp_path / "evidence")).count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_evidence(rows, str(tmp_path / "evidence"))


def test_checked_maps(spark):
    head = "1 begincodespacerange <0000> <00ff> endcodespacerange "
    cases = [
        (head + "1 beginbfchar <0041> <03B1> endbfchar", None, 1), ("", None, 0), (None, "invalid", None), (head + "1 beginbfchar <0041> <03B1>", "invalid", None),
        (head + "1 beginbfchar <0041> 03B1 endbfchar", "invalid", None), (head + "1 beginbfrange <0050> <0052> [<0061>] endbfrange", "unsupported", None),
        (head + "1 beginbfrange <0052> <0050> <0061> endbfrange", "invalid", None), (head + "1 beginbfrange <0050> <0052> <D7FE> endbfrange", "invalid", None),
        (head + "1 beginbfrange <0050> <0052> <D835DC00> endbfrange", None, 3), (head + "1 beginbfrange <0050> <0052> <FFFE> endbfrange", "invalid", None),
        ("2 begincodespacerange <0000> <0040> <0041> <0050> endcodespacerange 1 beginbfrange <0030> <0050> <0061> endbfrange", None, 33),
        ("2 begincodespacerange <0000> <0040> <0042> <0050> endcodespacerange 1 beginbfrange <0030> <0050> <0061> endbfrange", "invalid", None),
        (head + "1 beginbfchar <0123456789abcdef0123456789> <0061> endbfchar", "unsupported", None), (head + "1 beginnotdefrange <00> <01> <02> endnotdefrange", "unsupported", None),
        (head + "2 beginbfrange <0010> <0020> <0061> <0020> <0030> <0061> endbfrange", "invalid", None), (head + "1 beginbfchar <00zz> <0061> endbfchar", "unsupported", None),
        ("1 begincodespacerange <00> <ff> endcodespacerange", "unsupported", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, map string")
    got = {r["i"]: (r["code"], r["n_codes"]) for r in cmaps.checked(rows, "i", "map", 2).collect()}
    assert [got[i] for i in range(len(cases))] == [(c and f"to_unicode_cmap_{c}", n) for _, c, n in cases]
