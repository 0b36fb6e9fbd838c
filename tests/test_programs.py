"""Content streams with forms, and font programs, against recursion over small cases."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import font_codes, forms
from attesta.sources import content, font_programs, synthetic

STREAMS = "source long, stream long, kind string, own boolean, content binary, bbox array<double>, matrix array<double>, height double"
ENTRIES = "source long, owner long, kind string, name string, target long"


def told(stream):
    return [(i["kind"], i["op"], i.get("name") or i.get("chunk") or i.get("reason")) for i in content.items_of(stream)]


def test_items_of_a_stream():
    assert told(b"") == [("end", 0, None)]
    assert told(b"BT /F1 9 Tf [(a) -3 (b)] TJ 3 Tr (c) Tj ET /X Do") == [("text", 2, "/F1"), ("text", 2, "/F1"), ("draw", 6, "/X"), ("shows", 0, None), ("end", 7, None)]
    assert told(b"Q 1 2 cm 9 Tr")[:3] == [("state", 0, "graphics_state_stack_unbalanced"), ("state", 1, "form_xobject_matrix_invalid"), ("fault", 2, "text_rendering_mode_unsupported")]
    assert ("start", 0, content.UNSUPPORTED) in told(b"/Sh sh")
    assert told(b"(open Tj")[0] == ("start", 0, "string_unterminated")
    assert [i["skipped"] for i in content.items_of(b"q q /A Do Q Q")] == [3, 2]


def slow_outcome(graph, node, active=()):
    """Depth first, as a reader would look for text."""
    stream, ctx = node
    if node in active:
        return forms.CYCLE
    own, shows, draws = graph["forms"][stream]
    if shows:
        return forms.TEXT
    for name in draws:
        target = graph["names"][ctx].get(name)
        if target is None:
            return forms.MISSING
        if target in graph["forms"]:
            found = slow_outcome(graph, (target, target if graph["forms"][target][0] else ctx), (*active, node))
            if found != forms.NONE:
                return found
    return forms.NONE


def slow_drawn(graph, stream, ctx, path, active, out):
    """The streams that are entered, in order, and the first fault, by recursion."""
    out.append((stream, ctx, path))
    for k, name in enumerate(graph["forms"][stream][2] if stream else graph["page"]):
        target = graph["names"][ctx].get(name)
        if target is None:
            return forms.MISSING
        if target not in graph["forms"]:
            continue
        child = target if graph["forms"][target][0] else ctx
        found = slow_outcome(graph, (target, child))
        if found in (forms.CYCLE, forms.MISSING):
            return found
        if found == forms.TEXT:
            if target in active:
                return forms.CYCLE
            fault = slow_drawn(graph, target, child, (*path, k, 0), (*active, target), out)
            if fault:
                return fault
    return None


def graphs(n=150):
    draw = random.Random(11)
    for _ in range(n):
        count = draw.randrange(0, 7)
        names = [f"/N{i}" for i in range(count)]
        own = {k: draw.random() < 0.5 for k in range(1, count + 1)}
        table = lambda: {x: draw.choice([*range(1, count + 1)] * 3 + [100]) for x in names if draw.random() < 0.97}
        yield {
            "page": [draw.choice(names) for _ in range(draw.randrange(1, 4))] if names else [],
            "forms": {k: (own[k], draw.random() < 0.2, [draw.choice(names) for _ in range(draw.randrange(0, 3))]) for k in own},
            "names": {0: table()} | {k: table() for k in own if own[k]},
        }


def tables(spark, all_graphs):
    streams, entries = [], []
    for source, g in enumerate(all_graphs):
        spell = lambda draws, shows: (" ".join(f"{x} Do" for x in draws) + (" BT /F 1 Tf (t) Tj" if shows else "")).encode()
        streams.append((source, 0, "page", True, bytearray(spell(g["page"], False)), None, None, 10.0))
        streams += [(source, k, "form", own, bytearray(spell(draws, shows)), [0.0, 0.0, 1.0, 1.0], None, None) for k, (own, shows, draws) in g["forms"].items()]
        streams.append((source, 100, "image", False, None, None, None, None))
        entries += [(source, owner, "XObject", x, t) for owner, named in g["names"].items() for x, t in named.items()]
    return spark.createDataFrame(streams, STREAMS), spark.createDataFrame(entries, ENTRIES)


def test_forms_against_recursion(spark):
    every = list(graphs())
    scan = content.Scan(*tables(spark, every))
    got = {(r["source"], r["stream"], r["ctx"]): r["outcome"] for r in scan.outcomes.collect()}
    assert len(got) > 60 and set(got.values()) == {forms.TEXT, forms.NONE, forms.CYCLE, forms.MISSING}
    assert got == {k: slow_outcome(every[k[0]], k[1:]) for k in got}
    entered, faults = forms.drawn(scan.streams, scan.entries, scan.draws, scan.outcomes)
    first, went = {}, {}
    for r in entered.orderBy("source", "stream", "ctx", "path").collect():
        went.setdefault(r["source"], []).append((r["stream"], r["ctx"], tuple(r["path"])))
    for r in faults.collect():
        first[r["source"]] = min(first.get(r["source"], ((9,) * 99, "")), (tuple(r["path"]), r["reason"]))
    for source, g in enumerate(every):
        out = []
        fault = slow_drawn(g, 0, 0, (), (), out)
        assert first.get(source, (None, None))[1] == fault
        if fault is None:
            assert went[source] == sorted(out)


def test_fonts_are_left_out_whole(spark):
    page = b"BT /F 9 Tf (ab) Tj /G 9 Tf <00010002> Tj <0009> Tj <00010002> Tj /F 9 Tf (b) Tj ET /X Do BT /F 9 Tf (a) Tj ET"
    streams = [
        (1, 0, "page", True, page, None, None, 10.0), (1, 5, "form", True, b"BT 1 0 0 1 2 3 Tm /F 9 Tf (c) Tj ET", [0.0, 0.0, 1.0, 1.0], None, None),
        (2, 0, "page", True, b"BT (a) Tj ET", None, None, 10.0), (3, 0, "page", True, b"BT /H 9 Tf (a) Tj ET", None, None, 10.0), (4, 0, "page", True, b"BT /G 9 Tf (abc) Tj ET", None, None, 10.0),
        (5, 0, "page", True, b"q Q", None, None, 10.0), (6, 0, "page", True, None, None, None, 10.0), (7, 0, "page", True, b"BT /F 9 Tf (a) Tj ET Q", None, None, 10.0), (8, 0, "page", True, b"BT /L 9 Tf (abc) Tj /F 9 Tf (a) Tj ET", None, None, 10.0),
    ]
    entries = [(s, 0, "Font", f"/{n}", t) for s in range(1, 9) for n, t in (("F", 20), ("G", 21), ("L", 23))] + [(1, 0, "XObject", "/X", 5), (1, 5, "Font", "/F", 22)]
    fonts = [(s, f, w, r) for s in range(1, 9) for f, w, r in ((20, 1, None), (21, 2, None), (22, 1, None), (23, 1, "embedded_truetype_font_required"))]
    codes = [(s, f, c, f"g{c}", c, chr(c + (0 if c > 64 else 944))) for s in range(1, 9) for f, c in ((20, 97), (20, 98), (22, 99), (21, 1), (21, 2))]
    scan = content.Scan(spark.createDataFrame([(*x[:4], x[4] and bytearray(x[4]), *x[5:]) for x in streams], STREAMS), spark.createDataFrame(entries, ENTRIES))
    glyphs, exclusions, faults = scan.glyphs(spark.createDataFrame(fonts, "source long, font long, code_bytes int, reason string"), spark.createDataFrame(codes, "source long, font long, code int, name string, gid int, u string"))
    got = sorted((r["source"], r["sequence"], r["operation"], r["font_key"], r["u"], r["matrix"]) for r in glyphs.collect())
    # The second font fails at its second chunk: what it gave before goes, and its last chunk counts by bytes.
    assert [g[:5] for g in got] == [(1, 0, 2, "/F", "a"), (1, 1, 2, "/F", "b"), (1, 9, 8, "/F", "b"), (1, 10, 14, "/F@22", "c"), (1, 11, 18, "/F", "a"), (8, 3, 4, "/F", "a")]
    assert got[3][5] == [1.0, 0.0, 0.0, 1.0, 2.0, 3.0] and got[0][5] is None
    assert sorted((r["source"], r["font_key"], r["reason"], r["operations"], r["sequences"]) for r in exclusions.collect()) == [
        (1, "/G", "embedded_glyph_required", [4, 5, 6], [2, 3, 4, 5, 6, 7, 8]), (8, "/L", "embedded_truetype_font_required", [2], [0, 1, 2]),
    ]
    assert sorted(map(tuple, faults.select("source", "reason").collect())) == [(2, "text_font_missing"), (3, "font_resource_missing"), (4, "font_code_width_mismatch"), (5, content.UNSUPPORTED), (7, "graphics_state_stack_unbalanced")]


@pytest.mark.parametrize("kind", [0, 4, 6, 12])
def test_sfnt(kind):
    table = {65: 3, 66: 1, 70: 2}
    assert font_programs.sfnt(synthetic.sfnt(9, [(1, 0, kind, table), (3, 1, 4, {0x3B1: 7})])) == (9, [(1, 0, c, g) for c, g in table.items()] + [(3, 1, 0x3B1, 7)])


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_cff(kind):
    data = synthetic.cff([1, 34, 391, 200, 392], ["Sigma", "my.alt"], kind)
    assert font_programs.cff(data) == [".notdef", "space", "A", "Sigma", None, "my.alt"]
    for end in range(0, len(data), 7):
        try:
            font_programs.cff(data[:end])
        except font_programs._FAULTS:
            pass


def test_encodings_and_names(spark):
    base = font_programs.base_encodings()
    assert len(font_programs.standard_names()) == 149 and len(base["/StandardEncoding"]) == 149
    assert [base["/WinAnsiEncoding"].get(c) for c in (39, 96, 128, 146, 173, 233, 129, 247)] == ["quotesingle", "grave", "Euro", "quoteright", "hyphen", "eacute", "bullet", "divide"]
    assert [base["/StandardEncoding"].get(c) for c in (39, 96, 174, 251, 128)] == ["quoteright", "quoteleft", "fi", "germandbls", None]
    assert [base["/MacRomanEncoding"].get(c) for c in (128, 202, 219, 183)] == ["Adieresis", "space", "currency", "summation"]
    names = spark.createDataFrame([("A",), ("alpha",), ("uni03B103B2",), ("u1F600",), ("Aacute.alt",), ("nothing",), ("mine",)], "name string")
    assert {r["name"]: r["u"] for r in font_codes.named_text(names, {"mine": "☺"}).collect()} == {"A": "A", "alpha": "α", "uni03B103B2": "αβ", "u1F600": "😀", "Aacute.alt": "Á", "nothing": None, "mine": "☺"}
    fonts = spark.createDataFrame([(1, 1, "/StandardEncoding", ["65", "/x", "/y", "65", "/z"]), (1, 2, "/Nothing", ["/x", "255", "/y", "/z"])], "source long, font long, base_encoding string, differences array<string>")
    got = {(r["font"], r["code"]): (r["name"], r["bad"]) for r in font_codes.encodings(fonts).where("font = 2 OR code BETWEEN 65 AND 67").collect()}
    assert got == {(1, 65): ("z", False), (1, 66): ("y", False), (1, 67): ("C", False), (2, None): ("x", True), (2, 255): ("y", False), (2, 256): ("z", True)}


def test_no_fonts_and_no_documents(spark):
    rows = spark.createDataFrame([], "source long, n long, text string")
    fonts, codes = font_codes.loaded(synthetic.fonts(rows))
    assert fonts.count() == codes.count() == 0
    scan = content.Scan(synthetic.streams(rows, F.col("text")), synthetic.entries(rows))
    assert [t.count() for t in scan.glyphs(fonts, codes)] == [0, 0, 0]


def _paged(spark, n, letters):
    docs = spark.range(n).select(F.col("id").alias("source"), F.col("id").alias("n"))
    return synthetic.streams(docs, F.repeat(F.lit("abcdez "), letters // 7)), synthetic.entries(docs), docs


def test_glyphs_are_counted_by_chunks(spark, monkeypatch):
    """No table that is written has a row for each glyph, and glyphs aren't shuffled (F1, F2, F13)."""
    from attesta.plans.program_queries import _plain_fonts

    written = []
    plain = content.cut
    monkeypatch.setattr(content, "cut", lambda df: written.append(plain(df)) or written[-1])
    streams, entries, docs = _paged(spark, 8, 7000)
    glyphs, exclusions, faults = content.Scan(streams, entries).glyphs(*_plain_fonts(docs))
    assert max(t._rows for t in written) < 400
    assert glyphs.count() > 30_000 and exclusions.count() + faults.count() > 0
    plan = glyphs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join")


def test_codes_of_chunks():
    assert content._codes(b"ab\0", 1).tolist() == [97, 98, 0] and content._codes(b"\1\2\3\4\5", 2).tolist() == [258, 772] and content._codes(b"", 2).tolist() == []
    import numpy as np

    at, there = content._found(np.array([3, 5]), np.array([5, 4, 9, 3]))
    assert there.tolist() == [True, False, False, True] and at[[0, 3]].tolist() == [1, 0]


def test_first_failing_code(spark):
    schema = "source long, page long, at array<int>, font_key string, code_bytes int, chunk binary, table array<struct<code:int,name:string,gid:int,u:string>>"
    table = [(97, "a", 1, "a"), (98, "b", 0, "b"), (99, "c", 2, "")]
    rows = [(1, 0, [0], "/A", 1, b"aab", table), (2, 0, [1], "/A", 1, b"aca", table), (3, 0, [2], "/A", 1, b"a", table), (4, 0, [3], "/A", 1, b"ax", table), (5, 0, [4], "/A", 1, b"a", None), (6, 0, [5], "/A", 2, b"\0a\0a\0b\0", table)]
    got = {r["source"]: (r["k"], r["fault"]) for r in content._failing(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "embedded_glyph_required"), 2: (1, "agl_mapping_required"), 4: (1, "embedded_glyph_required"), 5: (0, "embedded_glyph_required"), 6: (2, "embedded_glyph_required")}


def test_fonts_are_read_by_themselves(spark):
    """A font's codes need no shuffle, no broadcast and no table of all fonts (F5, F6), and odd fonts have reasons."""
    docs = spark.range(60).select(F.col("id").alias("source"), F.col("id").alias("n"))
    for told in font_codes.loaded(synthetic.fonts(docs)):
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Scan parquet" not in plan and told.count()
    kinds = synthetic.FONTS.replace("long, n long", "long")
    cff = synthetic.cff([34, 391, 392, 393], ["uni03B103B2", "uD800", "x.alt"])
    sfnt = synthetic.sfnt(9, [(1, 0, 0, {65: 2}), (3, 1, 4, {0x3B1: 5, 0x3B2: 6})])
    one = lambda font, differences, base="/StandardEncoding", **own: (1, font, "/Type1", "/ABCDEF+X", None, base, differences, None, None, None, True, "FontFile3", "/Type1C", bytearray(cff), None)
    rows = [
        one(1, ["200", "/uni03B103B2", None, "/uD800", "7", "/x.alt", "/A"]), one(2, ["/A"]), one(3, ["99999999999", "/A"]), one(4, ["255", "/A", "/A"]), one(5, None), one(6, [], None),
        (1, 7, "/TrueType", None, None, None, None, None, None, None, True, "FontFile2", None, bytearray(sfnt), bytearray(synthetic.to_unicode({65: "x", 66: "α", 67: "β"}, 1))),
        (1, 8, None, None, None, None, None, None, None, None, None, None, None, None, None), (1, 9, "/Type0", None, "/Identity-H", None, None, 1, "/CIDFontType2", None, True, "FontFile2", None, None, None),
    ]
    fonts, codes = font_codes.loaded(spark.createDataFrame(rows, kinds))
    assert {r["font"]: r["reason"] for r in fonts.collect()} == {1: None, 2: font_codes.ENCODING, 3: font_codes.ENCODING, 4: font_codes.ENCODING, 5: None, 6: font_codes.ENCODING, 7: None, 8: font_codes.TYPE, 9: font_programs.INVALID}
    got = {(r["font"], r["code"]): (r["name"], r["gid"], r["u"]) for r in codes.collect()}
    assert got == {(1, 65): ("A", 1, "A"), (1, 8): ("A", 1, "A"), (1, 200): ("uni03B103B2", 2, "αβ"), (1, 202): ("uD800", 3, None), (1, 7): ("x.alt", 4, "x"), (5, 65): ("A", 1, "A"), (7, 65): ("gid2", 2, "x"), (7, 66): ("gid5", 5, "α"), (7, 67): ("gid6", 6, "β")}
