"""Goldens of pure functions."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import dollars, latex
from attesta.functions import geometry as G
from attesta.functions import text as X
from attesta.operators import corrections, layout, linking, relational
from attesta.streaming import protocol


@pytest.mark.parametrize(
    ("candidate", "kind", "tokens", "signature", "reason"),
    [
        (r"x_i^2", "latex", list("xi2"), ["x", "<sub>", "i", "</sub>", "<sup>", "2", "</sup>"], None),
        (r"f$_{w}$$_{,}$$_{b}$ ( x )", "mixed_text", list("fw,b(x)"), ["f", "<sub>", "w", ",", "b", "</sub>", "(", "x", ")"], None),
        (r"x$_{n}$$_{-}$$_{1}$", "mixed_text", list("xn−1"), ["x", "<sub>", "n", "−", "1", "</sub>"], None),
        ("≤ 200%", "mixed_text", list("≤200%"), list("≤200%"), None),
        (r"≤ 200\%", "mixed_text", list("≤200%"), list("≤200%"), None),
        (r"A\\%B", "mixed_text", list("A%B"), list("A%B"), None),
        (r"x$_{i}", "mixed_text", None, None, "candidate_mixed_text_invalid"),
        (r"x$_{i}$$_{}$", "mixed_text", None, None, "candidate_mixed_text_invalid"),
        (r"\frac{2}", "latex", None, None, "candidate_relation_invalid"),
        (r"S\stackrel{\text{def}}{=}", "latex", list("S=def"), ["S", "=", "<over>", "d", "e", "f", "</over>"], None),
        (r"\frac{1}{2}", "latex", list("12"), ["<fraction>", "<numerator>", "1", "</numerator>", "<denominator>", "2", "</denominator>", "</fraction>"], None),
        (r"\unknown x", "latex", None, None, "candidate_command_unsupported"),
        ("", "latex", [], [], None),
    ],
)
def test_analyse(candidate, kind, tokens, signature, reason):
    assert latex.analyse(candidate, kind) == (tokens, signature, reason)


@pytest.mark.parametrize(
    "signature",
    [
        ["{", "(", "<bold>", "x", "</bold>", "<sub>", "i", "</sub>", ",", "y", "<sub>", "i", "</sub>", ")", "}", "<sub>", "i", "=", "1", "</sub>", "<sup>", "N", "</sup>"],
        ["√", "<radicand>", "x", "</radicand>"],
        ["=", "<over>", "d", "e", "f", "</over>"],
        list("x∈A≥0"),
    ],
)
def test_written_latex_is_proven(signature):
    tokens = [t for t in signature if not latex.is_marker(t)]
    written, reason = latex.proven(tokens, signature)
    assert reason is None and written


def test_unwritable_signatures():
    assert latex.proven([""], [""]) == (None, "source_symbol_unsupported")
    assert latex.proven(["x"], ["x", "<sub>", "i"]) == (None, "source_relation_unbalanced")


def test_two_dollar_tokenizers():
    assert dollars.math_spans("costs 5 $ or $x_1$ here") == [(13, 18, "x_1")]
    assert dollars.math_spans("between $5 and $10 it is") == []
    assert dollars.math_spans(r"a \$ b $y$") == [(7, 10, "y")]
    assert dollars.paired_spans("a $x$ b $$y$$ c $") == [(2, 5, None), (8, 13, "inline_math_delimiter_unsupported"), (16, 17, "inline_math_delimiter_unpaired")]
    assert dollars.unescaped(r"\\$ \$", "$") == [2]


def test_geometry(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 10.0, 10.0, 3.0, 3.0, 3.0, 3.0)], "a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    a, b = [G.Box(*[F.col(f"{p}{i}") for i in range(4)]) for p in "ab"]
    got = rows.select(G.overlaps(a, b), G.contains_center(a, b), G.overlap_ratio(a, b), G.iou(a, b)).collect()
    assert [tuple(r) for r in got] == [(False, False, 0.0, 0.0), (True, True, 0.25, 25 / 175), (False, True, 0.0, 0.0)]  # touching isn't overlapping; a middle on the corner counts
    assert spark.range(1).select(G.elapsed(F.lit(93_784)), G.elapsed(F.lit(61))).first()[:] == ("1 j 02:03:04", "00:01:01")
    assert spark.range(1).select(G.valid_box(F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)])), G.valid_box(F.array(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(1.0)))).first()[:] == (True, False)


def test_texts(spark):
    one = spark.range(1)
    assert one.select(X.delimiters_balanced(F.lit("([a]b)")), X.delimiters_balanced(F.lit("([)]"))).first()[:] == (True, False)
    assert one.select(X.spaced_letters(F.lit("a b c d")), X.spaced_letters(F.lit("x = d e f"))).first()[:] == (True, False)
    assert one.select(X.operator_names(F.lit(r"\arg x \argmax"))).first()[0] == r"\operatorname{arg} x \argmax"
    assert one.select(X.code_points(F.lit("a𝐀"))).first()[0] == ["U+0061", "U+1D400"]
    assert one.select(relational.pattern_places(F.array(*map(F.lit, "aabaab")), F.array(F.lit("a"), F.lit("a")))).first()[0] == [0, 3]
    assert one.select(relational.substring_places(F.lit("aaaa"), F.lit("aa"))).first()[0] == [0, 1, 2]


def test_patches():
    assert corrections._patched("hello world", [{"start": 0, "end": 5, "after": "bye"}, {"start": 6, "end": 11, "after": "all"}]) == "bye all"
    assert corrections._patched("hello", [{"start": 0, "end": 3, "after": ""}, {"start": 2, "end": 4, "after": ""}]) is None
    assert corrections._patched("hello", [{"start": 4, "end": 9, "after": ""}]) is None


def glyph(seq, u, x, y=10.0, size=10.0, font="/T", line=0, span=0, name=""):
    return {"seq": seq, "u": u, "font": font, "block": 0, "line": line, "span": span, "size": size, "oy": y, "x0": x, "y0": y - size, "x1": x + 5, "y1": y, "name": name}


def test_layout():
    line = [glyph(0, "w", 0, font="/M"), glyph(1, "x", 6, font="/M"), glyph(2, "=", 12), glyph(3, "0", 18), glyph(4, "p", 30), glyph(5, "q", 36)]
    assert [[g["seq"] for g in r] for r in layout.detect_page(line, {"/M"})] == [[0, 1, 2, 3]]
    renamed = [g | {"font": "/Z" if g["font"] == "/M" else "/Y"} for g in line]  # names of fonts don't matter
    assert [[g["seq"] for g in r] for r in layout.detect_page(renamed, {"/Z"})] == [[0, 1, 2, 3]]
    assert [g["u"] for g in layout.without_open_delimiters([glyph(0, "(", 0), glyph(1, "x", 6)])] == ["x"]
    assert layout.signature([glyph(0, "x", 0), glyph(1, "i", 6, 13.0, 6.0), glyph(2, "2", 6, 6.0, 6.0), glyph(3, "=", 14), glyph(4, "0", 20)]) == (["x", "<sub>", "i", "</sub>", "<sup>", "2", "</sup>", "=", "0"], None)
    assert layout.signature([glyph(0, "i", 0, 13.0, 6.0), glyph(1, "x", 6)]) == (None, "source_script_anchor_missing")
    assert layout.clusters([1.0, 1.05, 5.0, 1.1], 0.1) == [[0, 1, 3], [2]]


def test_linking():
    assert linking.locate("the value w x - b = 0 holds", "w x - b = 0", list(range(11)), False)[:2] == (10, 21)
    assert linking.locate("nothing", "w x = 0", list(range(7)), False) is None
    assert linking.locate("ab?def", "abcdef", list(range(6)), False) == (0, 6, "boundary_anchored_alignment")
    assert linking.unique_context("abcabd", 0, 2) == (0, 3)
    assert linking.unique_context("aaaa", 0, 4) == (0, 4)


def test_protocol_steps():
    event = lambda **x: {"type": "progress", "name": None, "sequence": None, "bytes": 0, "phase": 0, "completed": 0, "total": 9} | x
    run = lambda *events: (lambda s: [protocol.step(s, e, 10) for e in events])(protocol.initial())
    assert run(event(), event(completed=3), event(completed=2)) == [None, None, "progress_regressed"]
    assert run(event(type="artifact", name="a", sequence=0, bytes=6), event(type="artifact", name="a", sequence=2), event()) == [None, "artifact_sequence_invalid", "after_failure"]
    assert run(event(type="artifact", name="a", sequence=0, bytes=6), event(type="artifact", name="b", sequence=0, bytes=6)) == [None, "artifact_budget_exceeded"]
    assert run(event(type="result"), event()) == [None, "event_after_terminal"]
    assert run(event(type="odd")) == ["event_type_unknown"]


def test_loci():
    from attesta.functions import locus

    latex_ = r"a \frac{x+1}{\mathbf{w}_{i}} b"
    at = latex_.index("w")
    assert latex_[slice(*locus.expanded(latex_, at, at + 1))] == r"\mathbf{w}_{i}"
    at = latex_.index("frac") + 2
    assert latex_[slice(*locus.expanded(latex_, at, at + 1))] == r"\frac{x+1}{\mathbf{w}_{i}}"
    assert locus.expanded("see $x$ now", 5, 6) == (4, 7)
    assert locus.expanded(r"\left( x \right) y", 0, 9)[1] >= len(r"\left( x \right)")
    text = r"y = x_i^2 + 1"
    assert text[slice(*locus.locus(text, 4, 6, list("xi2"), ["x", "<sub>", "i", "</sub>", "<sup>", "2", "</sup>"]))].strip() == "x_i^2"
    assert locus.locus(text, 0, 3, ["q"], ["q"]) is None
    mark = locus.marker("has ATTESTA0X in it")
    assert mark == "ATTESTA1X" and locus.with_markers("abcdef", [(0, 1), (3, 5)], mark) == f"{mark}0Zbc{mark}1Zf"


def test_mathml():
    from attesta.functions import mathml

    got = mathml.published("<math><msub><mo>max</mo><mi>x</mi></msub><mo>|</mo><mo>|</mo><mi>&amp;</mi><mtext>if $y$ holds</mtext></math>", r"\max_x")
    assert "<munder>" in got and 'rspace="0"' in got and "<mi>&amp;</mi>" not in got and "<mi>y</mi>" in got and '<annotation encoding="application/x-tex">\\max_x</annotation>' in got
    assert mathml.published("<math>", "") is None
    held, n = mathml.with_sentinels(r"a \& b")
    assert n == 1 and mathml.restored(held, 1) == "a &amp; b" and mathml.restored(held, 2) is None
    assert mathml.located("<math><mi>x</mi></math>", {"data-id": "r1"}) == '<math data-id="r1"><mi>x</mi></math>'
    assert mathml.located("<p>no</p>", {"a": "b"}) is None


def test_relations():
    from attesta.operators import relations

    top, bottom, left = glyph(1, "a", 20, 8.0), glyph(2, "b", 20, 24.0), glyph(0, "y", 0, 16.0)
    rule = {"x0": 19.5, "x1": 25.5, "y": 11.0, "width": 0.5}
    want = ["<fraction>", "<numerator>", "a", "</numerator>", "<denominator>", "b", "</denominator>", "</fraction>"]
    assert relations.expression([left, top, bottom], [rule]) == (["y", *want], None)
    assert relations.expression([top], [rule]) == (None, "source_fraction_rule_ambiguous")
    assert relations.expression([top, bottom], [rule | {"x0": 23.0}])[1] == "source_fraction_rule_too_short"
    root = glyph(0, "√", 0)
    under = {"x0": 5.0, "x1": 11.5, "y": 0.0, "width": 0.5}
    assert relations.expression([root, glyph(1, "x", 6), glyph(2, "y", 20)], [under]) == (["√", "<radicand>", "x", "</radicand>", "y"], None)
    assert relations.expression([root, glyph(1, "x", 6)], [])[1] == "source_radical_rule_missing"
    total = glyph(0, "∑", 0, name="summationdisplay")
    assert relations.expression([total, glyph(1, "i", 0, 17.0, 6.0), glyph(2, "n", 0, -1.0, 6.0), glyph(3, "x", 10)], []) == (["∑", "<sub>", "i", "</sub>", "<sup>", "n", "</sup>", "x"], None)


def test_long_numbers_are_no_amounts_of_their_own():
    from attesta.functions import dollars

    assert dollars.delimiters("x" + "7" * 70 + "$ y") == [71]  # letters before the digits: no amount, however long
    assert dollars.delimiters("7" * 70 + "$ y") == []


def test_loci_touch_their_place():
    from attesta.functions import locus

    assert all(a < 3 and b > 2 for a, b in locus.intervals("x+x", 2, 3))
    assert locus.locus("x+x", 2, 3, ["+"], ["+"]) is None


def test_places_in_whole_texts(spark):
    from pyspark.sql import functions as F

    from attesta.functions import text as X
    from attesta.operators import relational

    texts = ["", "$", "a$b", r"\$", r"\\$x\$", "$$", r"a\\\$b$", "ththth", "thx th", "x" * 50 + "th"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.escaped_places(F.col("t"), "$").alias("d"), relational.substring_places(F.col("t"), F.lit("th")).alias("p")).collect()
    for r in rows:
        t = r["t"]
        assert r["d"] == [i for i, c in enumerate(t) if c == "$" and (len(t[:i]) - len(t[:i].rstrip("\\"))) % 2 == 0], t
        assert r["p"] == [i for i in range(len(t)) if t.startswith("th", i)], t


def test_spans_are_mapped_by_sweeping(spark):
    import random

    from attesta.operators import relational

    r = random.Random(3)
    spans = [(1, i, a, a + r.randrange(1, 9)) for i, a in enumerate(r.sample(range(200), 40))] + [(2, 99, 5, 6)]
    edits = [(1, a, a + r.randrange(0, 5), r.randrange(-3, 4)) for a in r.sample(range(200), 15)]
    got = {tuple(x) for x in relational.mapped_spans(spark.createDataFrame(spans, "ref long, id long, start long, end long"), spark.createDataFrame(edits, "ref long, e_start long, e_end long, delta long"), "ref").collect()}
    want = set()
    for ref, i, a, b in spans:
        own = [e for e in edits if e[0] == ref]
        by = sum(d for _, _, z, d in own if z <= a)
        hit = any(z > a and y < b for _, y, z, _ in own)
        want.add((ref, i, None if hit else a + by, None if hit else b + by))
    assert got == want


def test_amounts_and_relations_are_read_in_linear_time():
    """They agree with plain patterns, and a long line of dollars takes no time with its square (F7)."""
    import random
    import re
    import time

    from attesta.functions import dollars

    amount = re.compile(r"(?:^|\s)(?:\d+(?:[.,]\d+)?\s*[kKmMbB]?|[kKmMbB])\Z")
    relation = re.compile(r"\A\S+\s*[<>=]\s*\S+\Z")
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice("$\\12.,kM \n\r\t=<ab٣ ") for _ in range(draw.randrange(0, 12)))
        place = draw.randrange(0, len(text) + 1)
        assert dollars._amount_before(text, place) == bool(amount.search(text[text.rfind("\n", 0, place) + 1 : place]))
        assert dollars._is_relation(text.strip()) == bool(relation.match(text.strip()))
    began = time.process_time()
    assert len(dollars.delimiters("word $ " * 20_000)) == 20_000
    assert not dollars.is_math("a b " + "=" * 50_000 + " c")
    assert time.process_time() - began < 2


def test_spans_and_balance_at_once(spark):
    from attesta.functions import dollars

    rows = spark.createDataFrame([(1, "a $x+y$ b"), (2, "$"), (3, None), (4, "$5 and $y$")], "id int, text string")
    got = {r["id"]: (r["d"]["balanced"], [s["latex"] for s in r["d"]["spans"]]) for r in rows.select("id", dollars.balanced_spans_udf("text").alias("d")).collect()}
    want = {r["id"]: (r["b"], [s["latex"] for s in r["s"]]) for r in rows.select("id", dollars.delimiters_balanced_udf("text").alias("b"), dollars.math_spans_udf("text").alias("s")).collect()}
    assert got == want


def test_alignment_equals_difflib():
    """The same blocks as difflib's, and lines that differ in one place take little time (F14)."""
    import random
    import time
    from difflib import SequenceMatcher

    draw = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(draw.choice("abc"[: draw.randrange(1, 4)]) for _ in range(draw.randrange(0, 25))) for _ in range(2))
        if draw.random() < 0.3:
            b = a[: len(a) // 2] + draw.choice("#a") + a[len(a) // 2 + draw.randrange(0, 2) :]
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert linking.aligned(a, b) == {x.b + k: x.a + k for x in blocks for k in range(x.size)}, (a, b)
    text = "".join(draw.choice("etaoin shrdlu") for _ in range(20_000))
    began = time.process_time()
    assert len(linking.aligned(text[:700] + "#" + text[701:], text)) == len(text) - 1
    assert time.process_time() - began < 2


def test_fold_equals_trying_all_groups():
    """Groups that are looked up are those that are found by trying all (F8)."""
    import random

    def slow(candidates):
        groups = []
        for new in candidates:
            met = [g for g in groups if new.joins(g)]
            if met:
                groups = [g for g in groups if not any(g is m for m in met)]
                new = layout.Region({**new.glyphs, **{s: g for m in met for s, g in m.glyphs.items()}})
            groups.append(new)
        return sorted(groups, key=lambda g: g.first)

    draw = random.Random(6)
    for _ in range(400):
        page = [glyph(i, "x", draw.randrange(0, 60), draw.choice([0.0, 5.0, 10.0, 14.0, 31.0]), draw.choice([3.0, 6.0, 10.0, 25.0]), name=draw.choice(["", "", "radicalBig"])) for i in range(30)]
        candidates = [layout.Region.of(draw.sample(page, draw.randrange(1, 4))) for _ in range(draw.randrange(0, 14))]
        assert [list(r.glyphs.items()) for r in layout.fold(candidates)] == [list(r.glyphs.items()) for r in slow(candidates)]
