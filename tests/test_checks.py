"""Goldens of the checks, and the job on a page worked out by hand."""

import gzip

from pyspark.sql import functions as F

from attesta.operators import checks, job
from attesta.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_limitations(spark):
    ok, bad, null = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    first = lambda a, b: one(spark, checks.first_limitation(checks.require_supported(a, "a"), checks.require_unambiguous(b, "b")))
    assert first(ok, ok) is None
    assert tuple(first(bad, bad)) == ("unsupported", "a")
    assert tuple(first(ok, null)) == ("ambiguous", "b")


def test_operands(spark):
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert [one(spark, checks.rendering_mode(strings(*v))) for v in ([], ["3"], ["7.0"], ["8"], ["-1"], ["2.5"], ["x"], ["1", "2"], [None])] == [None, 3, 7, None, None, None, None, None, None]
    assert one(spark, checks.rendering_mode(F.lit(None).cast("array<string>"))) is None
    assert one(spark, checks.matrix(F.array(*[F.lit(x) for x in range(6)]))) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert one(spark, checks.matrix(F.array(*[F.lit(x) for x in range(5)]))) is None


def test_extracted_math(spark):
    cases = {
        r"a \[ x \] b \(y\) c": ["x", "y"],
        "$$a\nb$$ and $c$": ["a\nb", "c"],
        r"\$5 and $6\$ + 1$": [r"6\$ + 1"],
        "$ $ none": [],
        "an open $x": [],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, checks.extracted_math(F.lit(text))) == want, text


def test_same_value(spark):
    cases = [
        ('{"a": 1, "$ref": "x"}', '{"cref": "x", "a": 1}', True), ('{"a": 1}', '{"a": 1.0}', False), ('{"a": true}', '{"a": 1}', False), ("[1, 2]", "[2, 1]", False),
        ('{"a": [{"$ref": 1}]}', '{"a": [{"cref": 1}]}', True), ("null", "null", True), ("{", "{", False), (None, None, False), ('{"a": null}', "{}", False),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", checks.same_value_udf("a", "b").alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_selection_and_anchors(spark):
    ids = lambda *v: F.array(*[F.lit(x) for x in v])
    valid = lambda s, a, n: one(spark, checks.selection_valid(s, a, F.lit(n)))
    assert valid(ids("a", "b"), ids("b", "a", "c"), 2)
    assert not valid(ids("a", "a"), ids("a", "b"), 2)
    assert not valid(ids("a"), ids("a", "a"), 1)
    assert not valid(ids("a"), ids("b"), 1)
    assert not valid(F.lit(None).cast("array<string>"), ids("b"), 0)
    assert one(spark, checks.anchors_in_order(ids("top", "page-2", "page-10"), ids(10, 2)))
    assert not one(spark, checks.anchors_in_order(ids("page-2", "page-2"), ids(2)))


def test_report_by_hand(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    pages = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 100.0, 100.0, 50.0, 0, 1), (2, 0.0, 0.0, 200.0, 100.0, 200.0, 100.0, 90, 1)], f"page long, {box}, width double, height double, rotation int, n_layers int")
    glyphs = spark.createDataFrame([(1, 1, 12.0, 10.0, 18.0, 20.0, "x"), (1, 2, 22.0, 10.0, 28.0, 20.0, " "), (1, 3, 32.0, 10.0, 38.0, 20.0, "y"), (2, 1, 12.0, 10.0, 18.0, 20.0, "x")], f"page long, id long, {box}, u string")
    regions = spark.createDataFrame(
        [(1, 1, 5.0, 5.0, 20.0, 10.0, None, ["x", "y"]), (1, 2, 5.0, 30.0, 20.0, 40.0, None, ["x"]), (1, 3, None, None, None, None, "no_box", ["x"]), (2, 1, 10.0, 10.0, 20.0, 20.0, None, ["x"]), (3, 1, 10.0, 10.0, 20.0, 20.0, None, None)],
        f"page long, id long, {box}, reason string, candidate_tokens array<string>",
    )
    got = {(r["page"], r["id"]): (r["status"], r["n_glyphs"], r["source_tokens"], r["candidate_status"], r["verdict"]) for r in job.report(pages, regions, glyphs).collect()}
    rest = ("not_evaluated", "non_verifiable")
    assert got == {
        (1, 1): ("traced", 3, ["x", "y"], "matching", "conformant_within_scope"), (1, 2): ("missing", 0, [], *rest), (1, 3): ("unsupported", 0, [], *rest),
        (2, 1): ("page_not_traced", 1, ["x"], *rest), (3, 1): ("page_not_traced", 0, [], *rest),
    }


def test_absent_glyphs(spark):
    regions = spark.createDataFrame([(1, 1, [3, 1, 9])], "page long, id long, indices array<long>")
    glyphs = spark.createDataFrame([(1, 1, "b"), (1, 3, "a")], "page long, id long, u string")
    assert [tuple(r) for r in job.looked_up(regions, glyphs).collect()] == [(1, 1, ["a", "b"], 1)]


def test_gzip_json(spark, tmp_path):
    with gzip.open(tmp_path / "rows.json.gz", "wt") as f:
        f.write('{"id": 1, "v": "a"}\n{"id": 2}\n')
    assert sorted(map(tuple, sinks.read_json(spark, str(tmp_path / "rows.json.gz"), "id long, v string").collect())) == [(1, "a"), (2, None)]


def test_refuses_to_overwrite(spark, tmp_path):
    rows = spark.range(2)
    assert sinks.captured(rows, str(tmp_path / "c"), runtime="r1")
    assert not sinks.captured(rows, str(tmp_path / "c"), runtime="r2")
    assert {r["runtime"] for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"r1"}
