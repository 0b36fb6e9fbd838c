"""Texts that rows hold against the operators over rows of their characters (F8 to F12, F15)."""

import random

import pytest

from attesta.operators import held
from attesta.plans import catalog

NAMES = ["d06_ordered_digest", "e08_reading_order", "e09_dense_positions", "e01_e02_glyph_runs", "d10_indicator_lines", "k01_k07_detected_regions"]


def texts():
    draw = random.Random(4)
    some = ["", None, " ", "   ", "a", "ab", "ba", "a b", " ab ", "é+é", "漢字 9\n=", "😀" * 81, "x" * 80, "1" * 161, "\n\n", "a b", "ſß0٣", "zz\x00y"]
    return some + ["".join(draw.choice("abA1 \n+é漢😀=.(]É") for _ in range(draw.randrange(1, 400))) for _ in range(40)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """One table of ids that stand once, one with an id twice and another of null."""
    once = [(i, t) for i, t in enumerate(texts())]
    twice = [(i if i else None, t) for i, t in once] + [(3, None), (5, "+ab"), (None, "q=1")]
    out = []
    for name, rows in (("once", once), ("twice", twice)):
        folder = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(folder / "documents.parquet"))
        out.append(str(folder))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_held_equals_spread(spark, folders, name, monkeypatch):
    monkeypatch.setattr(held, "BLOCK", 500)
    got = [sorted(map(str, catalog.QUERIES[name](spark, f).collect())) for f in folders]
    monkeypatch.setattr(held, "by_text", lambda docs, in_rows, spread: spread(docs))
    assert got == [sorted(map(str, catalog.QUERIES[name](spark, f).collect())) for f in folders]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_shuffled(spark, folders, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, folders[0])._jdf.queryExecution().executedPlan().toString()
