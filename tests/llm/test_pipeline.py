"""Each stage of the pipeline on its own input, against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from attesta.llm import langid, neardup, quality, repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    outs = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        outs[name] = (before, docs)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = outs["language_id"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in langid.predict(before).where("lang_pred <> 'und'").select("doc_id").collect()}
    before, after = outs["quality_classifier"]
    scored = quality.score(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in scored.where("score >= 0.3").select("doc_id").collect()}
    before, after = outs["near_dedup"]
    told = neardup.classes(before, percent=80)
    assert after.count() == told.select("component_id").distinct().count()
    before, after = outs["suffix_dedup"]
    ids = [r["doc_id"] for r in before.select("doc_id").collect()]
    left = dict(zip(ids, brute_texts([given[i] for i in ids], 51), strict=True))
    for r in after.collect():
        assert r["n_chars"] == len(r["text"]) and r["text"] == left[r["doc_id"]]
    before, pieces = outs["packing"]
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_odd_and_empty(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "plain words in a row here", None, None, 25), (4, "plain words in a row here", None, None, 25), (None, "plain words without an id", "fr", "s", 25)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema=stage(spark, docs, SF).schema)
        assert (docs.count() > 0) == bool(rows)


def test_columns_of_the_input_step_aside(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id % 7 AS score", "'mine' AS lang_pred")
    for stage in (pipeline.language_id, pipeline.quality_classifier):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("score <> doc_id % 7 OR lang_pred <> 'mine'").count() == 0


def test_near_copies_of_a_similarity_of_080_go(spark):
    r = random.Random(11)
    rows = []
    for i, n in enumerate(range(49, 66)):  # one word in the middle differs: a similarity of 0.80 to 0.85
        words = [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:20], "other", *words[21:]]))]
    rows += [(100, " ".join(f"x{k}" for k in range(40))), (101, " ".join("other" if k == 20 else f"x{k}" for k in range(40)))]  # 0.76
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x[0] for x in pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()) == [*range(0, 34, 2), 100, 101]


def brute_texts(texts, words):
    """Texts without each string of so many words that stands at two places."""
    units = [[m.span() for m in re.finditer(r"[\u3000-\U0010ffff]|[^ \t-\r\u3000-\U0010ffff]+", t)] for t in texts]
    windows = [[(u[i][0], u[i + words - 1][1]) for i in range(len(u) - words + 1)] for u in units]
    windows = [[(len(t[:a].encode()), len(t[:b].encode())) for a, b in w] for t, w in zip(texts, windows, strict=True)]
    texts = [t.encode() for t in texts]
    seen = Counter(x for t, w in zip(texts, windows, strict=True) for x in [t[a:b] for a, b in set(w)])
    out = []
    for t, w in zip(texts, windows, strict=True):
        gone = {i for a, b in w if seen[t[a:b]] > 1 for i in range(a, b)}
        out.append(bytes(c for i, c in enumerate(t) if i not in gone).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("regions", [512, 2])
def test_passages_of_51_words_go(spark, monkeypatch, regions):
    monkeypatch.setattr(repeats, "TASK_REGIONS", regions)  # 2: anchors dealt to several tasks
    r = random.Random(12)
    some = lambda n, letters: " ".join(r.choice(letters) + r.choice(letters) for _ in range(n))
    short, fifty, long = some(51, "abcdefgh"), some(50, "abcdefgh"), some(140, "abcdéfgh")
    asian = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(51))
    texts = [f"{some(r.randrange(40), 'stuvwxyz')}\n{r.choice([short, fifty, long, asian, long[:200]])} {some(r.randrange(30), 'ijklmnop')}  {r.choice(['', short, fifty, asian])}" for _ in range(40)]
    texts += [f"one {short} end", f"two {short}x", f"{asian}y", "a " * 200, "short copy", "short copy", *[f"{x} {'0123456789' * 3}{'q' * 500}" for x in "kl"], some(60, "qrst") + " é", ""]
    rows = [(None if i % 9 == 8 else i, t, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert len(short.encode()) < 400 and brute_texts(texts, 51)[40] == "one  end"
    got = pipeline.suffix_dedup(spark, docs, SF).collect()
    assert sorted(x["text"] for x in got) == sorted(brute_texts(texts, 51)) and all(x["n_chars"] == len(x["text"]) for x in got)
