"""The operators against brute force, round trips and held-out accuracy; odd rows of every kind."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import bpe, common, components, langid, licenses, media, neardup, packing, quality, queries, repeats, shards, sketch, suffixes, topk

SF = "/root/testdata/sf0.001"
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
LONG = " ".join(f"wort{i * i % 977}" for i in range(9000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Null, empty, blank, short, long, repeated rows, a null id, repeated ids with different texts; extra columns with names that clash.
ODD = [
    (1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "one two three"), (6, LONG), (7, LONG), (7, LONG), (8, "one two three"), (None, "no id here"), (None, None), (9, "x" * 3000),
    (10, "Released under the MIT License. " * 3), (11, "ünïcödé 漢字 \U0001f600 'll don't 12³"), (12, LONG + " tail"), (13, "other text"), (13, "the same id twice"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 1, 0.5, "node", "key") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, score double, node string, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# 1. BPE


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab '\n\tstrellvd1.-é漢²　\x00")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_tiktoken(text):
    assert next(bpe.encode_texts([text], RANKS)).tolist() == EXACT.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80))
def test_join_is_the_encoding_of_the_whole(a, b):
    e = bpe.encoder(RANKS)
    assert e.join(e.ids(a), e.ids(b)) == e.direct(a + b) if a and b else True


def test_bpe_long_words_and_tree():
    for text in ("a" * 20_000, "ab" * 5000, "".join(random.Random(1).choice("abcdefgh") for _ in range(8000)), " " * 999 + "x"):
        ids = next(bpe.encode_texts([text], RANKS)).tolist()
        assert ids == EXACT.encode_ordinary(text)
        assert bpe.decode(ids, bpe._tokens(RANKS)) == text.encode()


def thue_morse(bits, letters="ab"):
    """Words of 2 ** bits letters that collide, with their mirror, under a polynomial hash modulo 2 ** 64."""
    return "".join(letters[i.bit_count() % 2] for i in range(1 << bits))


def test_bpe_keeps_words_apart():
    one = thue_morse(11)
    texts = [one, thue_morse(11, "ba"), one]
    assert [x.tolist() for x in bpe.encode_texts(texts, RANKS)] == [EXACT.encode_ordinary(t) for t in texts]


def test_bpe_rows(odd, empty):
    want = []
    for i, t in ODD:
        ids = EXACT.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert table(bpe.encode_and_decode(odd, RANKS)) == sorted(want, key=repr)
    assert bpe.encode_and_decode(empty, RANKS).count() == 0


# 2. Licenses


def base_places(text):
    lowered = (text or "").translate(str.maketrans(licenses._UPPER, licenses._LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, odd, empty, docs):
    for frame in (odd, docs):
        rows = frame.select("doc_id", "text").collect()
        assert table(licenses.scan(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted([(r[0], *base_places(r[1])) for r in rows], key=repr)
    assert licenses.scan(empty).count() == 0
    mit = licenses.TEMPLATES[0][0]
    changed = mit.replace("free of charge", "completely free of charge").split()
    rows = [(1, "intro " + mit.title() + " more"), (2, " ".join(changed)), (3, " ".join(mit.split()[:8])), (4, "Under the MIT License under-the mit license")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["score"]) == ("mit", "", 1.0)
    assert got[2]["labels"] == "mit" and licenses.COVERED <= got[2]["score"] < 1  # a word put in: two diagonals merge
    assert (got[3]["labels"], got[3]["score"]) == ("", 0.0)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 4)


def test_license_spans_dont_drift(spark):
    runs = lambda t: [t.split()[i : i + 3] for i in range(len(t.split()) - 2)]
    bsd, whole = licenses.TEMPLATES[3][0], licenses.TEMPLATES[-1][0]
    # All runs of a template laid end to end: each hits, and each diagonal is two words from the last.
    scattered = " ".join(w for r in runs(bsd) for w in r)
    late = bsd.replace("source", "source (or x y) ")
    worn = whole.replace("must retain", "should keep").replace("must reproduce", "should print")
    rows = [(1, scattered), (2, late), (3, "A. " + worn.upper() + "."), (4, bsd + " " + bsd), (5, " ".join(reversed(whole.split())))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("", 0.0) and got[5] == ("", 0.0) and got[4] == ("bsd", 1.0)
    assert got[2][0] == "bsd" and licenses.COVERED <= got[2][1] < 1
    assert got[3] == ("bsd", 1.0)  # its opening words are whole, the rest is near enough
    only = {r["doc_id"]: r["score"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=licenses.TEMPLATES[-1:]).collect()}
    assert licenses.COVERED <= only[3] < 1


def test_license_templates_find_themselves(spark):
    rows = [(i, "x " + t.title() + " y") for i, (t, _) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, (_, label) in enumerate(licenses.TEMPLATES))


# 3. Near duplicates


def brute_classes(rows, percent=85):
    sets = []
    for _, t in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i)), key=lambda x: (x is None, x))
        out.append((d, len(sets[i]), low, d == low))
    return sorted(out, key=repr)


def family(seed, n, words, edits):
    """Texts that differ from one base in a few words."""
    r = random.Random(seed)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = "edit" + str(r.randrange(10**6))
        out.append(" ".join(copy))
    return out


def test_near_duplicates(spark, odd, empty, monkeypatch):
    assert table(neardup.classes(odd)) == brute_classes(ODD)
    assert neardup.classes(empty).count() == 0
    texts = family(1, 60, 200, 8) + family(2, 40, 60, 3) + family(3, 5, 400, 2) * 2
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "CHUNK_NODES", 7)  # buckets of several chunks
    assert table(neardup.classes(frame)) == brute_classes(rows)
    kept = {r[0] for r in neardup.classes(frame).where("kept").collect()}
    assert {r["doc_id"] for r in neardup.deduplicated(frame).collect()} == kept
    left = neardup.deduplicated(odd)
    assert left.columns == odd.columns and Counter(r["doc_id"] for r in left.collect())[7] == 0  # 7 repeats 6
    a, b, c = ("one two three four five six", "ONE two  three four five six", "seven eight nine ten eleven twelve")
    rows = [(1, a), (5, b), (5, c), (5, c), (8, c), (None, a), (None, a), (9, None), (9, None)]
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(left) == sorted([(1, a), (5, c), (None, a), (None, a), (9, None)], key=repr)


def test_near_duplicates_keep_words_apart(spark):
    one, two = thue_morse(11), thue_morse(11, "ba")
    rows = [(1, f"a b c d {one}"), (2, f"a b c d {two}"), (3, f"A b c d {one}")]
    assert table(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)


def test_sketch_is_concentrated():
    r = np.random.default_rng(5)
    for n, share in ((40, 0.5), (1000, 0.85), (5000, 0.3)):
        common = r.integers(0, 2**63, int(n * share), np.uint64)
        a, b = [np.unique(np.concatenate((common, r.integers(0, 2**63, n - len(common), np.uint64)))) for _ in range(2)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sketch.sketch(a) == sketch.sketch(b)).mean() - true) < 5 * (0.25 / sketch.BINS) ** 0.5
    assert (sketch.sketch(np.array([7], np.uint64)) < np.iinfo(np.uint64).max).all()  # one element fills every bin


def test_sketches_of_neighbouring_sizes_agree():
    r = np.random.default_rng(6)
    for n in range(1, 41):
        pairs = [np.unique(r.integers(0, 2**63, n + 1, np.uint64)) for _ in range(20)]
        values = [(sketch.sketch(np.delete(x, r.integers(n + 1))), sketch.sketch(x)) for x in pairs]
        assert abs(np.mean([a == b for a, b in values]) - n / (n + 1)) < 6 * (0.25 / sketch.BINS / 20) ** 0.5, n
        assert all(neardup.linked(x[:-1], x) == (100 * n >= 85 * (n + 1)) for x in pairs)
        if 100 * n >= 85 * (n + 1):
            assert all((sketch.band_keys(a) == sketch.band_keys(b)).any() for a, b in values), n


def test_short_near_duplicates(spark):
    r = random.Random(7)
    texts = []
    for n in range(1, 41):
        for _ in range(8):
            words = [f"w{r.randrange(10**9)}" for _ in range(n + 5)]
            texts += [" ".join(words[:-1]), " ".join(words)]
    rows = list(enumerate(texts))
    assert table(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), ("c", "a"), (None, "q")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = dict(components.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert got["c"] == "a" and got["y"] == "x" and got["n040"] == "n000" and got["z"] == "z" and "q" not in got


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_grow_by_new_edges_alone(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)  # 0: all is shuffled
    frame = lambda edges: common.materialise(spark.createDataFrame(edges, "a string, b string"))
    draw = random.Random(4)
    old, new = ([(f"n{draw.randrange(60):02}", f"n{draw.randrange(60):02}") for _ in range(25)] for _ in range(2))
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(0, 60, 2)], [(f"c{i:02}", f"c{i + 1:02}") for i in range(1, 60, 2)]
    got = components.merged(components.components(frame(old + chain[0])), frame(new + chain[1]))
    want = components.components(frame(old + new + chain[0] + chain[1]))
    kept = lambda df: sorted((n, m) for n, m in df.collect() if n != m)  # noqa: E731  a loop alone is a component of one
    assert kept(got) == kept(want) and dict(got.collect())["c60"] == "c00"


def test_few_rows_stay_in_few_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame([(f"n{i}", f"m{i}") for i in range(300)], "a string, b string"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.count() == 600 and len(found.inputFiles()) <= common.FEW_PARTS


# 4. Repeats


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 97, 98, 255]), max_size=120))
def test_suffix_order(values):
    data = bytes(values)
    assert suffixes.suffix_order(np.frombuffer(data, np.uint8), 400).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def brute_removals(rows, length):
    seen = Counter((t or "").encode()[i : i + length] for _, t in rows for i in range(len((t or "").encode()) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = 1
        runs = int((np.diff(np.concatenate(([0], cover))) == 1).sum())
        kept = bytes(c for c, hit in zip(b, cover, strict=False) if not hit)
        at, text = 0, []
        for c in t or "":
            size = len(c.encode())
            text += [] if cover[at : at + size].any() else [c]
            at += size
        out.append((d, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest(), "".join(text)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("regions", [512, 2])
def test_repeats(spark, odd, empty, monkeypatch, regions):
    monkeypatch.setattr(repeats, "TASK_REGIONS", regions)  # 2: anchors dealt to several tasks
    assert table(repeats.removals(odd)) == brute_removals(ODD, 400)
    r = random.Random(3)
    passages = ["".join(r.choice("abcde é") for _ in range(n)) for n in (390, 401, 700, 1200)]
    rows = [(i, "".join(r.choice("fghij ") for _ in range(r.randrange(600))) + r.choice(passages) + "".join(r.choice("klmno ") for _ in range(r.randrange(300))) + r.choice(["", r.choice(passages)])) for i in range(40)]
    rows += [(40, "z" * 2000), (41, "ab" * 500), (42, "z" * 399), (43, thue_morse(11)), (44, thue_morse(11, "ba")), (45, "é" * 450)]
    assert table(repeats.removals(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_removals(rows, 400)
    assert repeats.removals(empty).count() == 0


@pytest.mark.parametrize("regions", [512, 2])
def test_repeats_in_periodic_texts(spark, monkeypatch, regions):
    monkeypatch.setattr(repeats, "TASK_REGIONS", regions)
    r = random.Random(8)
    letters = "".join(r.choice("abcdefgh") for _ in range(200))
    some = lambda n: "".join(r.choice("ijklmnop") for _ in range(n))
    rows = []
    for period in (1, 2, 7, 63, 64, 65, 130):
        for n in (380, 400, 401, 399 + period, 400 + period, 401 + period, 650, 1500):
            rows.append((len(rows), some(r.randrange(300)) + (letters[:period] * 1500)[r.randrange(period) :][:n] + some(r.randrange(500))))
    for _ in range(6):
        rows.append((len(rows), "q" * r.randrange(390, 600) + some(5) + "q" * r.randrange(300, 900) + letters[:9] * r.randrange(40, 90)))
    assert table(repeats.removals(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_removals(rows, 400)
    for long in (b" " * 10_000_000, b"ab" * 2_000_000):
        hashes, _, lo, hi, whole = repeats.anchors_of(long, 400, None)
        assert int((hi - lo).sum()) < 200_000 and len(hashes) < 500 and whole
    blanks = repeats.anchors_of(b"one two " * 100_000, 400, 51)
    assert int((blanks[3] - blanks[2]).sum()) < 200_000


def brute_without_repeated_words(texts, n):
    words = [[(m.start(), m.end()) for m in re.finditer("[^\\t-\\r ]+", t)] for t in texts]
    windows = [[(w[i][0], w[i + n - 1][1]) for i in range(len(w) - n + 1)] for w in words]
    seen = Counter(t[a:b] for t, found in zip(texts, windows, strict=True) for a, b in found)
    out = []
    for t, found in zip(texts, windows, strict=True):
        cut = {i for a, b in found if seen[t[a:b]] > 1 for i in range(a, b)}
        out.append("".join(c for i, c in enumerate(t) if i not in cut))
    return sorted(out)


@pytest.mark.parametrize(("words", "block"), [(None, 16), (51, 16), (12, 1000)])
def test_repeats_of_a_frequent_passage(spark, monkeypatch, words, block):
    """Anchors with many regions: those of one passage, whole and cut short, in many texts; few and many windows of a core."""
    monkeypatch.setattr(repeats, "TASK_REGIONS", 4)
    monkeypatch.setattr(repeats, "BLOCK", block)
    r = random.Random(6)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(n))
    passage = some(130)
    texts = []
    for _ in range(70):
        a, z = (0, len(passage)) if r.random() < 0.5 else sorted(r.choices(range(len(passage)), k=2))
        texts.append(f"{some(r.randrange(60))} {passage[a:z]} {some(r.randrange(60))}")
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if words:
        got = sorted(x["text"] for x in repeats.without_repeats(frame, words=words).collect())
        assert got == brute_without_repeated_words(texts, words) and got != sorted(texts)
    else:
        assert table(repeats.removals(frame)) == brute_removals(rows, 400)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_repeats_of_rows_without_an_id(spark, monkeypatch, broadcast):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    r = random.Random(4)
    shared, own = ["".join(r.choice("abcde ") for _ in range(500)) for _ in range(2)]
    rows = [(None, "one " + shared), (None, "two " + own + " end"), (None, own), (1, shared + " with an id"), (2, "no repeat " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(repeats.removals(frame)) == brute_removals(rows, 400)
    left = repeats.without_repeats(frame).collect()
    assert sorted(x["text"] for x in left) == sorted(["one ", "two  end", "", " with an id", "no repeat " * 30])


def test_texts_without_repeats(odd):
    got = repeats.without_repeats(odd, count_col="n")
    assert got.columns == odd.columns and got.count() == len(ODD)
    for r in got.collect():
        assert r["text"] is None or r["n"] == len(r["text"])
    assert {r["text"] for r in got.where("doc_id IN (6, 7)").collect()} == {""}


# 5. Packing


def test_packing(spark, odd, empty, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, None)], "doc_id long, text string")
    for frame in (docs, special, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in frame.select("doc_id", "text").collect()}
        pieces = packing.pack(frame, TOKENIZER, with_ids=True).collect()
        for doc_id, ids in texts.items():
            own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
            assert [x for p in own for x in p["ids"]] == ids and {p["doc_tokens"] for p in own} == {len(ids)}
        by = {}
        for p in pieces:
            by.setdefault(p["sequence_id"], []).append(p)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(p['ids'])}I", *p["ids"])) and p["length"] == len(p["ids"])
        for parts in by.values():
            at = 0
            for p in sorted(parts, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at & (at - 1) == 0 and at <= packing.WINDOW  # full, or a power of two: no padding
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert packing.pack(odd, TOKENIZER).groupBy().sum("length").first()[0] == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)


def test_words_are_encoded_many_at_a_time(monkeypatch):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    r = np.random.default_rng(12)
    letters = np.array(list("abcé漢 1\0!'"))
    texts = ["".join(r.choice(letters, 300)) for _ in range(30)] + ["", "\0", "\0\0 \0a", "it's\0"]
    for some in (texts, [t.replace("\0", "") for t in texts]):
        assert [x.tolist() for x in packing.token_ids(some, TOKENIZER)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    # A call of the library takes all new words of a step, and known words are not encoded again.
    calls, encode = [], packing._library(TOKENIZER)
    monkeypatch.setattr(bpe, "_kept", lambda path, kept=bpe.Kept(): kept)
    told = lambda words: calls.append(len(words)) or encode(words)
    assert [x.tolist() for _ in range(2) for x in bpe.encode_texts(texts, TOKENIZER, told)] == 2 * [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and calls[0] > 100


@pytest.mark.parametrize("hashes", [1, 7, 1 << 40])
def test_kept_words(monkeypatch, hashes):
    real = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: real(*a) % np.uint64(hashes))  # few hashes: most words collide
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3000)
    encode = lambda words: (np.frombuffer(b"".join(words), np.uint8).astype(np.int32), np.array([len(w) for w in words]))
    kept, r = bpe.Kept(), np.random.default_rng(3)
    for step in range(30):  # the store is emptied in between; one step has more words than are kept by itself
        drawn = r.integers(0, 4000, 200).tolist() if step != 25 or hashes < 100 else range(3200)
        words = sorted({b"w%d" % x for x in drawn})
        room, size = kept.hashes.room, kept.hashes.size
        at = kept.find(pa.array(words, pa.large_binary()), encode)
        ends = kept.id_ends.held
        assert len(set(at.tolist())) == len(words) and [bytes(kept.ids.held[ends[i] : ends[i + 1]].astype(np.uint8)) for i in at.tolist()] == words
        # A step leaves what is kept where it is, but when it needs more room.
        assert kept.hashes.room is room or kept.hashes.size > len(room) or kept.hashes.size < size or len(words) > 3000


def test_neighbours_share_terms():
    r = np.random.default_rng(9)
    many = [r.integers(0, 5000, r.integers(1, 400)) for _ in range(60)]
    index, size = packing.Index(many), np.mean([len(x) for x in many])
    for i in range(0, 60, 7):
        for j in range(60):
            want = 0.0
            for t in set(many[i].tolist()) & set(many[j].tolist()) if i != j else ():
                df, tf = sum(t in x for x in many), int((many[j] == t).sum())
                want += np.log1p((60 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(many[j]) / size))
            assert abs(index.scores[i, j] - want) < 1e-2
    items = [np.array(x) for x in ([5, 6, 7, 8], [9, 10, 11], [5, 6, 12], [9, 13])]
    index = packing.Index(items)
    assert index.neighbours(0).tolist() == [2] and index.neighbours(1).tolist() == [3]
    windows = list(packing.Packer(8).shard(list(enumerate(items))))
    assert {p[0] for p in windows[0]} == {0, 2, 1} or {p[0] for p in windows[0]} == {0, 2}


def test_routes_bring_families_together(spark):
    r = np.random.default_rng(4)
    common = "the a of and to in is are was for".split()
    own = lambda: [common[x % 10] if x % 7 == 0 else f"w{x}" for x in r.integers(0, 4000, 60)]
    texts = []
    for _ in range(60):
        # A family: one text with two words changed in each, so two of them share more than half of their runs; all texts hold common words.
        base = own()
        for _ in range(5):
            member = list(base)
            for at in r.integers(0, 60, 2).tolist():
                member[at] = "changed"
            texts.append(member)
    texts += [own() for _ in range(700)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(-1, None), (-2, ""), (-3, "one"), (-4, "one two"), (-5, "one two three")]
    got = {x["doc_id"]: (x["route"], x["common"], x["second"]) for x in packing.routed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[-1] == (None, None, None) and len({got[-k] for k in range(2, 6)}) == 4
    sizes = {}
    for route, _, _ in got.values():
        sizes[route] = sizes.get(route, 0) + 1
    assert max(sizes.values()) <= 5  # no route beyond a family
    order = {doc: at for at, doc in enumerate(sorted((d for d in got if d >= 0), key=lambda d: (got[d][1], got[d][0], got[d][2])))}
    near = [min(abs(order[d] - order[e]) for e in range(f, f + 5) if e != d) for f in range(0, 300, 5) for d in range(f, f + 5)]
    assert sum(x <= 4 for x in near) / len(near) > 0.75  # by chance: about 0.03


# 6. Languages


def test_language_accuracy(odd, empty, docs, spark):
    known = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs.select("doc_id", "text"), docs).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(known[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    told = langid.predict(odd, docs)
    assert told.columns == [*[c for c in odd.columns if c != "score"], "held_out", "lang_pred", "score"]
    assert {(r["text"], r["lang_pred"]) for r in told.collect() if not re.search(r"[^\W\d_]", r["text"] or "")} == {(None, "und"), ("", "und"), ("   \n", "und")}
    assert langid.predict(empty).count() == 0 and {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


def test_code_lengths_are_of_distributions():
    grams, counts = np.unique(langid._grams(b"the theme of the thesis " * 40), return_counts=True)
    model = langid.Model(grams.astype(np.uint32), counts[:, None].astype(np.int32))
    assert np.allclose(np.exp2(-model.bits.reshape(-1, 256).astype(np.float64)).sum(1), 1, atol=1e-4)
    assert model.lengths([b"the theme"])[0, 0] < model.lengths([b"qzx kjvw "])[0, 0]
    assert model.lengths([b"", b"ab", b""])[[0, 2]].sum() == 0


# 7. Media


def test_decoders():
    r = np.random.default_rng(1)
    rgb = r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_ppm(rgb)) == rgb).all()
    assert (media.decode(b"P5 # note\n7 5\n255\n" + rgb[:, :, 0].tobytes())[:, :, 0] == rgb[:, :, 0]).all()
    assert (media.decode(b"P3\n7 5\n255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert media.decode(b"P1\n3 1\n1 0 1\n")[:, :, 0].tolist() == [[0, 1, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000]))[:, :, 0].tolist() == [[0, 1, 0]]
    rows = b"".join(row[:, ::-1].tobytes() + b"\0" * (-21 % 4) for row in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == rgb).all()
    whole = media.integral_image(rgb)
    assert np.allclose(media.area_resize(whole, 1, 1)[0, 0], rgb.mean((0, 1))) and np.allclose(media.area_resize(whole, 5, 7), rgb)
    assert np.load(io.BytesIO(media.npy_tile(whole, 5))).shape == (5, 5, 3)


def test_media_rows(spark, odd, empty):
    got = table(media.text_media(odd).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for i, t in ODD:
        b = (t or "").encode()
        payload = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((i, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert got == sorted(want, key=repr) and media.text_media(empty).count() == 0
    images = spark.createDataFrame([(1, bytearray(media.store_text("hello")[0]), "x"), (2, bytearray(b"junk"), "y"), (3, None, None)], "id long, media binary, error string")
    rows = {r["id"]: r for r in media.media_columns(images).collect()}
    assert (rows[1]["height"], rows[1]["width"], rows[1]["error"]) == (1, 64, None) and rows[2]["error"] and rows[3]["tile"] is None
    assert media.media_columns(images.limit(0)).count() == 0
    hostile = [b"P5 99999999999999 99999999999999 255\n", b"P4 4000000000 4000000000\n", b"P6 0 0 255\n", b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0), b"P5 5", b"P2 2 1 255\n1 x"]
    rows = media.media_columns(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(hostile)], "id long, media binary")).collect()
    assert len(rows) == len(hostile) and all(r["error"] and r["tile"] is None for r in rows)


# 8. Quality


def test_quality(spark, odd, empty):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.score(docs.select("doc_id", "text"), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in marked]
    assert sum(r["predicted"] == marked[r["doc_id"]] for r in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    told = quality.score(odd, labels, docs)
    assert told.count() == len(ODD) and told.columns == [*[c for c in odd.columns if c != "score"], "held_out", "score", "predicted"]
    assert quality.score(empty, labels).count() == 0 and quality.score(odd, labels.limit(0)).count() == len(ODD)


# 9. Sharding


def test_shards(odd, empty, docs, spark, tmp_path):
    for frame, bucket in ((odd, 20_000), (docs, 2)):
        rows = shards.assign_shards(frame, bucket_rows=bucket).collect()
        table_of_docs = sorted(map(tuple, rows), key=repr)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in frame.select("doc_id", "text").collect())
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert rows and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, shards.assign_shards(frame.repartition(2), bucket_rows=bucket).collect()), key=repr)  # whatever the partitions
    assert shards.assign_shards(empty).count() == 0
    grown = {(r["doc_id"], r["grown_shard"]) for r in shards.assign_shards(docs).collect()}
    assert grown == {(r["doc_id"], r["shard"]) for r in shards.assign_shards(docs, shards=41).collect()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert table(shards.assign_shards(docs.repartition(3), bucket_rows=2)) == table_of_docs  # whatever the session's partitions
    spark.conf.set("spark.sql.shuffle.partitions", was)
    shards.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = shards.read_shards(spark, str(tmp_path / "out"), docs.schema.simpleString())
    assert Counter(r["record"] for r in back.collect()) == Counter(docs.collect())
    assert {(r["record"]["doc_id"], r["slot"]) for r in back.collect()} == {(r["doc_id"], r["slot"]) for r in shards.assign_shards(docs, shards=4).collect()}
    same = spark.createDataFrame([(1, "again")] * 300 + [(2, "other")] * 20, "doc_id long, text string").repartition(4)
    rows = shards.assign_shards(same, shards=3, bucket_rows=10).collect()
    assert len(rows) == 320 and len({(r["shard"], r["slot"]) for r in rows}) == 320 and max(r["slot"] for r in rows) >= 299


# 10. Top-k


@pytest.mark.parametrize("block", [2048, 40])
def test_top_k(spark, block):
    r = np.random.default_rng(2)
    vectors = [(i, (r.normal(size=6) * r.exponential()).tolist(), "x") for i in range(160)] + [(500, None, "x"), (501, [1.0, None, 1.0], "x"), (502, [float("nan")] * 6, "x"), (None, [9.0] * 6, "x"), (503, [0.0] * 6, "x"), (504, [0.0] * 6, "x"), (505, [5.0], "x"), (7, [9.0] * 6, "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    good = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v))) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, q in good:
        if qi % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), ci) for ci, c in good if ci != qi)[:5]
            want += [(qi, k + 1, ci, -s) for k, (s, ci) in enumerate(best)]
    assert table(topk.top_k(frame, block=block)) == sorted(want, key=repr)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id IN (0, 1, 2)"), block=block).count() == 2


def test_top_k_of_huge_components(spark):
    vectors = [(0, [1e18, 1.0]), (1, [1e18, 1.0]), (2, [1e12, 2.0]), (3, [-1e18, 5.0]), (4, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    whole = {i: [min(int(np.floor(256 * x)), 2**63 - 1) if x > 0 else max(int(np.floor(256 * x)), -(2**63)) for x in v] for i, v in vectors}
    want = sorted((-min(max(sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), -(2**63)), 2**63 - 1), i) for i in (1, 2, 3, 4))
    assert [(r["vec_id"], -r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, s) for s, i in want]


def test_queries_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 11)]


def test_quality_takes_one_text_of_an_id(spark):
    draw = random.Random(2)
    made = [(i, " ".join(draw.choice(WORDS if i % 2 else WORDS[:4]) for _ in range(40))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in made], "doc_id long, quality int")
    docs = spark.createDataFrame(made, "doc_id long, text string")
    once = quality.train(docs, labels)
    assert once[0] and quality.train(docs.unionAll(docs.where("doc_id = 7").crossJoin(spark.range(3000)).drop("id")), labels) == once


def test_shards_of_groups_with_many_bytes(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 1000)
    frame = spark.createDataFrame([(1, "x" * 100)] * 60 + [(i, "y") for i in range(2, 40)], "doc_id long, text string").repartition(3)
    told = table(shards.assign_shards(frame, shards=2))
    assert len(told) == 98
    monkeypatch.setattr(shards, "HOT_KEYS", 0)  # groups aren't broadcast
    assert table(shards.assign_shards(frame, shards=2)) == told
