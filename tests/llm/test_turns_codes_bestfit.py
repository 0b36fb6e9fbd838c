"""Conversation repair, vector codes and best-fit packing against brute force and SQL; odd rows of every kind."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import bestfit, codes, queries, turns

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def from_sql(name, **tables):
    c = duckdb.connect()
    for table, source in tables.items():
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{source}'")
    got = c.sql(queries.ORACLES[name])
    return got.columns, sorted(got.fetchall(), key=repr)


# 11. Conversations


def slow_repair(told):
    """Shortest paths over turns read and the last role, one edit after the other, by cost and then by audit."""
    heap, settled = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in settled:
            continue
        settled.add((i, q))
        if (i, q) == (len(told), "end"):
            return cost, audit
        if i == len(told) and q in ("", "a"):
            heapq.heappush(heap, (cost, audit, i, "end"))
        follows = [r for r in "sua" if (q == "" and r in "su") or q + r in turns.LEGAL]
        if i < len(told):
            initial, fault = told[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault not in (turns.BLANK, turns.DUPLICATE):
                for role in follows:
                    if role == initial or role != "s":
                        heapq.heappush(heap, (cost + (role != initial) * 2 + (fault == turns.CUT), audit + ("K" if role == initial else "R"), i + 1, role))
        for role in follows:
            if role != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, role))


told = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([turns.NO_FAULT] * 4 + [turns.BLANK, turns.DUPLICATE, turns.CUT])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(told)
def test_repair_is_cheapest_and_least(some):
    assert turns.repair(some) == slow_repair(some)


def repair_by_rows(rows):
    """The contract, row by row."""
    convs, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, some = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            some.append((role[:1], turns.BLANK if not bare else turns.DUPLICATE if (role, text) in seen else turns.CUT if bare[-1] not in ".!?" else turns.NO_FAULT))
            seen.add((role, text))
        cost, audit = slow_repair(some)
        lines, at, last = [], 0, ""
        for letter in audit:
            follows = turns.NEXT[last]
            if letter == "I":
                lines.append(f"{follows}:")
            else:
                _, role, text = kept[at]
                at += 1
                if letter == "D":
                    continue
                follows = role if letter == "K" else follows
                lines.append(f"{follows}:{text}")
            last = follows[0]
        have = [t for t, _, _ in kept if t is not None]
        initials = [i for i, _ in some]
        counts = Counter(f for _, f in some)
        out.append((
            conv, max(have) - min(have) + 1 - len(set(have)) if have else 0, counts[turns.BLANK], counts[turns.DUPLICATE], counts[turns.CUT],
            sum(a + b not in turns.LEGAL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations():
    draw = random.Random(5)
    texts = ["Yes.", "Yes.", "What?", "no end", "", " \t", None, "Fine! ", "ünï 漢字.", "x" * 5000]
    rows = [(c, t, draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]), draw.choice(texts)) for c in range(60) for t in range(draw.randrange(1, 9))]
    rows += [(None, None, None, None), (None, 3, "user", "No id."), (None, 3, "user", "No id."), (7, None, "assistant", "No turn."), (7, 2, "user", "Same turn."), (7, 2, "user", "Same turn."), (8, -5, "user", "Far.")]
    rows += [(99, t, "user" if t % 2 else "assistant", f"Line {t % 37}{'.' if t % 11 else ''}") for t in range(400)]
    return rows


@pytest.mark.parametrize("bits,chunk", [(10, 1 << 20), (2, 64), (0, 1)])
def test_turns_by_blocks_of_any_size(spark, monkeypatch, bits, chunk):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    monkeypatch.setattr(turns, "CHUNK_BYTES", chunk)
    rows = conversations()
    frame = spark.createDataFrame([(*r, "own", 5) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int").repartition(3)
    assert rows_of(turns.repaired(frame)[0]) == repair_by_rows(rows)


def test_turns_all_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert rows_of(turns.repaired(frame)[0]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert turns.repaired(frame.limit(0))[0].count() == 0
    assert turns.repaired(frame, damage=False)[0].first()["audit"] == "KI"


def test_turns_sql(spark, tmp_path):
    frame = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "c"))
    names, want = from_sql("op11_turns", conversations=f"{tmp_path}/c/*.parquet")
    assert rows_of(turns.repaired(frame)[0].select(*names)) == want


# 12. Codes


def slow_codes(rows):
    import math

    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    longest = max((len(v) for _, _, v in kept), default=0)
    width = -(-longest // 4)
    kept = [(i, label, v + [0] * (4 * width - len(v))) for i, label, v in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, _, v in kept[:256]] for p in range(4)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        for p in range(4):
            held = defaultdict(list)
            for _, _, v in kept:
                held[near(v, p)[1]].append(part(v, p))
            for k, some in held.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, label, "".join(f"{near(v, p)[1]:02x}" for p in range(4)), min(2**63 - 1, sum(near(v, p)[0] for p in range(4)))) for i, label, v in kept]
    sums = Counter()
    for _, label, _, e in out:
        sums[label] += e
    return sorted([(i, c, e, min(2**63 - 1, sums[label]), told) for i, label, c, e in out], key=repr)


def vectors(n=420, d=8, seed=3):
    draw = random.Random(seed)
    rows = [(i, [round(draw.gauss(0, 1), 3) for _ in range(d)], draw.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * (d - 1) + [None], 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 0), (5, rows[5][1], 0), (6, [0.5] * d, 2), (None, [0.25] * d, 2), (n + 4, [0.0] * d, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("rows", [vectors(), vectors(90), vectors(30, 6) + [(1000, [1.0] * 3, 4), (1001, [], 4)], [(1, [], 0), (2, [], None)], [(3, None, 1)], [(1, [3e5] * 8, 1), (2, [-9e5] * 8, 1), (3, [1e30] * 8, 1)]])
def test_codes(spark, rows):
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)
    want = slow_codes([(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]) if max((abs(x) for r in rows for x in r[1] or [] if x and abs(x) < 1e29), default=0) < 1e9 and not any(1e30 in (r[1] or []) for r in rows) else None
    got = rows_of(codes.compress(frame.repartition(4)))
    if want is None:
        assert len(got) == len(rows)  # integers beyond 63 bits stop at the last one
    else:
        assert got == want


def test_codes_empty_and_large_numbers(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, [float(x) for x in (i * 3e5, -i * 2e5, i, 0, 7, 7, 7, 7)], i % 2) for i in range(300)]
    assert rows_of(codes.compress(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))) == slow_codes(rows)


def test_codes_labels_by_shuffle(spark, monkeypatch):
    rows = vectors(60)
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)
    few = rows_of(codes.compress(frame))
    monkeypatch.setattr(codes, "LABELS", 1)
    assert rows_of(codes.compress(frame)) == few


def test_codes_sql(spark):
    names, want = from_sql("op12_codes", embeddings=f"{SF}/embeddings.parquet")
    assert rows_of(queries.op12_codes(spark, SF).select(*names)) == want


# 13. Best-fit packing


def one_by_one(lengths, window):
    """The method on single documents: fill, then exchange the smallest for the two that fill the gap best."""
    left, bins = Counter(lengths), []
    while +left:
        chosen, room = [], window
        while fitting := [n for n in left if left[n] and n <= room]:
            chosen.append(max(fitting))
            left[chosen[-1]] -= 1
            room -= chosen[-1]
        if room and len(chosen) > 1:
            gap = room + chosen[-1]
            pairs = [(a + b, -a, b) for a in left for b in left if a <= b and left[a] and left[b] > (a == b) and chosen[-1] < a + b <= gap]
            if pairs:
                _, a, b = max(pairs)
                left[chosen[-1]] += 1
                left[-a] -= 1
                left[b] -= 1
                chosen[-1:] = [b, -a]
        bins.append(tuple(chosen))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_packing_one_by_one(lengths):
    got = [b.lengths for b in bestfit.plan(Counter(lengths), 40) for _ in range(b.many)]
    assert got == one_by_one(lengths, 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=200))
def test_plan_holds_every_document(lengths):
    bins = bestfit.plan(Counter(lengths), 300)
    assert Counter(n for b in bins for n in b.lengths * b.many) == Counter(lengths)
    assert all(sum(b.lengths) <= 300 for b in bins)
    # No more bins than first fit by falling length needs by its own bound.
    assert sum(b.many for b in bins) <= 11 / 9 * max(1, -(-sum(lengths) // 300), sum(n > 150 for n in lengths)) + 4


def pieces_of(doc, window):
    n = len(doc)
    cuts = [0, *range(n % window or window, n + 1, window)]
    return [(k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in doc[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (6, "wort " * 9000), (7, "one two three"), (7, "one two three"), (None, "no id"), (None, None), (9, "x" * 3000), (11, "ünïcödé 漢字 \U0001f600")]


@pytest.mark.parametrize("window", [2048, 16])
def test_bestfit_rows(spark, window):
    frame = spark.createDataFrame([(*r, "s", 3) for r in ODD], "doc_id long, text string, rank string, length int").repartition(3)
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, *p) for i, t in ODD for p in pieces_of([*library.encode(t or "", add_special_tokens=False).ids, 0], window))
    got = bestfit.pack(frame, TOKENIZER, window, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for told in sequences.values():
        at = 0
        for offset, length in sorted(told):
            assert offset == at
            at += length
        assert at <= window
    lengths = [p[3] for p in want.elements()]
    assert len(sequences) == len(one_by_one(lengths, window))
    assert bestfit.pack(frame.limit(0), TOKENIZER).count() == 0


def test_bestfit_fills_bins_of_whole_tables(spark):
    got = queries.op13_bestfit(spark, "/root/testdata/sf0.01").select("sequence_id", "length").toPandas()
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / bestfit.WINDOW + 1
