"""Places of fragments in another text by their context: a fragment that stands there several times is grown until one place is left.

A source's suffixes are sorted once, those of many sources together. The places of a context are then a range of that order, and both a
character more on the left (by where the suffixes behind stand) and one more on the right (by their next character) narrow it in
logarithmic time, for all fragments at once: nothing is counted again, whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import aligned

#: Fragments of one source that a task looks for with the same order of suffixes.
PER_SOURCE = 4096
#: Characters of documents and sources whose suffixes a task sorts at once.
BLOCK = 600_000
#: Steps that are taken one by one first, and shifts of a text whose differences are kept.
STEPS, KEPT = 8, 512
AMBIGUOUS = "inline_math_source_alignment_ambiguous"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixOrders:
    """The suffixes of some texts in order, text by text, the empty one of each first."""

    def __init__(self, texts: list[str]) -> None:
        codes = [_codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        #: Where each text begins, in the texts as in the order; behind each is one place for its end.
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        n, texts_n = int(self.starts[-1]), len(texts)
        flat = np.concatenate([*codes, np.zeros(0, np.uint32)])
        there = np.zeros(0x110000, bool)
        there[flat] = True
        #: The symbol of a character, from 1 on; 0 is none.
        self.symbol_of = np.where(there, np.cumsum(there), 0)
        letters = int(there.sum())
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts[1:] - 1] = False
        symbols[inside] = self.symbol_of[flat]
        of = np.repeat(np.arange(texts_n), sizes + 1)
        # As many characters as fit a number are sorted at once. Two suffixes of a text differ where the shorter one ends, if not before.
        bits = max(1, letters.bit_length())
        width = (63 - texts_n.bit_length()) // bits
        key = of.copy()
        for k in range(width):
            key <<= bits
            key[: max(0, n - k)] |= symbols[k:]
        order = np.argsort(key)
        differs = np.ones(n + 1, bool)
        differs[1:n] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(differs[:n], np.arange(n), 0))
        # Those that are alike so far are sorted by what follows, twice as far each time.
        while len(at := np.flatnonzero(~(differs[:n] & differs[1:]))):
            some = order[at]
            pair = rank[some] * n + rank[some + width]
            sort = np.argsort(pair)
            some, pair = some[sort], pair[sort]
            order[at] = some
            fresh = np.concatenate(([True], np.diff(pair) != 0))
            differs[at[fresh]] = True
            rank[some] = np.maximum.accumulate(np.where(fresh, at, 0))
            width *= 2
        self.order, self.rank, self.symbols, self.size, self.letters = order, rank, symbols, n, letters + 1
        self.texts, self._differing = texts, {}
        follows = np.where(inside, np.arange(n) + 1, self.starts[of])
        #: For each suffix its text, its first symbol, and where the suffix behind that stands: these rise.
        self.behind = ((of * self.letters + symbols) * n + rank[follows])[order]

    def left(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of contexts with one symbol more in front; empty for one that is none."""
        base = (which * self.letters + symbol) * self.size
        a, b = np.searchsorted(self.behind, base + low), np.searchsorted(self.behind, base + high)
        return a, np.where(symbol > 0, b, a)

    def right(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of contexts of these lengths with one symbol more behind; empty for one that is none."""
        ends = []
        for wanted in (symbol, symbol + 1):
            a, b = low.copy(), high.copy()
            while len(open_ := np.flatnonzero(a < b)):
                middle = (a[open_] + b[open_]) // 2
                less = self.symbols[self.order[middle] + length[open_]] < wanted[open_]
                a[open_[less]] = middle[less] + 1
                b[open_[~less]] = middle[~less]
            ends.append(a)
        return ends[0], np.where(symbol > 0, ends[1], ends[0])

    def _differences(self, which: int, shift: int) -> np.ndarray:
        """Where a text differs from itself moved by so many places; its end differs from all."""
        key = which, shift
        if key not in self._differing:
            if len(self._differing) >= KEPT:
                self._differing.clear()
            a, b = self.starts[which], self.starts[which + 1]
            self._differing[key] = a + np.flatnonzero(self.symbols[a : b - shift] != self.symbols[a + shift : b])
        return self._differing[key]

    def alike(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many characters the first and the last place of each range have in common before, and behind the context of that length."""
        a, b = self.order[low], self.order[high - 1]
        first, shift = np.minimum(a, b), np.abs(a - b)
        before, behind = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
        sort = np.lexsort((shift, which))
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(which[sort]) != 0) | (np.diff(shift[sort]) != 0), [True])))
        for i, j in zip(edges, edges[1:], strict=False):
            at = sort[i:j]
            text = int(which[at[0]])
            differs = self._differences(text, int(shift[at[0]]))
            last = np.searchsorted(differs, first[at]) - 1
            before[at] = first[at] - 1 - np.where(last >= 0, differs[np.maximum(last, 0)], self.starts[text] - 1)
            behind[at] = differs[np.searchsorted(differs, first[at] + length[at])] - first[at] - length[at]
        return before, behind

    def places(self, documents: list[str], which: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place and context (from and to in the document) of documents[which][start:end] in the text of the same number, -1 where there isn't one place.

        Of the two ways to grow by a character the one that leaves fewer places is taken, the left one on a tie; a way that leaves none
        isn't one. All fragments grow at once; where a text is looked up in itself, steps that leave all places are taken together.
        """
        same = np.array([d == t for d, t in zip(documents, self.texts, strict=True)], bool)
        codes = [_codes(d) for d in documents]
        sizes = np.array([len(c) for c in codes], np.int64)
        base = (np.cumsum(sizes) - sizes)[which]
        symbols = np.concatenate([self.symbol_of[np.concatenate([*codes, np.zeros(0, np.uint32)])], [0]])
        sizes = sizes[which]
        low, high = self.starts[which], self.starts[which + 1]
        at = ends - 1
        while len(open_ := np.flatnonzero((at >= starts) & (high > low))):
            low[open_], high[open_] = self.left(which[open_], low[open_], high[open_], symbols[base[open_] + at[open_]])
            at[open_] -= 1
        left, right, steps = starts.copy(), ends.copy(), 0
        high[ends <= starts] = low[ends <= starts]
        while len(open_ := np.flatnonzero((high - low > 1) & ((left > 0) | (right < sizes)))):
            a, b, l, r, own = low[open_], high[open_], left[open_], right[open_], base[open_]
            before = np.where(l > 0, symbols[own + np.maximum(l - 1, 0)], 0)
            after = np.where(r < sizes[open_], symbols[own + r], 0)
            la, lb = self.left(which[open_], a, b, before)
            ra, rb = self.right(a, b, r - l, after)
            lefts, rights, all_ = lb - la, rb - ra, b - a
            # Ways that keep all places: to the left while the right one keeps them too or is none, to the right while the left one is none.
            leap_left = same[which[open_]] & (lefts == all_) & ((rights == all_) | (rights == 0))
            leap_right = same[which[open_]] & (rights == all_) & (lefts == 0)
            if len(at := np.flatnonzero(leap_left | leap_right)) and (steps := steps + 1) > STEPS:
                before, behind = self.alike(which[open_[at]], a[at], b[at], (r - l)[at])
                # Those between the first and the last place have it in common too as long as no other suffix comes between.
                head, tail, n = self.order[a[at]], self.order[b[at] - 1], all_[at]
                sure, beyond = np.ones(len(at), np.int64), before + 1
                while len(search := np.flatnonzero(leap_left[at] & (beyond - sure > 1))):
                    middle = (sure[search] + beyond[search]) // 2
                    holds = self.rank[tail[search] - middle] - self.rank[head[search] - middle] == n[search] - 1
                    sure[search[holds]], beyond[search[~holds]] = middle[holds], middle[~holds]
                to = leap_left[at]
                moved = np.where(to, sure, 0)
                low[open_[at]], high[open_[at]] = self.rank[head - moved], self.rank[tail - moved] + 1
                left[open_[at]] -= moved
                right[open_[at]] += np.where(to, 0, behind)
                rest = ~(leap_left | leap_right)
                open_, la, lb, ra, rb, lefts, rights = (x[rest] for x in (open_, la, lb, ra, rb, lefts, rights))
            to_left = (lefts > 0) & ((rights == 0) | (lefts <= rights))
            low[open_], high[open_] = np.where(to_left, la, ra), np.where(to_left, lb, rb)
            left[open_] -= to_left
            right[open_] += ~to_left & (rights > 0)
        found = high - low == 1
        place = self.order[np.where(found, low, 0)] - self.starts[which] + starts - left
        return np.where(found, np.stack([place, left, right]), -1)


class SuffixOrder(SuffixOrders):
    """The suffixes of a text in order, the empty one first."""

    def __init__(self, text: str) -> None:
        super().__init__([text])


def unique_place(document: str, start: int, end: int, order: SuffixOrder) -> tuple[int, int, int] | None:
    """Where document[start:end] stands in the source, and the context that shows it; None where no place is left, or several."""
    found = order.places([document], np.zeros(1, np.int64), np.array([start]), np.array([end]))[:, 0]
    return tuple(found.tolist()) if found[1] >= 0 else None


def unique_places(targets: DataFrame, texts: DataFrame, key: str, agreeing: bool = False) -> DataFrame:
    """key, id, place, context_start, context_end and reason of each target (key, id, start, end) of a document in its source.

    ``texts``: key, document, source. With ``agreeing`` the alignment of the two texts has to map the fragment to the very place (which
    takes time with the square of their lengths: for containers, not for whole texts). A target without one place has a reason;
    one outside of its document, or without texts, has too. The targets of a source are dealt to several tasks where there are many.
    """
    counted = targets.groupBy(key).agg(F.ceil(F.count("*") / PER_SOURCE).alias("__parts"))
    dealt = targets.join(counted, key).withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")))
    held = dealt.groupBy(key, "__part").agg(F.collect_list(F.struct("id", "start", "end")).alias("targets"))
    kinds = [targets.schema[c].dataType.simpleString() for c in (key, "id")]
    rows = held.join(texts.select(key, "document", "source"), key, "left").select(key, "targets", "document", "source")

    names = ["place", "context_start", "context_end", "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.add(pc.fill_null(pc.utf8_length(whole["source"]), 0), pc.fill_null(pc.utf8_length(whole["document"]), 0))
            block = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                batch = whole.slice(a, b - a)
                documents, sources = batch["document"].to_pylist(), batch["source"].to_pylist()
                some = batch["targets"].flatten()
                starts, ends = (pc.fill_null(some.field(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                number = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["targets"]).to_numpy(zero_copy_only=False))
                known = np.array([x is not None and y is not None for x, y in zip(documents, sources, strict=True)], bool)
                documents, sources = [x or "" for x in documents], [x or "" for x in sources]
                sound = known[number] & (starts >= 0) & (starts < ends) & (ends <= np.array([len(x) for x in documents], np.int64)[number])
                told = np.full((3, len(number)), -1)
                told[:, sound] = SuffixOrders(sources).places(documents, number[sound], starts[sound], ends[sound])
                if agreeing:
                    matched = [{b: a for a, b in aligned(x, y).items()} if ok else {} for x, y, ok in zip(documents, sources, known, strict=True)]
                    for i in np.flatnonzero(told[1] >= 0):
                        if any(matched[number[i]].get(p) != told[0, i] + p - starts[i] for p in range(starts[i], ends[i])):
                            told[:, i] = -1
                gone = told[1] < 0
                columns = [pa.array(c.astype(np.int32), mask=gone) for c in told] + [pa.array([AMBIGUOUS if g else None for g in gone.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(number)), some.field("id"), *columns], [key, "id", *names])

    return rows.mapInArrow(run, f"{key} {kinds[0]}, id {kinds[1]}, place int, context_start int, context_end int, reason string")
