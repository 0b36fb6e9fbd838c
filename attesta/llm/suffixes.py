"""Suffix sorting in two stages, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

from .common import BYTE_KEYS, RangeHash, spread


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last one never is."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    # In a run of one byte, the byte after the run decides.
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    decides = np.minimum.accumulate(where[::-1])[::-1]
    known = decides < n - 1
    out[:-1][known] = step[decides[known]] > 0
    return out


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least.

    Stage 1 sorts directly the suffixes that are smaller than their successors. Stage 2 scans the buckets of
    first bytes upwards: each suffix found in order puts its predecessor, where that one is larger, at the end
    of what its bucket holds so far. Predecessors of a whole bucket are put in their buckets at once, and runs of
    one byte layer by layer.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_next(data)
    first = np.flatnonzero(small)
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    if len(first):
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        head = np.ascontiguousarray(view[first]).view(">u8").ravel().astype(np.uint64)
        order = np.argsort(head, kind="stable")
        first, head = first[order], head[order]
        tied = np.zeros(len(first), bool)
        same = head[1:] == head[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if tied.any():
            at = np.flatnonzero(tied)
            group = np.cumsum(np.concatenate(([True], ~same)))[at]
            first[at] = _by_windows(padded, first[at], group, depth)
    byte = data[first]
    bounds = np.searchsorted(byte, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        layers = pending[c]
        if layers:
            layer = np.concatenate(layers)
            layers = [layer]
            while len(layer):
                before = layer[layer > 0] - 1
                layer = before[data[before] == c]
                layers.append(layer)
        bucket = np.concatenate([*layers, first[bounds[c] : bounds[c + 1]]]) if layers or bounds[c] < bounds[c + 1] else first[:0]
        pending[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        if len(before):
            kinds = data[before]
            order = np.argsort(kinds, kind="stable")
            before, kinds = before[order], kinds[order]
            cuts = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
                pending[kinds[a]].append(before[a:b])
    return np.concatenate(out)


def _by_windows(padded: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Starts, already in groups of equal first 8 bytes, sorted within them by the bytes up to ``depth``."""
    data = padded.tobytes()
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()
    listed = starts.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a == 2:
            x, y = listed[a], listed[a + 1]
            if data[x : x + depth] > data[y : y + depth]:
                listed[a], listed[a + 1] = y, x
        else:
            listed[a:b] = sorted(listed[a:b], key=lambda i: data[i : i + depth])
    return np.array(listed)


def repeated_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some windows of ``data`` stand as another window too, and one of each class of equal windows.

    The windows are taken in suffix order; of those of one length, equal ones are neighbours there, whose common prefix
    reaches that length.
    """
    place = np.full(len(data), -1)
    place[starts] = np.arange(len(starts))
    order = place[suffix_order(data, int(lengths.max()) if len(lengths) else 0)]
    order = order[order >= 0]
    order = order[np.argsort(lengths[order], kind="stable")]
    a, b = order[:-1], order[1:]
    same = lengths[a] == lengths[b]
    same[same] = common_prefix_reaches(data, starts[a[same]], starts[b[same]], lengths[a[same]])
    repeats, shown = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    repeats[a[same]] = repeats[b[same]] = True
    shown[order[repeats[order] & np.concatenate(([True], ~same))[: len(order)]]] = True
    return repeats, shown


def common_prefix_reaches(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the common prefix of a[i] and b[i] reaches length[i].

    Pairs whose hashes differ are out. The bytes of the others are compared: pairs at one distance whose ranges overlap, together.
    """
    hashes = RangeHash(data, BYTE_KEYS)
    out = hashes.of(a, a + length) == hashes.of(b, b + length)
    at = np.flatnonzero(out)
    if not len(at):
        return out
    low, apart = np.minimum(a[at], b[at]), np.abs(b[at] - a[at])
    order = np.lexsort((low, apart))
    at, low, apart = at[order], low[order], apart[order]
    # Ends, running on within a distance: those of smaller distances lie below any start of the next by this shift.
    shift = len(data) + 1
    number = np.cumsum(np.concatenate(([0], apart[1:] != apart[:-1])))
    end = np.maximum.accumulate(low + length[at] + number * shift) - number * shift
    new = np.concatenate(([True], (apart[1:] != apart[:-1]) | (low[1:] > end[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    sizes = end[last] - low[first]
    x = spread(low[first], sizes)
    differ = np.concatenate(([0], np.cumsum(data[x] != data[x + np.repeat(apart[first], sizes)])))
    base = (np.cumsum(sizes) - sizes)[np.cumsum(new) - 1] - low[first][np.cumsum(new) - 1]
    out[at] = differ[low + length[at] + base] == differ[low + base]
    return out
