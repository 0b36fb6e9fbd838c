"""Shingle sets of texts, and their similarity sketches.

Fast similarity sketching: every element of a set is put into a hashed bin, round after round, and each of the first
T rounds sees all elements; in round T + i, the elements go to bin i alone, so no bin stays empty. A bin keeps
the least value, rounds before hashes. Two sets agree in a bin with the probability of their Jaccard similarity, and
the share of equal bins is concentrated as for T independent samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mixed, word_hashes

SHINGLE = 5
#: Bins of a sketch. The first 96 form 24 bands of 4: sets at a similarity of 0.8 share no band with probability 3.2e-6, at 0.85 with 2e-8.
BINS = 1024
BAND = 4
BANDS = 24
SEED = 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = mixed(np.arange(11, 11 + SHINGLE, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z in lower case, start and end of each word in them, and where each text's words begin among all words."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return data, starts, ends, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word 5-grams of each text, A-Z in lower case.

    Fewer words count as one shingle, no words as none.
    """
    if not texts:
        return []
    data, starts, ends, bounds = words_of(texts)
    words = word_hashes(data, starts, ends)
    n = len(words)
    if n >= SHINGLE:
        grams = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            grams += words[k : n - SHINGLE + 1 + k] * _MULTIPLIERS[k]
        grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            total = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    total = total * np.uint64(SEED | 1) + words[a + k] * _MULTIPLIERS[k]
            out.append(mixed(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """As ``shingle_sets``, but numbers in place of hashes: shingles of these texts have one number exactly if their words are the same bytes."""
    if not texts:
        return []
    data, starts, ends, bounds = words_of(texts)
    out = [np.zeros(0, np.int64)] * len(texts)
    if not len(starts):
        return out
    # Each word with what follows it up to the next would be other bytes: cut the gaps out.
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes())]).dictionary_encode()
    one, many = words.indices.to_numpy().astype(np.int64), len(words.dictionary)

    def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
        values, number = np.unique(keys, return_inverse=True)
        return number, len(values)

    if len(one) >= SHINGLE:
        two, n = numbered(one[:-1] * many + one[1:])
        four, _ = numbered(two[:-2] * n + two[2:])
        five, _ = numbered(four[:-1] * many + one[4:])
    short: dict[tuple[int, ...], int] = {}
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            out[i] = np.unique(five[a : b - SHINGLE + 1])
        elif b > a:
            out[i] = np.array([-1 - short.setdefault(tuple(one[a:b].tolist()), len(short))])
    return out


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The value of each bin for a set that isn't empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    done = 0
    top = np.uint64(52)  # 12 bits for the round: 2048 rounds, and what no round filled stays above them all
    while done < 2 * bins:
        # As many rounds at once as fill a few thousand cells.
        rounds = np.arange(done, min(2 * bins, done + max(1, 2 * bins // max(1, len(elements) // 2))), dtype=np.uint64)
        done = int(rounds[-1]) + 1
        hashed = mixed(elements[None, :] ^ mixed(rounds + np.uint64(SEED))[:, None])
        value = (rounds[:, None] << top) | (hashed >> (np.uint64(64) - top))
        free = rounds < bins
        place = np.where(free[:, None], (hashed & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32), (rounds - np.uint64(bins))[:, None])
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        if int(out.max() >> top) < done:
            break
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band."""
    with np.errstate(over="ignore"):
        folded = (values[: bands * BAND].reshape(bands, BAND) * _MULTIPLIERS[None, :BAND]).sum(1, dtype=np.uint64)
    return mixed(folded + np.arange(bands, dtype=np.uint64) * np.uint64(SEED)).astype(np.int64)


def marks(values: np.ndarray) -> np.ndarray:
    """Two bits of each bin, in 64-bit integers: first one bit of all bins, then the other.

    Sets of similarity s differ in a share of 3/4 * (1 - s) of the bins.
    """
    values = mixed(values)
    return np.packbits(np.concatenate([(values >> np.uint64(k)) & np.uint64(1) for k in (0, 1)]).astype(bool)).view(np.int64)
