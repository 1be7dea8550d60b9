"""Word shingles of whole texts as sorted 64-bit sets, computed over many texts at once in numpy.

Letters A-Z are lower-cased, words are runs of bytes outside the contract's white space, a shingle is five words; a
text with fewer words has one shingle, the whole sequence; a text without words has none."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from quaylight.llm.common import bytes_of

SIZE = 5
_RNG = np.random.default_rng(9)
_VALUES = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RNG.integers(1, 2**63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on all bits of h."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text), by differences of a polynomial's prefix sums."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    blank = _SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(~blank & (border[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (border[1:] | np.concatenate([blank[1:], [True]]))) + 1
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    np.cumprod(np.full(n, _BASE), out=power[1:])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * power[:n])])
    back = np.uint64(pow(pow(int(_BASE), n, 1 << 64), -1, 1 << 64))
    hashes = mixed((sums[ends] - sums[starts]) * power[n - starts] * back)  # as if every word began at byte 0
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offsets = bytes_of(column)
    hashes, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    many = len(hashes) - SIZE + 1
    if many > 0:
        rolled = np.zeros(many, np.uint64)
        for k in range(SIZE):
            rolled += hashes[k : k + many] * _STEPS[k]
        rolled = mixed(rolled)
    sets = []
    for end, m in zip(ends.tolist(), counts.tolist()):
        a = end - m
        if m >= SIZE:
            sets.append(np.unique(rolled[a : end - SIZE + 1]))
        elif m:
            sets.append(mixed(np.array([(hashes[a:end] * _STEPS[:m]).sum() + np.uint64(m)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
