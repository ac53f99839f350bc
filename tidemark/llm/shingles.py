"""Word shingles of text batches as 64-bit hashes, in numpy over the columns' bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .common import utf8

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_OF = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
#: Multipliers of a word's bytes by place: the low and the high part of the place each have theirs.
_LOW_PLACES = _rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(place: np.ndarray) -> np.ndarray:
    """An odd multiplier for each place, without a pattern between places."""
    if not len(place) or place.max() < len(_LOW_PLACES):
        return _LOW_PLACES[place]
    return _LOW_PLACES[place & (len(_LOW_PLACES) - 1)] * (mix((place >> 16).astype(np.uint64)) | np.uint64(1))


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts data[at[i]:at[i+1]], and each text's first word's index.

    A word's hash is the sum of a random number per byte value times one per place. As the multipliers aren't the
    powers of one number, no arrangement of letters makes the sums equal whatever the numbers are.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    starts = begins.nonzero()[0]
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    value = _BYTE_OF[data[starts[0] :]]
    place = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    place[value == 0] = 0  # behind the word
    value *= _factors(place)
    return mix(np.add.reduceat(value, starts - starts[0])), bounds


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; fewer words are one shingle, none are the empty set."""
    data, at = utf8(column)
    words, bounds = word_hashes(data, at)
    sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        sums += words[j : j + len(sums)] * _PLACE[j]
    sums = mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(sums[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = words[a:b]
            out.append(mix((short * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = {i: i + 32 for i in range(65, 91)}


def plain_shingles(text: str, k: int = 5) -> frozenset[tuple[str, ...]]:
    """The shingles themselves, for what hashes can't be trusted with."""
    words = _WORD.findall(text.translate(_FOLD))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])
