"""Words of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Texts are read in pieces of about ``PIECE`` bytes cut outside words, so a very long text
needs no more memory than its words (8 bytes a word for the hash, 16 for the byte range).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words split at white space only: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) modulo 2^64 for i < n; kept for one size, grown by doubling."""
    have = next(iter(_POWERS.values()), None)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
        have = _POWERS[size]
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _pieces(data: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes; none ends between two bytes of a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and keep[data[end - 1]] and keep[data[end]]:
            gap = np.flatnonzero(~keep[data[end: end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(n, end + 4096)
        yield at, end
        at = end


def words(data: np.ndarray, ends: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words of the texts ``data[ends[i]:ends[i+1]]``.

    A-Z count as a-z. ``first[i]:first[i+1]`` are the words of text i. Words never cross
    the border of two texts.
    """
    keep = word_bytes[LOWER]  # membership is tested on the lower-cased byte
    hashes, starts, stops = [], [], []
    # A text's first byte begins a word even where the text before ends in one.
    borders = np.zeros(len(data) + 1, bool)
    borders[ends[:-1]] = True
    borders[ends[-1]] = True
    for at, end in _pieces(data, keep):
        piece = LOWER[data[at:end]]
        inside = np.empty(len(piece) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = word_bytes[piece]
        here = borders[at:end]
        begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | here))
        after = np.append(here[1:], True)
        finishes = np.flatnonzero(inside[1:-1] & (~inside[2:] | after)) + 1
        if not len(begins):
            continue
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = (sums[finishes] - sums[begins]) * down[begins]
        h ^= (finishes - begins).astype(np.uint64) << np.uint64(56)
        hashes.append(mixed(h))
        starts.append(begins + at)
        stops.append(finishes + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, ends)

