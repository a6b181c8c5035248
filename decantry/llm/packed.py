"""Key counts of a corpus in packed form: slices, parts and the messages between them.

A *slice* is what one Arrow step made of a few megabytes of text; a *part* owns a range of
a 64-bit key space. Slices send each part their distinct keys once, sorted, as byte deltas
in one binary value, instead of one row a key and document; a part sums them and can answer
each slice in the order it asked. Keys are spread evenly by a one-to-one mix, and there are
as many parts as keep a part at about ``PART_KEYS`` keys, so that a part is bounded at any
size of corpus and a frequent key costs one entry a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

PART_KEYS = 1 << 20
LEAST_PARTS = 16

_M1 = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
_M2 = np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))


def unmixed(h: np.ndarray) -> np.ndarray:
    """The inverse of ``textwords.mixed``."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * _M1
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


def part_count(keys: int) -> int:
    """A power of two with about ``PART_KEYS`` keys a part."""
    return max(LEAST_PARTS, 1 << max(0, int(-(-keys // PART_KEYS) - 1).bit_length()))


def part_of(spread: np.ndarray, parts: int) -> np.ndarray:
    """The part of each (mixed) key, by its top bits."""
    return (spread >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64)


def cut_by_part(spread: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the non-empty ranges of sorted mixed keys."""
    owner = part_of(spread, parts)
    borders = np.flatnonzero(np.diff(owner)) + 1
    for lo, hi in zip([0, *borders.tolist()], [*borders.tolist(), len(owner)], strict=True):
        if hi > lo:
            yield int(owner[lo]), lo, hi


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the fewest bytes a delta, plane by plane, compressed; none: no bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    first, rest = steps[:1], steps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + first.tobytes() + zstandard.compress(planes.tobytes(), 1)


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    planes = np.frombuffer(zstandard.decompress(raw[9:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw[1:9], np.uint8)
    steps[1:, :width] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative integers in the smallest unsigned type that holds them, compressed."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(values, f"<u{width}").tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, for each key given its place among the distinct ones)."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    distinct, place = np.unique(every, return_inverse=True)
    weight = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    # Sums stay below 2^53, the limit of bincount's weights.
    return distinct, np.bincount(place, weights=weight, minlength=len(distinct)).astype(np.int64), place
