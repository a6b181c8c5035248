"""Canonical length-limited Huffman coding of integer ids, in numpy.

``code_lengths`` is package-merge; codes follow from the lengths alone (canonical order:
length, then id). ``encode`` packs the most significant bit first; ``decode`` looks up
``max_len`` bits in a table and runs all checkpointed stretches of a block in lockstep.
"""

from __future__ import annotations

import numpy as np

MAX_LEN = 20
STRIDE = 256


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Bits of each id's code; 0 for an id that never occurs. Optimal under the limit."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_len:
        raise ValueError(f"{n} ids do not fit codes of {max_len} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    level, masks = leaves, [np.ones(n, bool)]
    for _ in range(max_len - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        masks.append(order < n)
    take, own = 2 * n - 2, np.zeros(n, np.uint8)
    for mask in reversed(masks):
        got = int(mask[:take].sum())
        own[:got] += 1
        take = 2 * (take - got)
    lengths[used] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    at = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - at
        at = bits
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(entry by the next ``bits`` bits, bits); an entry is the id and, above bit 32, its length."""
    bits = max(1, int(lengths.max(initial=0)))
    entries = np.zeros(1 << bits, np.uint64)
    codes = canonical_codes(lengths)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(codes[ids] << (bits - lengths[ids]).astype(np.uint64))]
    own = lengths[ids].astype(np.int64)
    spread = np.repeat(ids.astype(np.uint64) | own.astype(np.uint64) << np.uint64(32), 1 << (bits - own))
    entries[: len(spread)] = spread
    return entries, bits


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, int, np.ndarray]:
    """(payload, bits in it, bit offset of every ``stride``-th id)."""
    if not len(ids):
        return b"", 0, np.zeros(0, np.uint32)
    n = lengths[ids].astype(np.int64)
    code = codes[ids]
    end = np.cumsum(n)
    at = end - n
    word = at >> 6
    over = (at & 63) + n - 64  # bits that do not fit the 64-bit word
    left = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    packed = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    packed[word[first]] = np.bitwise_or.reduceat(left, first)
    split = np.flatnonzero(over > 0)
    packed[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    total = int(end[-1])
    return packed.astype(">u8").tobytes()[: total + 7 >> 3], total, at[::stride].astype(np.uint32)


def decode(payload: bytes, n_ids: int, checkpoints: np.ndarray, entries: np.ndarray, bits: int, stride: int = STRIDE) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints advance together."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    here = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = checkpoints.astype(np.int64)
    most = (len(here) - 1) << 3
    out = np.empty((stride, len(at)), np.uint32)
    shift, mask = np.int64(32 - bits), np.int64((1 << bits) - 1)
    for k in range(stride):
        entry = entries[(here[at >> 3].astype(np.int64) >> (shift - (at & 7))) & mask]
        out[k] = entry.astype(np.uint32)
        at = np.minimum(at + (entry >> np.uint64(32)).astype(np.int64), most)  # past the last id of the block
    return out.T.reshape(-1)[:n_ids]
