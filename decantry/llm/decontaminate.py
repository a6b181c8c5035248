"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of ``window`` consecutive item words (an item of fewer words is
one shorter window). The alphabet is words, compared by 64-bit hashes:

* block shift table: for a block of two words, how far the search may move on because no
  pattern of this length ends nearer to it; a block that no pattern holds skips the most;
* suffix buckets: a block of shift 0 ends some patterns; the whole window's hash picks
  the test strings among them;
* direct comparison of the words' bytes confirms each occurrence.

The search runs many stretches of text in lockstep in numpy, each at its own position.

Patterns travel to the tasks as a broadcast of at most ``MAX_PATTERNS`` windows; a larger
benchmark is searched in blocks of that many, one pass over the documents a block, and
the passes' hit ranges are merged by document row. Documents are never shuffled in the
usual case of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, slices, text_or_empty, utf8_bytes, written
from decantry.llm.textwords import ALNUM, LOWER, mixed, words

WINDOW = 10
MAX_PATTERNS = 500_000
SLICE_BYTES = 4 << 20
STRETCH = 256
_TABLE_BITS = 20

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _folded(h: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """One hash of the ``length`` words from each place of ``first``."""
    out = np.zeros(len(first), np.uint64)
    for k in range(length):
        out = out * _A + h[first + k] * _B
    return mixed(out)


@dataclass
class Patterns:
    """Search tables for windows of one length."""

    length: int
    block: int
    shift: np.ndarray  # by hashed block
    keys: np.ndarray  # sorted window hashes
    texts: list[bytes]  # the words of each window, one space apart, in the order of keys
    items: list[tuple[int, ...]]  # places of the items that hold the window


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def build_patterns(length: int, windows: dict[bytes, set[int]]) -> Patterns:
    texts = sorted(windows)
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    h, _, _, first = words(data, np.concatenate([[0], np.cumsum(sizes)[:-1], [len(raw)]]), ALNUM)
    begin = first[:-1]
    block = min(2, length)
    most = length - block + 1
    shift = np.full(1 << _TABLE_BITS, most, np.uint8)
    for k in range(length - block + 1):  # block of words k..k+block-1 of each window
        np.minimum.at(shift, _slot(_folded(h, begin + k, block)), length - block - k)
    keys = _folded(h, begin, length)
    order = np.argsort(keys, kind="stable")
    return Patterns(length, block, shift, keys[order], [texts[i] for i in order],
                    [tuple(sorted(windows[texts[i]])) for i in order])


def search(p: Patterns, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word place, pattern place) where the hash of a whole window is a pattern's.

    ``first`` are the borders of the texts in ``h``; windows stay inside one text.
    """
    lo, hi = first[:-1], first[1:]
    long_enough = hi - lo >= p.length
    lo, hi = lo[long_enough], hi[long_enough]
    # Stretches of window starts, so that one long text is many lanes.
    starts = hi - lo - p.length + 1
    n = -(-starts // STRETCH)
    which = np.repeat(np.arange(len(lo)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = lo[which] + nth * STRETCH
    end = np.minimum(at + STRETCH, hi[which] - p.length + 1)
    found_at, found = [], []
    tail = p.length - p.block
    blocks = _slot(_folded(h, np.arange(max(0, len(h) - p.block + 1)), p.block)) if len(at) else None
    while len(at):
        move = p.shift[blocks[at + tail]].astype(np.int64)
        stop = np.flatnonzero(move == 0)
        if len(stop):
            place = at[stop]
            key = _folded(h, place, p.length)
            k = np.searchsorted(p.keys, key)
            k[k == len(p.keys)] = 0
            hit = p.keys[k] == key
            found_at.append(place[hit])
            found.append(k[hit])
            move[stop] = 1
        at = at + move
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def occurrences(tables: list[Patterns], data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]], set[int]]]:
    """For each text: (place, word count, [(first word, last word, first byte, end byte)], items)."""
    h, start, stop, first = words(data, ends, ALNUM)
    hits: dict[int, list] = {}
    for p in tables:
        at, which = search(p, h, first)
        if not len(at):
            continue
        text_of = np.searchsorted(first, at, side="right") - 1
        for a, k, t in zip(at.tolist(), which.tolist(), text_of.tolist(), strict=True):
            own = b" ".join(LOWER[data[start[i]: stop[i]]].tobytes() for i in range(a, a + p.length))
            if own == p.texts[k]:
                hits.setdefault(t, []).append((a - first[t], a - first[t] + p.length, int(start[a] - ends[t]),
                                               int(stop[a + p.length - 1] - ends[t]), p.items[k]))
    for t in range(len(ends) - 1):
        found = hits.get(t, [])
        yield t, int(first[t + 1] - first[t]), [x[:4] for x in sorted(found)], {i for x in found for i in x[4]}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(texts: list[bytes], window: int) -> Iterator[tuple[int, bytes]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, start, stop, first = words(data, ends, ALNUM)
    for i in range(len(texts)):
        own = [LOWER[data[start[k]: stop[k]]].tobytes() for k in range(first[i], first[i + 1])]
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            yield i, b" ".join(own[k: k + n])


def window_rows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item`` (id as text, null stays null), ``length``, ``pattern``: distinct windows of all items."""
    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            rows = [(ids[i], w.count(b" ") + 1, w) for i, w in _windows(texts, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.binary())], ["item", "length", "pattern"])

    texts = items.select(F.col("item_id").cast("string").alias("item"), text_or_empty().cast("binary").alias("text"))
    return map_arrow(texts, cut, "item string, length int, pattern binary").distinct()


def _search_pass(docs: DataFrame, tables: list[Patterns], names: list[str | None]) -> DataFrame:
    """``docs`` columns but ``_scan`` (the text), then the findings of one block of patterns."""
    sent = docs.sparkSession.sparkContext.broadcast((tables, names))
    schema = docs.drop("_scan").schema
    out_names = [*schema.names, "n_words", "spans", "items"]

    def scan(batches):
        own, item_names = sent.value
        for batch in slices(batches, "_scan", SLICE_BYTES):
            place = batch.schema.get_field_index("_scan")
            data, ends = utf8_bytes(batch.column(place))
            n, spans, items = [], [], []
            for _, count, hits, which in occurrences(own, data, ends):
                n.append(count)
                word_ranges = merged([x[:2] for x in hits])
                by_first = {x[0]: x[2] for x in hits}
                by_last = {x[1]: x[3] for x in hits}
                spans.append([{"first_word": a, "end_word": b, "first_byte": by_first[a], "end_byte": by_last[b]}
                              for a, b in word_ranges])
                items.append(sorted({item_names[i] for i in which if item_names[i] is not None}))
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "first_byte", "end_byte")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(batch.num_columns) if k != place]
                + [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], out_names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return map_arrow(docs, scan, ddl + (", " if ddl else "") + "n_words bigint, spans array<struct<first_word:bigint,"
                     "end_word:bigint,first_byte:bigint,end_byte:bigint>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_patterns: int = MAX_PATTERNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, the ``carry`` columns, ``n_words``, ``spans`` and ``items``.

    ``spans`` are the maximal runs of hit words (word and byte ranges in the text),
    ``items`` the ids, as sorted strings, of benchmark items with an occurring window.

    Null and blank texts have no words, on either side. Items without words have no
    window. Repeated items count once an id; a null item id marks words as hit but is not
    in ``items``. Repeated document rows come out as often as they came in. Either table
    may be empty. Other columns are ignored; ``carry`` names must not be the above.
    """
    spark = docs.sparkSession
    patterns = written(window_rows(benchmark, window), "windows")
    distinct = patterns.select("length", "pattern").distinct().count()
    blocks = max(1, -(-distinct // max_patterns))
    patterns = patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    rows = docs.select("doc_id", *carry, text_or_empty().cast("binary").alias("_scan"))
    passes = []
    if blocks > 1:  # the passes meet again by this number, fixed by writing it down
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    for b in range(blocks):
        by_length: dict[int, dict[bytes, set[int]]] = {}
        names: dict[str | None, int] = {}
        for r in patterns.where(F.col("block") == b).toLocalIterator():
            place = names.setdefault(r["item"], len(names))
            by_length.setdefault(r["length"], {}).setdefault(bytes(r["pattern"]), set()).add(place)
        tables = [build_patterns(k, v) for k, v in sorted(by_length.items())]
        passes.append(_search_pass(rows, tables, list(names)))
    if blocks == 1:
        return passes[0]
    return _joined(passes, carry).drop("_row")


def _joined(passes: list[DataFrame], carry: tuple[str, ...]) -> DataFrame:
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    zero = F.array().cast("array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], x["end_word"]).alias("end_word"),
                          last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte"))
        touching = (F.size(acc) > 0) & (x["first_word"] <= last["end_word"])
        return F.when(touching, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return (every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in carry],
                                      F.first("n_words").alias("n_words"),
                                      F.aggregate(ordered, zero, add).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))


def hit_words() -> F.Column:
    """Words inside any occurrence, from ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
