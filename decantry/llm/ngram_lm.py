"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words and word pairs of the training documents are counted exactly in packed form
(``packed``): slices of text send their keys, parts of the key space sum them. Each part
then writes its block of the filter: an n-gram whose count lies in the q-th band of a
geometric scale (base ``BASE``) goes in q times, as (n-gram, 1) to (n-gram, q). A scorer
asks for (n-gram, 1), (n-gram, 2), ... until a probe misses; the level before is the count,
never too small and by a false hit (about 0.4 % a probe chain) too large. The filter has
``BITS`` bits for each entry whatever the size of the corpus.

Workers get the filter by broadcast, at most ``BLOCK_BYTES`` at a time: blocks beyond that
go out in further rounds, each of which answers the n-grams of its own blocks, so that
the size of a broadcast does not depend on the corpus.

The model interpolates pairs with words (a Dirichlet prior of weight ``PRIOR``):
P(w | h) = (c(h w) + PRIOR P(w)) / (c(h) + PRIOR) and P(w) = (c(w) + 1) / (N + V + 1), all c
from probes. ``h`` of a text's first word is the end mark of the text before.

Nulls and empty texts hold one token, the end. A text of any length is read whole (8 bytes
of memory a word); repeated rows are rows of their own, scored alike; a null ``doc_id`` is
an id like others; other columns are ignored; an empty table gives an empty result, and
without training rows every probability is that of an empty corpus (1 for the first word).
Words are named by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, slices, text_or_empty, utf8_bytes, written
from decantry.llm.packed import cut_by_part, pack_counts, pack_sorted, part_count, part_of, summed, unpack_counts, unpack_sorted
from decantry.llm.textwords import SPACED, mixed, words
from decantry.session import ship_package

BASE = 1.5
BITS = 12
PROBES = 6
PRIOR = 16.0
SLICE_BYTES = 8 << 20
BLOCK_BYTES = 64 << 20

END = np.uint64(0x5BF03635A0F0B1C7)  # the end mark, beside the hashes of words
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LEVEL = np.uint64(0x9E3779B97F4A7C15)

#: Smallest count of each band, and the middle of a band (0 for an unseen n-gram).
BANDS = np.array(sorted({math.ceil(BASE ** k) for k in range(100)}), np.float64)
MIDDLE = np.concatenate([[0.0], (BANDS[:-1] + BANDS[1:] - 1) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, counts, side="right")


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; the first follows an end mark."""
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    return mixed(before * _PAIR + tokens)


def hashes_of(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (key, level); probe i looks at ``one + i * two``."""
    one = mixed(keys + np.uint64((level * int(_LEVEL) + 1) & ((1 << 64) - 1)))
    return one, mixed(one) | np.uint64(1)


def bit_place(one: np.ndarray, two: np.ndarray, i: int, n_bits: np.ndarray | int) -> np.ndarray:
    """Bit of probe i in a block of ``n_bits`` (fewer than 2^32), by multiply and shift."""
    high = (one + np.uint64(i) * two) >> np.uint64(32)
    return ((high * np.asarray(n_bits, np.uint64)) >> np.uint64(32)).astype(np.int64)


def block_of(keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> tuple[int, bytes]:
    """(bits, packed bits) of the filter block that holds these n-grams."""
    levels = level_of(counts)
    n_bits = max(64, -(-int(levels.sum()) * bits_each // 8) * 8)
    bits = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
        one, two = hashes_of(keys[levels >= level], level)
        for i in range(PROBES):
            bits[bit_place(one, two, i, n_bits)] = True
    return n_bits, np.packbits(bits, bitorder="little").tobytes()


class Blocks:
    """Some parts' blocks side by side."""

    def __init__(self, parts: int, rows: list[tuple[int, int, bytes]]):
        self.parts = parts
        self.n_bits = np.zeros(parts, np.int64)
        self.at = np.zeros(parts, np.int64)
        at = 0
        for part, n_bits, raw in rows:
            self.n_bits[part], self.at[part] = n_bits, at
            at += len(raw)
        self.bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by probes up to the first miss; 0 for keys of other parts."""
        found = np.zeros(len(keys), np.uint8)
        owner = part_of(keys, self.parts)
        live = np.flatnonzero(self.n_bits[owner])
        for level in range(1, len(BANDS)):
            if not len(live):
                break
            one, two = hashes_of(keys[live], level)
            for i in range(PROBES):  # those that miss leave at once
                own = owner[live]
                place = bit_place(one, two, i, self.n_bits[own])
                hit = (self.bits[self.at[own] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
                live, one, two = live[hit], one[hit], two[hit]
            found[live] = level
        return found


def sliced(docs: DataFrame, train: Column) -> DataFrame:
    """A row a slice: its documents, its words by frequency and its tokens as places among them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def cut(batches):
        base, seq = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", SLICE_BYTES):
            data, ends = utf8_bytes(batch.column(1))
            h, _, _, first = words(data, ends, SPACED)
            sizes = np.diff(first) + 1
            stops = np.cumsum(sizes) - 1
            tokens = np.empty(int(sizes.sum()), np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[stops] = False
            tokens[inner], tokens[stops] = h, END
            own, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + seq]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                 pa.array([batch.column(2).to_numpy(zero_copy_only=False).tolist()], pa.list_(pa.bool_())),
                 pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([len(tokens)]), pa.array([len(own)]),
                 pa.array([own[order].astype("<u8").tobytes()], pa.binary()), pa.array([pack_counts(rank[place])], pa.binary())],
                ["slice", "doc_ids", "train", "sizes", "n_tokens", "n_words", "vocabulary", "places"])
            seq += 1

    return map_arrow(rows, cut, f"slice long, doc_ids array<{kind}>, train array<boolean>, sizes array<long>, "
                     "n_tokens long, n_words long, vocabulary binary, places binary")


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the slice, place of each token, whether its document trains)."""
    own = np.frombuffer(row["vocabulary"], "<u8")
    return own, unpack_counts(row["places"]), np.repeat(np.array(row["train"], bool), row["sizes"])


def _messages(cut: DataFrame, parts: int) -> DataFrame:
    """To each part: the slice's words (kind 0, also unseen ones) and its training pairs (kind 1)."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, place, train = _tokens(row)
                order = np.argsort(own)
                seen = np.bincount(place[train], minlength=len(own))[order]
                pairs, times = np.unique(pair_keys(own[place])[train], return_counts=True)
                out = [(part, kind, pack_sorted(keys[lo:hi]), pack_counts(n[lo:hi]))
                       for kind, keys, n in ((0, own[order], seen), (1, pairs, times))
                       for part, lo, hi in cut_by_part(keys, parts)]
                part, kind, keys, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array([row["slice"]] * len(out), pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(n, pa.binary())],
                    ["part", "kind", "slice", "keys", "counts"])

    narrow = cut.select("slice", "train", "sizes", "vocabulary", "places")
    return map_arrow(narrow, send, "part long, kind int, slice long, keys binary, counts binary")


_TALLY = "part long, slice long, counts binary, n_bits long, bits binary, tokens long, types long"


def _tally(table: pa.Table, bits_each: int) -> pa.Table:
    """One part: a filter block, and for each slice the exact counts of the words it sent."""
    rows = table.to_pylist()
    part = rows[0]["part"]
    out, grams, totals = [], [], []
    tokens = types = 0
    for kind in (0, 1):
        mine = [r for r in rows if r["kind"] == kind]
        keys = [unpack_sorted(r["keys"]) for r in mine]
        distinct, total, place = summed(keys, [unpack_counts(r["counts"]) for r in mine])
        if kind == 0:
            tokens, types = int(total.sum()), int((total > 0).sum())
            at = 0
            for r, k in zip(mine, keys, strict=True):
                out.append((part, r["slice"], pack_counts(total[place[at: at + len(k)]]), None, None, None, None))
                at += len(k)
        grams.append(distinct[total > 0])
        totals.append(total[total > 0])
    n_bits, bits = block_of(np.concatenate(grams), np.concatenate(totals), bits_each)
    out.append((part, None, None, n_bits, bits, tokens, types))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                [f.split()[0] for f in _TALLY.split(", ")])


def _probed(spark: SparkSession, cut: DataFrame, tally: DataFrame, parts: int, block_bytes: int) -> DataFrame | None:
    """``slice, words, pairs``: levels of the slice's words and of its tokens' pairs, a row a round.

    The driver sees one size a part and, at any time, the blocks of one round.
    """
    sizes = [(r["part"], r["n_bits"]) for r in tally.where("bits is not null").select("part", "n_bits").orderBy("part").collect()]
    rounds: list[list[int]] = []
    room = 0
    for part, n_bits in sizes:
        if not rounds or room < n_bits // 8:
            rounds.append([])
            room = block_bytes
        rounds[-1].append(part)
        room -= n_bits // 8
    answers = None
    for own in rounds:
        block = (tally.where("bits is not null").where(F.col("part").between(own[0], own[-1]))
                 .select("part", "n_bits", "bits").collect())
        sent = spark.sparkContext.broadcast(Blocks(parts, [(r["part"], r["n_bits"], bytes(r["bits"])) for r in block]))
        del block

        def ask(batches, sent=sent):
            blocks = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    mine = np.frombuffer(row["vocabulary"], "<u8")
                    pairs = pair_keys(mine[unpack_counts(row["places"])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["slice"]]), pa.array([pack_counts(blocks.levels(mine))], pa.binary()),
                         pa.array([pack_counts(blocks.levels(pairs))], pa.binary())], ["slice", "words", "pairs"])

        got = written(map_arrow(cut.select("slice", "vocabulary", "places"), ask, "slice long, words binary, pairs binary"), "lm-levels")
        sent.destroy()
        answers = got if answers is None else answers.unionByName(got)
    return answers


def score_documents(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES, prior: float = PRIOR,
                    bits_each: int = BITS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document row.

    ``train`` tells which rows the model learns from. ``base_score`` is that of exact word
    counts with one added; ``score`` the filter model's. Both are log10 of a probability.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = written(sliced(docs, train), "lm-slices")
    keys = cut.agg(F.sum(F.col("n_tokens") + F.col("n_words"))).first()[0] or 0
    parts = part_count(keys)
    tally = written(_messages(cut, parts).groupBy("part").applyInArrow(lambda t: _tally(t, bits_each), _TALLY), "lm-tally")
    n, v = tally.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    levels = _probed(spark, cut, tally, parts, block_bytes)
    schema = ("doc_id " + kind + ", held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if levels is None:
        return spark.createDataFrame([], schema)
    exact = tally.where("bits is null").select("slice", "part", "counts", F.lit(None).cast("binary").alias("words"),
                                               F.lit(None).cast("binary").alias("pairs"))
    known = exact.unionByName(levels.select("slice", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("counts"),
                                            "words", "pairs"))
    log_base = math.log10(n + v + 1)

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        row, told = one.to_pylist()[0], other.to_pylist()
        own, place, train_token = _tokens(row)
        count = np.empty(len(own), np.int64)
        count[np.argsort(own)] = np.concatenate([unpack_counts(r["counts"]) for r in sorted(
            (r for r in told if r["part"] is not None), key=lambda r: r["part"])])
        word = sum(unpack_counts(r["words"]) for r in told if r["part"] is None)
        pair = sum(unpack_counts(r["pairs"]) for r in told if r["part"] is None)
        heads = np.cumsum([0, *row["sizes"][:-1]])
        guess = MIDDLE[word]
        before = np.concatenate([[guess[own == END][0]], guess[place][:-1]])
        p = (np.minimum(MIDDLE[pair], before) + prior * (guess[place] + 1) / (n + v + 1)) / (before + prior)
        base = np.log10(count + 1.0) - log_base
        held = [not t for t in row["train"]]
        size = len(held)
        return pa.Table.from_arrays(
            [one.column("doc_ids").chunk(0).flatten(), pa.array(held), pa.array(row["sizes"], pa.int64()),
             pa.array(np.add.reduceat((count > 0)[place].astype(np.int64), heads)), pa.array([int(n)] * size, pa.int64()),
             pa.array(np.add.reduceat(base[place], heads)), pa.array(np.add.reduceat(np.log10(p), heads))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (cut.select("slice", "doc_ids", "train", "sizes", "vocabulary", "places").groupBy("slice")
            .cogroup(known.groupBy("slice")).applyInArrow(score, schema))
