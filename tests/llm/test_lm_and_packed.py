"""Packed key counts and the log-frequency Bloom filter language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decantry.llm import packed
from decantry.llm.labelled import held_out
from decantry.llm.ngram_lm import BANDS, MIDDLE, PRIOR, Blocks, block_of, level_of, score_documents
from decantry.llm.textwords import mixed

keys64 = st.lists(st.integers(0, 2 ** 64 - 1), max_size=300)


@settings(max_examples=40, deadline=None)
@given(keys64)
def test_packed_round_trips(values):
    keys = np.unique(np.array(values, np.uint64))
    assert (packed.unmixed(mixed(keys)) == keys).all()
    assert (packed.unpack_sorted(packed.pack_sorted(keys)) == keys).all()
    small = (keys >> np.uint64(14)).astype(np.int64)
    assert (packed.unpack_counts(packed.pack_counts(small)) == small).all()
    spread = np.sort(mixed(keys))
    ranges = list(packed.cut_by_part(spread, 16))
    assert [p for p, *_ in ranges] == sorted(set(packed.part_of(spread, 16).tolist()))
    assert sum(hi - lo for _, lo, hi in ranges) == len(keys)


def test_filter_levels_are_never_too_small():
    rng = np.random.default_rng(1)
    keys = mixed(np.arange(20_000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10 ** 9)
    parts, owner = 16, packed.part_of(keys, 16)
    blocks = Blocks(parts, [(p, *block_of(keys[owner == p], counts[owner == p])) for p in range(parts)])
    found, true = blocks.levels(keys).astype(int), level_of(counts)
    assert (found >= true).all() and (found == true).mean() > 0.98
    unseen = blocks.levels(mixed(np.arange(10 ** 6, 10 ** 6 + 20_000, dtype=np.uint64)))
    assert (unseen > 0).mean() < 0.01
    assert (MIDDLE[true] >= BANDS[true - 1]).all() and (np.diff(MIDDLE) > 0).all()


def _tokens(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def _brute(rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = _tokens(t)
        uni.update(w)
        bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    band = lambda c: MIDDLE[level_of(np.array([c]))[0]]
    out = []
    for i, t in rows:
        w = _tokens(t)
        model = 0.0
        for h, x in zip([None, *w], w):
            ch = band(uni[h])
            model += math.log10((min(band(bi[h, x]), ch) + PRIOR * (band(uni[x]) + 1) / (n + v + 1)) / (ch + PRIOR))
        out.append((repr(i), i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(uni[x] > 0 for x in w), n,
                    sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), model))
    return sorted(out)


def _rows():
    rng = random.Random(3)
    pool = ["a", "B", "bc", "é,", "x-y", "A", "zz.", "the", "The"]
    rows = [(None, None), (None, "solo the"), (1, ""), (2, " \n\t "), (3, "a b"), (3, "a b"), (4, "a  b\x0bA"), (5, "w " * 30_000)]
    return rows + [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for k in range(10, 90)]


@pytest.mark.parametrize("block_bytes,bits", [(64 << 20, 12), (16, 12), (64 << 20, 64), (100, 64)])
def test_scores_brute(spark, docs_of, block_bytes, bits):
    rows = _rows()
    docs = docs_of(rows, extra=("slice", "train", "part", "words", "score", "held_out")).repartition(3)
    got = score_documents(docs, ~held_out(F.col("doc_id"), 7, 2), block_bytes=block_bytes, bits_each=bits).collect()
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = _brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    # The filter may err upwards, by little; with many bits an entry it does not here.
    scores, true = np.array([g[6] for g in got]), np.array([w[6] for w in want])
    assert np.allclose(scores, true, rtol=1e-9 if bits == 64 else 0.05)


def test_scores_without_rows_or_training(spark, docs_of):
    none = docs_of([(1, "a")]).where("false")
    assert score_documents(none, F.lit(True)).count() == 0
    alone = score_documents(docs_of([(1, "a b")]), F.lit(False)).first()
    assert (alone["n_known"], alone["train_tokens"], alone["base_score"], alone["held_out"]) == (0, 0, 0.0, True)


def test_scores_do_not_depend_on_partitions(spark, docs_of):
    docs = docs_of(_rows())
    one, many = (sorted((repr(r["doc_id"]), r["n_tokens"], round(r["score"], 9)) for r in
                        score_documents(docs.repartition(n), ~held_out(F.col("doc_id"), 7, 2)).collect()) for n in (1, 9))
    assert one == many
