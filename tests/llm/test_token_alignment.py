"""Token alignment against a merge of one document's tokens at a time."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from decantry.llm.token_alignment import ByteBpe, PieceBpe, align, align_documents, group_links, lockstep

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sides():
    return ByteBpe(P.path("byte_bpe_50k.json")), PieceBpe(P.path("piece_bpe_32k.model"))


def _spell(side, i):
    return side.bytes[side.starts[i]: side.starts[i] + side.lengths[i]].tobytes()


def _groups(text, a, b):
    """[(A ids, B ids)] of one text; none where a side spells something else."""
    if not text:
        return [], 0, 0
    # The library's own call on the whole text.
    x = a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    y = b.model.encode(text)
    want = (" " + text).encode()
    if b"".join(_spell(a, i) for i in x) != want or b"".join(_spell(b, i) for i in y) != want:
        return [], 0, 0
    out, own, at_a, at_b, k = [], ([], []), 0, 0, 0
    for i in x:
        at_a += a.lengths[i]
        own[0].append(i)
        while at_b < at_a:
            at_b += b.lengths[y[k]]
            own[1].append(y[k])
            k += 1
        if at_a == at_b:
            out.append(own)
            own = ([], [])
    return out, len(x), len(y)


def _brute(rows, a, b):
    docs = [(i, *_groups(t, a, b)) for i, t in rows]
    count = collections.Counter()
    for _, groups, _, _ in docs:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, n_a, n_b in docs:
        links = [count[x, y] == best[x] for g in groups for x in g[0] for y in g[1]]
        total = sum(count[x, y] for g in groups for x in g[0] for y in g[1])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((repr(i), n_a, n_b, len(groups), len(links), sum(links), total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def _rows():
    rng = random.Random(4)
    pool = ["The", "naïve", "coöperation", "日本語", "🙂👍🏽", "x" * 40, "\n\n", "  ", "<|endoftext|>", "<s>", "▁", "42", "don't", " ", "ﬁ", "İ.", "\t", "é"]
    rows = [(None, None), (0, ""), (1, " "), (2, "<|endoftext|></s><unk>"), (3, "a\x00b"), (4, "a" * 3000), (5, "the same"), (5, "the same"), (6, "▁▁"), (7, "​﻿")]
    rows += [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))) for k in range(10, 60)]
    return rows + [(99, "lorem ipsum, dolor 日本 sit. " * 2000)]


def test_alignment_brute(spark, docs_of, sides):
    rows = _rows()
    docs = docs_of(rows, extra=("slice", "n_a", "pairs", "counts", "part")).repartition(3)
    got = align_documents(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    got = sorted((repr(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got)
    assert got == _brute(rows, *sides)
    assert sum(r[1] > 0 for r in got) > 15


def test_alignment_of_no_rows(spark, docs_of):
    none = docs_of([(1, "a")]).where("false")
    assert align_documents(none, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
    empty = align_documents(docs_of([(1, ""), (2, None)]), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"], r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in empty) == [(1, 0, 0, 0, ""), (2, 0, 0, 0, "")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=40), max_size=6), st.integers(1, 9))
def test_lockstep_finds_all_common_ends(docs, lane):
    ends_a, ends_b, heads, stops, at = [], [], [], [], 0
    for marks in docs:
        size = len(marks) + 1
        for k, (x, y) in enumerate([*marks, (True, True)], 1):
            ends_a += [at + k] * x
            ends_b += [at + k] * y
        heads.append(at)
        at += size
        stops.append(at)
    a, b = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
    cut_a, cut_b = lockstep(a, b, np.array(heads, np.int64), np.array(stops, np.int64), lane)
    common = np.intersect1d(a, b)
    assert (a[cut_a] == common).all() and (b[cut_b] == common).all() and len(cut_a) == len(common)


def test_large_groups_pair_their_distinct_ids():
    rng = np.random.default_rng(2)
    ids_a, ids_b = rng.integers(0, 9, 500), rng.integers(0, 7, 300)
    cut_a, cut_b = np.array([99, 399, 400, 499]), np.array([89, 280, 281, 299])
    doc = np.array([0, 0, 2, 2])
    got = {(d, p): n for d, p, n in zip(*(x.tolist() for x in group_links(doc, ids_a, ids_b, cut_a, cut_b, 10, 10)), strict=True)}
    want, la, lb = collections.Counter(), 0, 0
    for d, ha, hb in zip(doc.tolist(), cut_a.tolist(), cut_b.tolist()):
        for x in ids_a[la: ha + 1].tolist():
            for y in ids_b[lb: hb + 1].tolist():
                want[d, x * 10 + y] += 1
        la, lb = ha + 1, hb + 1
    assert got == dict(want)


def test_align_memory_shape(sides):
    got = align(["", "one two", "two one two"], *sides)
    assert got["counts"].shape == (4, 3) and got["sha"][0] == "" and set(got["doc"].tolist()) == {1, 2}


SPACES = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x1f", "\x85", "\u180e", "\u200b", "\u2028", "\r\n", "   "]
OTHERS = ["a", "don't", "'s", "''", "!", "é", "日", "1", "½", "\u0301", "🙂", "_", "İ.", "x'll", "<|endoftext|>", "Σ", "\u1680", "\ufeff", "ǅ", "𝟘", "\ue000"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SPACES + OTHERS), max_size=14))
def test_words_give_the_ids_of_the_whole(sides, parts):
    text = "".join(parts)
    assert sides[0].by_word
    sides[0].known.clear()
    assert sides[0].encode([text])[0].tolist() == sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_text_gives_the_ids_of_the_whole(sides, text):
    text = text.encode("utf-8", "ignore").decode()
    assert sides[0].encode([text])[0].tolist() == sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids


def test_letters_are_cut_from_what_ends_them(sides):
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    texts = [f"x{c}{e} {c}{c.upper()}{e}\n{c}{e}" for c in letters for e in (".", ",")] + ["don't, it's. a.b, ,. ., İ. ª, x.. y,,"]
    for _ in range(2):  # the second time from the cache
        for t, ids in zip(texts, sides[0].encode(texts), strict=True):
            assert ids.tolist() == sides[0].tokenizer.encode(" " + t, add_special_tokens=False).ids


def test_the_cache_keeps_to_its_bound(sides, monkeypatch):
    import decantry.llm.token_alignment as T
    monkeypatch.setattr(T, "KNOWN_BYTES", 2000)
    for k in range(4):
        texts = [f"w{k}x{i}, the" for i in range(40)] + ["q" * 9000 + " the"]
        for t, ids in zip(texts, sides[0].encode(texts), strict=True):
            assert ids.tolist() == sides[0].tokenizer.encode(" " + t, add_special_tokens=False).ids
        assert len(sides[0].known) < 200
