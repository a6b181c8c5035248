"""Exact dedup, n-gram join, suffix dedup, line dedup: brute force on small rows."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from decantry.llm.components import components
from decantry.llm.exact_dedup import exact_dedup
from decantry.llm.line_dedup import line_dedup
from decantry.llm.ngram_join import Bands, _dealt, ngram_join, shingle_sets, sketch_keys, thin_bands
from decantry.llm.suffix_dedup import _repeats, suffix_dedup

CLASH = ("n_bytes", "class", "keep_id", "n_lines", "h", "key", "id", "doc", "n", "spans")


# --- exact dedup ---

def test_exact_dedup_brute(docs_of):
    rng = random.Random(1)
    texts = [None, "", "a", "aa", "ab", "x" * 70 + "1", "x" * 70 + "2", "é" * 40, "y" * 5000]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(None, "lonely"), (None, "aa"), (7, "again"), (7, "again")]
    got = exact_dedup(docs_of(rows, CLASH)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((repr(i), repr(best[t or ""]), len(groups[t or ""]), i == best[t or ""]) for i, t in rows)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept) for r in got) == want
    # Whole texts are hashed only where length and prefix leave a group open.
    assert all((r.full_sha256 is None) == (r.group_size == 1) for r in got if r.n_bytes not in (2, 71))


def test_exact_dedup_empty(docs_of):
    assert exact_dedup(docs_of([]).limit(0)).collect() == []


# --- n-gram join ---

def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def _near_rows(seed, groups=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["Up", "é"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one"), (None, "one two")]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 9, 30, 90, 300]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 14)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) + 3, " ".join(own)))
    rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def _components(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return sorted((repr(i), len(sets[k]), repr(least[find(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_brute(docs_of, seed):
    rows = _near_rows(seed)
    got = ngram_join(docs_of(rows, CLASH)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == _components(rows)


def test_ngram_join_empty(docs_of):
    assert ngram_join(docs_of([]).limit(0)).collect() == []
    assert [(r.n_shingles, r.component_id) for r in ngram_join(docs_of([(5, None)])).collect()] == [(0, 5)]


def test_chain_of_links_is_one_component(docs_of):
    """Ends of a chain are unlike each other but reachable; a hub of many copies changes nothing."""
    words = [f"v{k}" for k in range(400)]
    rows = [(100 + k, " ".join(words[8 * k: 8 * k + 200])) for k in range(12)]
    rows += [(500 + k, rows[0][1]) for k in range(40)]
    assert {r.component_id for r in ngram_join(docs_of(rows)).collect()} == {100}


def test_linked_sets_share_one_of_their_rarest_keys():
    """The pigeonhole and prefix bounds on random pairs around the threshold."""
    rng = np.random.default_rng(3)
    bands = Bands(3000)
    for n in (1, 5, 8, 13, 40, 150, 900, 2500):
        a = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        other = a.copy()
        for k in range(n):
            other[k] = rng.integers(1, 1 << 62)
            inter = n - k - 1
            if 100 * inter < 85 * (2 * n - inter):
                break
            both = np.concatenate([np.sort(a), np.sort(other)])
            sets, key, band, spare = sketch_keys(both, np.array([0, n, 2 * n]), bands)
            shared = {}
            for b in np.unique(band):
                own = [key[(sets == s) & (band == b)] for s in (0, 1)]
                drop = [int(spare[(sets == s) & (band == b)][0]) for s in (0, 1)] if len(own[0]) and len(own[1]) else [0, 0]
                order = rng.permutation(np.unique(key))  # any one order of the keys will do
                place = {int(x): p for p, x in enumerate(order)}
                kept = [set(sorted(own[s].tolist(), key=place.get)[: len(own[s]) - drop[s]]) for s in (0, 1)]
                shared[b] = bool(kept[0] & kept[1])
            assert any(shared.values()), (n, k)


@pytest.mark.parametrize(("need", "of", "most"), [(85, 100, 12), (80, 100, 11)])
def test_sets_that_differ_by_one_meet_in_every_layout_of_segments(need, of, most):
    """All layouts of 6 to 12 (11) shingles, and the same with one more: whatever the order of the
    keys, one that both have is among the kept ones of both."""
    bands = Bands(40, need, of)
    tokens = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    texts = []
    for n in range(6, most + 1):
        band = int(np.searchsorted(bands.low, n + 1, side="right")) - 1
        k = int(bands.segments[band])
        _, at, _ = _dealt(tokens, np.array([0, len(tokens)]), np.array([0]), np.array([band]), np.array([k]))
        pool = [tokens[at == x].tolist() for x in range(k)]
        for cuts in itertools.combinations(range(n + k - 1), k - 1):
            load = np.diff([-1, *cuts, n + k - 1]) - 1
            own = [t for x in range(k) for t in pool[x][: load[x]]]
            for x in range(k):
                texts += [own, [*own, pool[x][load[x]]]]
    border = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.concatenate([np.sort(np.array(t, np.uint64)) for t in texts])
    thin = int(np.bitwise_or.reduce(thin_bands(flat, border, bands)))
    kept, lists = {}, {}
    for s, key, sketch, spare in zip(*(c.tolist() for c in sketch_keys(flat, border, bands, thin)), strict=True):
        lists.setdefault((s, sketch), set()).add(key)
        kept[s, sketch] = spare
    for a in range(0, len(texts), 2):
        assert any((a, b) in lists and (a + 1, b) in lists and all(
            len(lists[s, b] - lists[t, b]) < len(lists[s, b]) - kept[s, b] for s, t in ((a, a + 1), (a + 1, a)))
            for b in range(2 * len(bands.low))), (texts[a], texts[a + 1])


def test_shingle_sets_of_odd_texts():
    texts = [b"", b"a", b"A a", b"a b c d", b"a b c d a b c d", b"\xc3\xa9 x y z q"]
    _, border = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.diff(border).tolist() == [len(_set(t.decode())) for t in texts]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(1, k) for k in range(2, 60)] + [(7, 7), (3, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(101, 131)}, **{k: 1 for k in range(2, 60)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- suffix dedup ---

def _cut(rows):
    seen, out = set(), {}
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted((repr(i), *out[i, t or ""]) for i, t in rows)


@pytest.mark.parametrize("hot", [200_000, 4])
def test_suffix_dedup_brute(docs_of, hot, monkeypatch):
    if hot < 10:
        monkeypatch.setattr("decantry.llm.suffix_dedup.CHUNK", 2)
    rng = random.Random(hot)
    parts = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(90, 300))) for _ in range(6)]
    rows = [(None, parts[0]), (0, None), (1, ""), (2, "short"), (3, "z" * 700)]
    for i in range(4, 40):
        rows.append((i, "".join(rng.choice(parts)[rng.randint(0, 50):] if rng.random() < 0.5
                                else "".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 5)))))
    rows += [rows[-1], (90, rows[10][1]), (91, rows[10][1])]
    got = suffix_dedup(docs_of(rows, CLASH), hot=hot).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == _cut(rows)


def _around_one_gram(n, seed):
    """Arguments of ``_repeats``: ``n`` stretches around one gram, all strings owned."""
    rng = np.random.default_rng(seed)
    sides = [rng.integers(97, 99, 68, np.uint8).tobytes() for _ in range(max(3, n // 20))]
    raw = [sides[a] + b"q" * 32 + sides[b] for a, b in rng.integers(0, len(sides), (n, 2))]
    left = rng.integers(0, 69, n)
    raw = [x[68 - k:] for x, k in zip(raw, left, strict=True)]
    zero = np.zeros(n, np.int64)
    return zero, -left, zero, left, raw, np.arange(n) // 2, zero, np.arange(n) % 2 * 500


def test_suffix_dedup_memory_of_one_gram():
    """A gram met by many stretches takes bounded memory to sort, however many they are."""
    def peak(n):
        own = _around_one_gram(n, n)
        tracemalloc.start()
        try:
            _repeats(*own)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(60_000) < 2 * peak(15_000)


@pytest.mark.parametrize("chunk", [1, 20, 100, 6000])
def test_suffix_dedup_one_gram_in_bands(chunk, monkeypatch):
    monkeypatch.setattr("decantry.llm.suffix_dedup.CHUNK", chunk)
    own = _around_one_gram(300, chunk)
    seen, want = {}, set()
    for i, (low, left, x, doc, place) in enumerate(zip(own[1], own[3], own[4], own[5], own[7], strict=True)):
        for k in range(low, 1):
            if seen.setdefault((k, x[left + k: left + k + 100]), (doc, place)) != (doc, place):
                want.add((i, k + 68))
    assert len(want) > 100
    assert {(int(i), int(k)) for i, k in zip(*np.nonzero(_repeats(*own)), strict=True)} == want


def test_suffix_dedup_very_long_text(docs_of):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(s["from"], s["to"]) for s in r.spans])
           for r in suffix_dedup(docs_of([(1, long), (2, "q" * 50 + long[262_000:262_400] + "q" * 50)])).collect()}
    assert got == {1: (1_300_000, 0, []), 2: (500, 400, [(50, 450)])}


def test_suffix_dedup_empty(docs_of):
    assert suffix_dedup(docs_of([]).limit(0)).collect() == []


# --- line dedup ---

def _lines(rows, sites, least):
    spread = {}
    for (_, t), s in zip(rows, sites, strict=True):
        for raw in (t or "").split("\n"):
            if raw.strip(" \t\r") and s is not None:
                spread.setdefault(raw.strip(" \t\r"), set()).add(s)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(spread.get(p.strip(" \t\r"), ())) < least]
        out.append((repr(i), len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_brute(docs_of):
    from pyspark.sql import functions as F
    rng = random.Random(6)
    pool = [f"line {k}" for k in range(30)] + ["", "  ", "line 1 ", "\tline 2\r"]
    weights = [30 if k < 6 else 1 for k in range(len(pool))]
    rows = [(i, "\n".join(rng.choices(pool, weights, k=rng.randint(0, 6)))) for i in range(150)] + [(None, None), (3, "line 0"), (3, "line 0")]
    docs = docs_of(rows, CLASH).withColumn("source", F.when(F.col("doc_id") == 9, None).otherwise(F.col("source")))
    sites = [None if i == 9 else f"src{k % 12}" for k, (i, _) in enumerate(rows)]
    got = line_dedup(docs, min_sites=10).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_removed, r.kept_text) for r in got) == _lines(rows, sites, 10)
    assert any(r.n_removed for r in got)


def test_line_dedup_empty_and_native(docs_of):
    df = line_dedup(docs_of([]).limit(0))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()
