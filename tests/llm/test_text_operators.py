"""Decontamination, token file, mixing, pseudonyms, classifiers and the pipeline."""

import importlib.util
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decantry.llm import huffman
from decantry.llm.decontaminate import decontaminate, hit_words
from decantry.llm.labelled import fit_logistic
from decantry.llm.mixing import doc_hash, mix_sources, repeat_mixed
from decantry.llm.pseudonyms import pseudonymise
from decantry.llm.quality import classify_quality
from decantry.llm.toxicity import _Matcher, classify_toxicity, folded

CLASH = ("n_words", "spans", "items", "size", "copies", "score", "target", "h", "seq")


# --- decontamination ---

def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _contaminated(docs, items):
    wins = []
    for i, t in items:
        w = _words(t)
        n = min(10, len(w))
        wins += [(i, tuple(w[k:k + n])) for k in range(len(w) - n + 1 if n else 0)]
    out = []
    for i, t in docs:
        w, hit, own = _words(t), set(), set()
        for item, win in set(wins):
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own.add(item)
        out.append((repr(i), len(w), len(hit), sorted(str(x) for x in own if x is not None)))
    return sorted(out)


@pytest.mark.parametrize("most", [500_000, 7])
def test_decontaminate_brute(spark, docs_of, most):
    rng = random.Random(most)
    pool = ["Ab", "b2", "c", "é", "Dd", "e-f", "g_h"]
    long = [" ".join(rng.choice(pool) for _ in range(rng.randint(11, 25))) for _ in range(6)]
    items = [(k, t) for k, t in enumerate(long)] + [(20, "one two three"), (21, None), (22, "..."), (None, "null item words"), (0, long[0]), (23, "solo")]
    docs = [(None, None), (0, ""), (1, "--"), (2, "x one TWO, three y"), (3, "one two"), (4, "null item words"), (5, "SOLO"), (5, "SOLO")]
    for k in range(6, 30):
        t = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        docs.append((k, t + " " + rng.choice(long).upper() + " " + t if k % 3 else t))
    docs.append((40, "w " * 40_000 + long[1]))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, pattern string")
    got = decontaminate(docs_of(docs, CLASH), bench, max_patterns=most).withColumn("n_hit", hit_words()).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == _contaminated(docs, items)
    for r in got:  # byte ranges hold the hit words
        t = dict(docs)[r.doc_id]
        for s in r.spans:
            assert len(_words(t.encode()[s.first_byte:s.end_byte].decode())) == s.end_word - s.first_word


def test_decontaminate_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, len(r.spans)) for r in decontaminate(docs_of([(1, "a b")]), none).collect()] == [(2, 0)]
    assert decontaminate(docs_of([]).limit(0), none).collect() == []


# --- token file ---

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=900), st.integers(9, 20))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.int64) ** 2 % 401
    counts = np.bincount(ids, minlength=401)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (lengths > 0).tolist() == (counts > 0).tolist()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    payload, bits, marks = huffman.encode(ids, huffman.canonical_codes(lengths), lengths, 16)
    assert bits == int((counts * lengths).sum())
    table, width = huffman.decode_table(lengths)
    assert huffman.decode(payload, len(ids), marks, table, width, 16).tolist() == ids.tolist()


def test_code_lengths_are_optimal_without_a_binding_limit():
    import heapq
    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 0])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        best += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts, 20) * counts).sum()) == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_token_file_round_trip(spark, docs_of, vocab, tmp_path):
    from tokenizers import Tokenizer

    from decantry.llm.token_file import document_index, write_token_file
    tok = Tokenizer.from_file(vocab)
    rng = random.Random(2)
    bits = ["a", "B.", "it's", "don't,", " ", "\n", "\t", " ", "é", "é", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "1st", "...", "\x1c", "日本", "Σας", "İx"]
    rows = [(None, None), (0, ""), (9, "  ")] + [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(10, 90)]
    rows += [rows[-1], (200, "word " * 30_000)]
    path = write_token_file(docs_of(rows, CLASH), str(tmp_path / "f"), vocab, 49_408, block_ids=64)
    got = sorted(document_index(spark, path).collect(), key=lambda r: r.start)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    empty = write_token_file(docs_of([]).limit(0), str(tmp_path / "e"), vocab, 49_408)
    assert document_index(spark, empty).collect() == []


# --- mixing ---

def _targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, out, left = share * sum(sizes.values()), {}, set(names)
    rest = total
    while left:  # give by weight, cap, give the excess again
        w = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 2 * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / w for s in left}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        rest -= sum(2 * sizes[s] for s in over)
        left -= over
    return out


def test_mix_sources_targets_and_rows(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("b", 300), ("a", 40), ("é", 5), (None, 20), ("z", 2), ("blank", 3), ("c", 900)):
        rows += [(len(rows) + k, s, None if s == "blank" else " ".join(["w"] * rng.randint(0, 60))) for k in range(n)]
    rows += [rows[0], rows[0], (None, "b", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("h", F.lit(1))
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    taken, longest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= 3 * longest[s] for s in sizes)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    out = repeat_mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mix_sources_takes_the_lowest_hashes(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], " ".join(["w"] * (k % 9))) for k in range(400)], "doc_id long, source string, text string")
    got = mix_sources(docs).join(docs.select("doc_id", doc_hash(F.col("doc_id"), F.col("text")).alias("h")), "doc_id").collect()
    for s in "ab":
        own = sorted((r.h, r.copies) for r in got if r.source == s and r["size"])
        assert [c for _, c in own] == sorted((c for _, c in own), reverse=True)
    assert mix_sources(docs.limit(0)).collect() == []


# --- pseudonyms ---

def test_pseudonyms_keep_format_link_and_restore(spark):
    texts = ["+1 (988) 555-2485 and +1 (988) 555-2485", "card 4041894974608795 / 4041-8949-7460-8795", "not a card 4041894974608796",
             "97.51.17.173, 999.1.1.1, 1.2.3.4.5", "1999-02-28 29.02.2000 31/12/1987 2001-02-30", "123-45-6789 000-12-1234",
             "bob.42@mail8.example.com", None, "", "no numbers", "é 4735 4795522935961213", "x" * 200_000 + " 10.0.0.1"]
    docs = spark.createDataFrame([(k, t, "z", "z") for k, t in enumerate(texts)], "doc_id long, text string, n_replaced string, _key string")
    made = pseudonymise(docs, "k1")
    got = {r.doc_id: r for r in made.collect()}
    assert [got[k].n_replaced for k in range(12)] == [2, 2, 0, 1, 3, 1, 1, 0, 0, 0, 1, 1]
    phones = re.findall(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[0].text)
    assert len(phones) == 2 and phones[0] == phones[1] != "+1 (988) 555-2485"
    one, other = re.findall(r"[0-9][0-9-]{12,}", got[1].text)
    assert one == other.replace("-", "")
    digits = [int(c) for c in reversed(one)]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert got[7].text is None and got[8].text == "" and got[2].text == texts[2]
    assert "999.1.1.1, 1.2.3.4.5" in got[3].text and got[4].text.endswith("2001-02-30")
    back = {r.doc_id: r.text for r in pseudonymise(made, "k1", restore=True).collect()}
    assert back == dict(enumerate(texts))
    assert {r.doc_id: r.text for r in pseudonymise(docs, "k2").collect()}[0] != got[0].text
    assert "Python" not in made._jdf.queryExecution().toString()
    assert pseudonymise(docs.limit(0), "k").collect() == []


def test_pseudonyms_of_values_alone_in_a_text(spark):
    """No other number in the text: each kind passes the prefilter, and equal values stay linked."""
    texts = ["ask 8.8.8.8 or 1.1.1.1", "ask 8.8.8.8 of 2024", "a@b.cd", "+1 (988) 555-2485", "1999-02-28", "29.02.2000", "123-45-6789",
             "4041894974608795", "8.8.8", "v 1.2 of 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pseudonymise(docs, "k1")
    got = {r.doc_id: r for r in made.collect()}
    assert [got[k].n_replaced for k in range(10)] == [2, 1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert got[0].text.split()[1] == got[1].text.split()[1] != "8.8.8.8"
    assert {r.doc_id: r.text for r in pseudonymise(made, "k1", restore=True).collect()} == dict(enumerate(texts))


def test_number_network_is_a_permutation(spark):
    """All days of the domain map to distinct days of the domain."""
    from decantry.llm.pseudonyms import DAYS, _number
    df = spark.range(DAYS).select(_number(F.col("id"), 27, DAYS // 27, "k", "date", False).alias("x"))
    r = df.agg(F.countDistinct("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).first()
    assert (r.n, r.a, r.b) == (DAYS, 0, DAYS - 1)


# --- classifiers ---

def test_folding():
    assert folded("1d10t ID!OT іdіоt ｉｄｉｏｔ l0s3r5 m0r0n5 room 42 $$$") == "idiot idiot idiot idiot losers morons room 42 $$$"


def test_matcher_word_borders_longest_and_exceptions():
    m = _Matcher([("trash", True, 2.0), ("idio", False, 1.0), ("idiot", True, 3.0)], ["trash can"])
    assert [w for _, _, w in m.matches("trashy trash can idiotic idiot trash")] == [1.0, 3.0, 2.0]
    assert _Matcher([], []).strength("anything") == 0.0


def _labelled(spark, n, mark):
    rng = random.Random(n)
    words = [f"{a}{b}" for a in ("be", "co", "du", "fa") for b in ("ran", "lin", "tos", "mik", "pul")]
    rows = []
    for k in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200)))
        y = int(rng.random() < 0.3)
        rows.append((k, mark(t, rng) if y else t, y))
    rows += [(n, None, None), (n + 1, "", 0), (None, "nothing", None)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows if y is not None] + [(None, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, docs, labels


def _held_out_accuracy(rows, got, folds, fold, good):
    truth = {i: y for i, _, y in rows}
    own = [r for r in got if r.held_out]
    assert {r.doc_id for r in own} == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % folds == fold}
    known = [r for r in own if truth[r.doc_id] is not None]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    return sum(r.predicted == good(truth[r.doc_id]) for r in known) / len(known)


def test_quality_held_out(spark):
    rows, docs, labels = _labelled(spark, 700, lambda t, rng: " | ".join(w.upper() + "!!" for w in t.split()))
    got = classify_quality(docs, labels).collect()
    assert _held_out_accuracy(rows, got, 4, 2, lambda y: 1 - y) > 0.95
    none = classify_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity_held_out(spark):
    def spoil(t, rng):
        w = t.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "1d1ot", "іdiot,", "scum", "SCUM."])
        return " ".join(w)
    rows, docs, labels = _labelled(spark, 700, spoil)
    got = classify_toxicity(docs, labels).collect()
    assert _held_out_accuracy(rows, got, 5, 0, lambda y: y) > 0.97
    assert {r.score for r in classify_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert classify_toxicity(docs.limit(0), labels).collect() == []


def test_logistic_recovers_a_threshold():
    x = np.linspace(-1, 1, 400)
    slope, at = fit_logistic(x, (x > 0.3).astype(float))
    assert slope > 0 and abs(-at / slope - 0.3) < 0.05
    assert fit_logistic(np.zeros(4), np.ones(4))[0] == 0.0


# --- pipeline and registration ---

def test_pipeline_stages_hold(spark, sf_small):
    """Each stage against its operator's own rule, on what the last one kept."""
    import corpus_pipeline as c
    from decantry.llm.common import table, written
    docs = table(spark, sf_small, "documents")
    seen = [docs]
    for _, stage in c.STAGES:
        docs = written(stage(spark, seen[-1], sf_small), "stage-test")
        seen.append(docs)
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert [d.columns for d in seen[1:-1]] == [c.COLUMNS] * 4
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) <= set(rows[1]) and set(rows[3]) <= set(rows[2]) and set(rows[4]) <= set(rows[3])
    sets = {i: _shingles(r.text, 5) for i, r in rows[1].items()}
    ids = sorted(rows[1])
    gone = set(ids) - set(rows[2])
    for i in gone:  # each dropped text has a like one with a smaller id or a chain to it
        assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in ids if j != i)
    for i in rows[2]:
        assert not any(j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in rows[2])
    bench = [(r.item_id, r.text) for r in table(spark, sf_small, "benchmark").collect()]
    wins = {tuple(w[k:k + 10]) for _, t in bench if len(w := _words(t)) >= 10 for k in range(len(w) - 9)}
    clean = {i for i, r in rows[2].items() if not any(tuple(w[k:k + 10]) in wins for w in [_words(r.text)] for k in range(len(w) - 9))}
    assert set(rows[3]) == clean
    assert rows[5].keys() == rows[4].keys() and seen[5].count() == seen[4].count()


def _shingles(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _one_word_apart(n, mark):
    w = [f"{mark}{k}" for k in range(n)]
    return [" ".join(w), " ".join([*w[:n // 2], "other", *w[n // 2 + 1:]])]


def test_near_duplicates_takes_five_words_and_a_similarity_of_080(spark, docs_of):
    """One word changed in n: (n - 9) of n + 1 five-word shingles are common, 0.796 to 0.804 here."""
    import corpus_pipeline as c
    texts = _one_word_apart(48, "a") + _one_word_apart(49, "b") + _one_word_apart(50, "c")
    got = c.near_duplicates(spark, docs_of(list(enumerate(texts))), "")
    assert got.columns == c.COLUMNS
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 4]


def test_near_duplicates_tells_rows_apart_not_ids(spark, docs_of):
    """Null ids, ids that several texts share, and repeated rows: each group keeps one row, and no other row goes."""
    import corpus_pipeline as c
    a, b, d, e, f = ([*_one_word_apart(60, mark), f"{mark} alone"] for mark in "abdef")
    rows = [(1, a[0]), (None, a[1]), (None, a[2]), (None, b[2]),  # a null id goes, unlike null ids stay
            (7, b[0]), (9, b[1]), (9, d[2]),  # id 9 goes once only
            (11, d[0]), (11, d[0]), (11, d[0]),  # repeated rows
            (None, e[0]), (None, e[1]), (None, e[0]),  # no id at all
            (20, f[0]), (20, f[1]), (20, f[2]),  # one id, like and unlike texts
            (30, None), (30, None), (31, ""), (None, " ")]
    got = c.near_duplicates(spark, docs_of(rows), "").collect()
    same = {t: mark for mark, own in zip("abdef", (a, b, d, e, f), strict=True) for t in own[:2]}
    want = [(1, "a"), (None, a[2]), (None, b[2]), (7, "b"), (9, d[2]), (11, "d"), (None, "e"), (20, "f"), (20, f[2]), (30, None), (30, None), (31, ""), (None, " ")]
    assert sorted((repr(r.doc_id), repr(same.get(r.text, r.text))) for r in got) == sorted((repr(i), repr(t)) for i, t in want)


def test_registered_queries_agree_with_their_sql(spark, sf_small):
    import duckdb

    from decantry.llm.queries import ORACLES, QUERIES
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf_small)
        want = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want.select(*cols).fetchall()), name


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "decantry"), tmp_path / "decantry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') or x == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("decantry.llm") is not None
