"""Alignment of two tokenizers' tokens of one text, and how often ids meet across a corpus.

Both tokenizers spell the same bytes; where a token of A and one of B end at the same byte,
the text is cut, and the tokens between two cuts are a group. The merge runs in lockstep:
one state vector holds an A and a B pointer for every lane of a slice of documents, a step
compares all lanes' token ends at once, notes the cuts, moves the pointer that lags (both at
a cut) and drops finished lanes. A long document is several lanes of ``LANE_BYTES``, each
entered by binary search, so that steps do not grow with the longest text.

Links are all pairs of an A and a B token of one group. Each document's distinct id pairs
are kept with their multiplicity (a group's distinct ids are paired, never its occurrences
where it is large). Slices send their distinct pairs to parts (``packed``), which sum the
documents that hold a pair and answer each slice; an A id's highest count is a table of at
most the vocabulary's size, the only thing collected and broadcast.

A null or empty text, and one whose tokens of either side do not spell a space and the text
(B's normaliser changed it), has no tokens: zeros and an empty string. A text is encoded
whole, so memory grows with the longest one (some 100 bytes a token); repeated rows are
documents of their own; a null ``doc_id`` is an id like others; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, slices, text_or_empty, written
from decantry.llm.packed import cut_by_part, pack_counts, pack_sorted, part_count, summed, unmixed, unpack_counts, unpack_sorted
from decantry.llm.textwords import mixed
from decantry.session import ship_package

SLICE_BYTES = 4 << 20
LANE_BYTES = 1 << 11
PAIRED_WHOLE = 1 << 12  # links of a group up to which its pairs are written out one by one
LINKS_AT_ONCE = 1 << 21
KNOWN_BYTES = 160 << 20  # words and their ids that a worker keeps, with some 160 bytes of Python for each
LONG_WORD = 1 << 12

_WHITE = re.compile(r" \s| $|^\s|^$")
_CUT = re.compile(r"(?= \S)")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class Side:
    """One tokenizer: ids of texts, and the bytes each id spells."""

    def __init__(self, spelled: list[bytes]):
        self.size = len(spelled)
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.digits = np.zeros((self.size, len(str(self.size)) + 1), np.uint8)
        self.width = np.array([len(str(i)) for i in range(self.size)], np.int64)
        for i in range(self.size):
            self.digits[i, : self.width[i]] = np.frombuffer(str(i).encode(), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in turn."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[at + np.repeat(self.starts[ids] - (ends - lengths), lengths)]


class ByteBpe(Side):
    """A byte-level BPE file of the tokenizers library, given a space and the text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        names = {i: name for name, i in vocab.items()}
        # Printable bytes stand for themselves, the others in turn for the characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["id"] for t in json.loads(self.tokenizer.to_str()).get("added_tokens", [])}
        super().__init__([names.get(i, "").encode() if i in special else bytes(byte_of[c] for c in names.get(i, ""))
                          for i in range(max(names) + 1)])

        # Ids of " " + word; only where the file itself says that words never meet (see ``_cut``).
        file = json.loads(self.tokenizer.to_str())
        first = file.get("pre_tokenizer") or {}
        self.by_word = (file.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex")
                        and not first.get("add_prefix_space") and file.get("truncation") is None)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,"}

    @staticmethod
    def _cut(text: str) -> list[str]:
        """A space and the text, cut before each space that a character other than white space
        follows, without that space.

        The byte-level pre-tokenizer always cuts there: a run of white space before such a
        character gives its last space to it, and nothing else takes a space after other
        characters. So the library's ids of the cut parts, each with its space, are its ids
        of the whole. (White space here holds all that the library counts as such.)
        """
        if _WHITE.search(text) is None:
            return text.split(" ")
        return [w[1:] for w in _CUT.split(" " + text) if w]

    def _learnt(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each word and its space, many words a call: as parts of one text where the cut
        between them is sure, apart where a word begins with white space."""
        plain = [w for w in words if w and not w[0].isspace()]
        for k in range(0, len(plain), 2048):
            part = plain[k: k + 2048]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) + 1 for w in part])) + 1
            for w, lo, hi in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                yield w, ids[lo:hi].tobytes()
        odd = [w for w in words if not w or w[0].isspace()]
        for w, e in zip(odd, self.tokenizer.encode_batch([" " + w for w in odd], add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words the cache lacks. Letters below U+0250 are always cut from a full stop or comma
        behind them, so that such a word needs no call where its letters are known."""
        ended = [w for w in words if len(w) > 1 and w[-1] in ".," and _LETTERS.fullmatch(w, 0, len(w) - 1)]
        rest = dict.fromkeys([*set(words).difference(ended), *(w[:-1] for w in ended)])
        for word, ids in self._learnt([w for w in rest if w not in self.known]):
            self._keep(word, ids)
        for w in ended:
            self._keep(w, self.known[w[:-1]] + self.marks[w[-1]])

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        # A very long word is kept for this slice only.
        self.held += KNOWN_BYTES if len(word) > LONG_WORD else len(ids) + 2 * len(word) + 160

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            found = self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)
            return [np.array(e.ids, np.int64) for e in found]
        cut = [self._cut(t) for t in texts]
        words = set().union(*cut)
        if self.held > KNOWN_BYTES:  # of the words kept, those of this slice stay
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.held = sum(len(ids) + 2 * len(w) + 160 for w, ids in self.known.items())
        self._learn(list(words.difference(self.known)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<u4").astype(np.int64) for own in cut]


class PieceBpe(Side):
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                          for p in pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


_SIDES: dict[str, Side] = {}


def side_of(kind: type[Side], path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = kind(path)
    return _SIDES[path]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, heads: np.ndarray, stops: np.ndarray, lane_bytes: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) that end together, ascending.

    ``end_a`` and ``end_b`` are ascending byte ends over all documents, which span
    ``heads[d]`` to ``stops[d]`` on both sides.
    """
    lanes = -(-(stops - heads) // lane_bytes)
    of = np.repeat(np.arange(len(heads)), lanes)
    low = heads[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane_bytes
    high = np.minimum(low + lane_bytes, stops[of])
    a, b = np.searchsorted(end_a, low, "right"), np.searchsorted(end_b, low, "right")
    last = np.iinfo(np.int64).max
    end_a, end_b = np.append(end_a, last), np.append(end_b, last)
    cuts_a, cuts_b = [], []
    while len(a):
        at_a, at_b = end_a[a], end_b[b]
        live = np.maximum(at_a, at_b) <= high
        if not live.all():
            a, b, high, at_a, at_b = a[live], b[live], high[live], at_a[live], at_b[live]
        both = at_a == at_b
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
    if not cuts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def group_links(doc: np.ndarray, ids_a, ids_b, cut_a, cut_b, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, links) with every document's distinct pairs once, ascending.

    ``doc`` is the document of each group; a pair is ``a * size_b + b``.
    """
    first_a, first_b = np.concatenate([[0], cut_a[:-1] + 1]), np.concatenate([[0], cut_b[:-1] + 1])
    n_a, n_b = cut_a + 1 - first_a, cut_b + 1 - first_b
    links = n_a * n_b
    keys, times = [], []
    span = size_a * size_b

    def keep(key, n):
        if n is None:
            key, n = np.unique(key, return_counts=True)
        else:
            key, place = np.unique(key, return_inverse=True)
            n = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)
        keys.append(key)
        times.append(n)

    small = np.flatnonzero(links <= PAIRED_WHOLE)
    ends = np.cumsum(links[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LINKS_AT_ONCE, "right")))
        g = small[lo:hi]
        of = np.repeat(np.arange(len(g)), links[g])
        place = np.arange(len(of)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
        a, b = ids_a[first_a[g][of] + place // n_b[g][of]], ids_b[first_b[g][of] + place % n_b[g][of]]
        keep(doc[g][of] * span + a * size_b + b, None)
        lo = hi
    for g in np.flatnonzero(links > PAIRED_WHOLE).tolist():
        a, times_a = np.unique(ids_a[first_a[g]: cut_a[g] + 1], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g]: cut_b[g] + 1], return_counts=True)
        keep(doc[g] * span + (a[:, None] * size_b + b).ravel(), np.outer(times_a, times_b).ravel())
    if len(keys) > 1:
        whole, n = np.concatenate(keys), np.concatenate(times)
        keys, times = [], []
        keep(whole, n)
    return (keys[0] // span, keys[0] % span, times[0]) if keys else (np.zeros(0, np.int64),) * 3


def _written_out(a: Side, b: Side, ids_a, ids_b, cut_a, cut_b, group_doc, n_docs: int) -> list[str]:
    """SHA-256 of each document's groups as text; ids are laid out by table rows."""
    n = len(ids_a) + len(ids_b)
    width = max(a.digits.shape[1], b.digits.shape[1])
    rows, length = np.zeros((n, width), np.uint8), np.empty(n, np.int64)
    # An A token follows the B tokens of earlier groups, a B token the A tokens up to its own group.
    at_a = np.arange(len(ids_a)) + np.repeat(np.concatenate([[0], cut_b[:-1] + 1]), np.diff(cut_a, prepend=-1))
    at_b = np.arange(len(ids_b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))
    for side, ids, at in ((a, ids_a, at_a), (b, ids_b, at_b)):
        rows[at, : side.digits.shape[1]] = side.digits[ids]
        length[at] = side.width[ids]
    mark = np.full(n, ord(","), np.uint8)
    mark[at_a[cut_a]] = ord("|")
    mark[at_b[cut_b]] = ord(";")
    rows[np.arange(n), length] = mark
    flat = rows[np.arange(width) <= length[:, None]]
    ends = np.cumsum(length + 1)
    last = np.flatnonzero(np.diff(group_doc, append=-1))  # a document's last group
    stops = dict(zip(group_doc[last].tolist(), ends[at_b[cut_b[last]]].tolist(), strict=True))
    out, lo, raw = [], 0, memoryview(flat)
    for d in range(n_docs):
        hi = stops.get(d)
        out.append("" if hi is None else hashlib.sha256(raw[lo: hi - 1]).hexdigest())
        lo = lo if hi is None else hi
    return out


def align(texts: list[str], a: Side, b: Side, lane_bytes: int = LANE_BYTES) -> dict:
    """Counts and digest of each text, and the slice's id pairs by document."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    found_a, found_b = a.encode(texts), b.encode(texts)
    sizes = [(len(x), len(y)) for x, y in zip(found_a, found_b, strict=True)]
    flat = [np.concatenate(found) if found else np.zeros(0, np.int64) for found in (found_a, found_b)]
    del found_a, found_b
    # Documents that both sides spell exactly; the others lose their tokens.
    spans, good = [], np.array([len(r) > 0 for r in raw])
    want = np.frombuffer(b"".join(b" " + r for r in raw), np.uint8)
    long = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(long)
    for side, ids, k in ((a, flat[0], 0), (b, flat[1], 1)):
        count = np.array([s[k] for s in sizes], np.int64)
        stop = np.cumsum(count)
        own = np.add.reduceat(np.append(side.lengths[ids], 0), stop - count) * (count > 0) if n else np.zeros(0, np.int64)
        good &= own == long
        spans.append((count, stop))
    if good.any():
        keep = [np.repeat(good, count) for count, _ in spans]
        flat = [ids[k] for ids, k in zip(flat, keep, strict=True)]
        own = want[np.repeat(good, long)]
        short = long[good]
        heads = np.cumsum(short) - short
        off = np.zeros(len(own), bool)
        for side, ids in zip((a, b), flat, strict=True):
            off |= side.spelled(ids) != own
        if off.any():
            wrong = np.add.reduceat(off, heads) > 0
            stay = np.flatnonzero(good)
            which = [np.repeat(~wrong, spans[k][0][stay]) for k in (0, 1)]
            flat = [ids[w] for ids, w in zip(flat, which, strict=True)]
            good[stay[wrong]] = False
    else:
        flat = [ids[:0] for ids in flat]
    ids_a, ids_b = flat
    places = np.flatnonzero(good)
    short = long[good]
    stops = np.cumsum(short)
    cut_a, cut_b = lockstep(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), stops - short, stops, lane_bytes)
    counts = np.zeros((4, n), np.int64)
    if not len(places):
        none = np.zeros(0, np.int64)
        return {"counts": counts, "sha": [""] * n, "doc": none, "pair": none, "times": none}
    tokens_a = spans[0][0][places]
    group_doc = places[np.searchsorted(np.cumsum(tokens_a), cut_a, "right")]
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    counts[0, places], counts[1, places] = tokens_a, spans[1][0][places]
    counts[2] = np.bincount(group_doc, minlength=n)
    np.add.at(counts[3], group_doc, size_a * size_b)
    doc, pair, times = group_links(group_doc, ids_a, ids_b, cut_a, cut_b, a.size, b.size)
    return {"counts": counts, "sha": _written_out(a, b, ids_a, ids_b, cut_a, cut_b, group_doc, n), "doc": doc, "pair": pair, "times": times}


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a slice: counts and digests of its documents, its distinct pairs and who holds them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["slice", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "n_pairs", "pairs", "holders", "held", "places", "times"]

    def cut(batches):
        a, b = side_of(ByteBpe, path_a), side_of(PieceBpe, path_b)
        base, seq = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", SLICE_BYTES):
            got = align(batch.column(1).to_pylist(), a, b)
            spread, place = np.unique(mixed(got["pair"].astype(np.uint64)), return_inverse=True)
            held = np.bincount(got["doc"], minlength=batch.num_rows)
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + seq]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                 *(pa.array([c.tolist()], long) for c in got["counts"]), pa.array([got["sha"]], pa.list_(pa.string())), pa.array([len(spread)]),
                 *(pa.array([x], pa.binary()) for x in (
                     pack_sorted(spread), pack_counts(np.bincount(place, minlength=len(spread))), pack_counts(held),
                     pack_counts(place), pack_counts(got["times"])))], names)
            seq += 1

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return map_arrow(rows, cut, f"slice long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
                     "sha array<string>, n_pairs long, pairs binary, holders binary, held binary, places binary, times binary")


def _messages(cut: DataFrame, parts: int) -> DataFrame:
    def send(batches):
        for batch in batches:
            for name, pairs, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spread, n = unpack_sorted(pairs), unpack_counts(holders)
                out = [(part, name, pack_sorted(spread[lo:hi]), pack_counts(n[lo:hi])) for part, lo, hi in cut_by_part(spread, parts)]
                if out:
                    part, own, keys, n = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own, pa.int64()), pa.array(keys, pa.binary()),
                                                      pa.array(n, pa.binary())], ["part", "slice", "keys", "counts"])

    return map_arrow(cut.select("slice", "pairs", "holders"), send, "part long, slice long, keys binary, counts binary")


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document row.

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentencepiece model. A pair's count is
    the number of documents that hold it linked; ``n_best`` counts links whose pair has the
    highest count of its A id, ``count_sum`` adds the counts over links.
    """
    spark = docs.sparkSession
    ship_package(spark)
    cut = written(_aligned(docs, path_a, path_b), "align-slices", codec="uncompressed")
    parts = part_count(cut.agg(F.sum("n_pairs")).first()[0] or 0)
    size_b = int(PieceBpe(path_b).size)
    size_a = int(ByteBpe(path_a).size)

    def tally(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        distinct, total, place = summed(keys, [unpack_counts(r["counts"]) for r in rows])
        best = np.zeros(size_a, np.int64)
        np.maximum.at(best, (unmixed(distinct) // np.uint64(size_b)).astype(np.int64), total)
        seen = np.flatnonzero(best)
        out = [(rows[0]["part"], None, None, seen.tolist(), best[seen].tolist())]
        at = 0
        for r, k in zip(rows, keys, strict=True):
            out.append((r["part"], r["slice"], pack_counts(total[place[at: at + len(k)]]), None, None))
            at += len(k)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                    ["part", "slice", "counts", "ids", "best"])

    told = written(_messages(cut, parts).groupBy("part").applyInArrow(
        tally, "part long, slice long, counts binary, ids array<long>, best array<long>"), "align-tally", codec="uncompressed")
    highest = np.zeros(size_a, np.int64)
    per_id = (told.where("ids is not null").select(F.explode(F.arrays_zip("ids", "best")).alias("x"))
              .groupBy("x.ids").agg(F.max("x.best").alias("best")))
    for r in per_id.collect():  # one row an id of A's vocabulary
        highest[r["ids"]] = r["best"]
    sent = spark.sparkContext.broadcast(highest)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        row = one.to_pylist()[0]
        spread = unpack_sorted(row["pairs"])
        parts_told = sorted(zip(other.column("part").to_pylist(), other.column("counts").to_pylist(), strict=True))
        total = np.concatenate([unpack_counts(c) for _, c in parts_told]) if parts_told else np.zeros(0, np.int64)
        best = total == sent.value[(unmixed(spread) // np.uint64(size_b)).astype(np.int64)]
        held, place, times = unpack_counts(row["held"]), unpack_counts(row["places"]), unpack_counts(row["times"])
        doc = np.repeat(np.arange(len(held)), held)
        n_best, count_sum = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        np.add.at(n_best, doc, times * best[place])
        np.add.at(count_sum, doc, times * total[place])
        return pa.Table.from_arrays(
            [one.column("doc_ids").chunk(0).flatten(), *(pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")),
             pa.array(n_best), pa.array(count_sum), pa.array(row["sha"])],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    counts = told.where("ids is null").select("slice", "part", "counts")
    return cut.drop("holders", "n_pairs").groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(
        score, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
