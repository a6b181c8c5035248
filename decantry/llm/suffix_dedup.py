"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a ``length``-byte string that covers it also starts earlier in the corpus.

1. Anchors. Of each ``length``-byte string the smallest-hashed ``GRAM``-byte gram is its
   anchor; equal strings have equal anchors at the same offset. An anchor whose gram
   occurs once in the corpus owns only strings that occur once. Gram hashes are gathered
   by range in packed blocks; the repeated ones set bits of a filter of bounded size
   (a full filter lets more through, it never hides any).
2. Stretches. For anchors that pass, the bytes around them (all strings the anchor can
   own) go to the task of their gram. Equal stretches need one representative each; a
   later equal stretch loses all its strings at once.
3. Difference cover. The suffixes of a task's stretches are ordered by their first
   ``length`` bytes: positions 1 and 2 modulo 3 are the sample; their triples of 8-byte
   blocks are sorted and named; triples of names are sorted and named again, until a name
   stands for ``length - 1`` bytes; the remaining suffixes follow from their first byte
   and the name of the next position. Neighbours with equal prefixes are then the equal
   strings, and all but the first in the corpus mark a removal.
4. The marks of a document come together and its bytes are cut.

The sort is cut off at ``length`` bytes because longer agreement changes nothing, and it
runs over stretches with repeated anchors only; both leave the result exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import lean_workers, map_arrow, slices, text_or_empty, utf8_bytes, written
from decantry.llm.repeats import is_repeated, packed, repeated_bits, sizes, with_known
from decantry.llm.textwords import _powers, mixed

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # an anchor lies at most this far behind its string's start
WIDTH = REACH + LENGTH  # bytes of a stretch, anchor at REACH
PIECE = 1 << 18  # string starts handled at once
SLICE_BYTES = 1 << 19
CHUNK = 6000  # stretches sorted together
HOT = 200_000  # stretches of one gram that a task sorts; beyond, its strings are dealt out by digest
_LOW = np.uint64((1 << 20) - 1)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes from each place."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    n = len(data) - size + 1
    return mixed((sums[size:] - sums[:n]) * down[:n])


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each ``window`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= window:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = window - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray):
    """For texts ``data[ends[i]:ends[i+1]]`` (under 2^20 bytes in all): (place, gram hash, first
    start, last start, text) of each anchor and the run of string starts it owns."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none, none
    gram = _hashes(data, GRAM)
    least = _smallest((gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64), REACH + 1)
    place = (least & _LOW).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(place)), side="right") - 1
    starts = np.flatnonzero(np.arange(len(place)) + LENGTH <= ends[1:][text])
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none
    own = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[starts[1:]] != text[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    p = own[first]
    return p, gram[p], starts[first], starts[last], text[starts[first]]


def _pieces(batches, column: str):
    """(batch, row numbers, data, ends, base, from, to): short texts together, long ones in
    overlapping pieces. Only starts from ``from`` to below ``to`` of a long text's piece are
    its own; ``base`` is the piece's place in the text."""
    for batch in slices(batches, column, SLICE_BYTES):
        place = batch.schema.get_field_index(column)
        data, ends = utf8_bytes(batch.column(place))
        if len(data) <= (1 << 20) - 1:
            yield batch, np.arange(batch.num_rows), data, ends, 0, 0, len(data)
            continue
        for row in range(batch.num_rows):
            text = data[ends[row]: ends[row + 1]]
            for a in range(0, len(text), PIECE):
                lo, hi = max(0, a - REACH), min(len(text), a + PIECE + WIDTH)
                piece = text[lo:hi]
                yield batch, np.array([row]), piece, np.array([0, len(piece)]), lo, a - lo, min(a + PIECE, len(text)) - lo


def _clipped(found, low: int, high: int):
    """Only the owned starts from ``low`` to below ``high``."""
    p, g, a, b, t = found
    a, b = np.maximum(a, low), np.minimum(b, high - 1)
    ok = a <= b
    return p[ok], g[ok], a[ok], b[ok], t[ok]


# --- 1: grams that repeat -------------------------------------------------------------------

def repeat_filter(rows: DataFrame, index_bits: int, bucket_bits: int) -> np.ndarray:
    """The map of gram hashes that occur at least twice."""
    def gather(batches):
        for _, _, data, ends, _, low, high in _pieces(batches, "text"):
            yield packed(_clipped(anchors(data, ends), low, high)[1], bucket_bits)

    return repeated_bits(rows.select("text"), gather, index_bits, bucket_bits)


# --- 2: stretches -------------------------------------------------------------------------

_STRETCH = "gram long, doc long, tie int, place long, low int, high int, left int, bytes binary"
_FIELDS = ["gram", "doc", "tie", "place", "low", "high", "left", "bytes"]


def _stretches(rows: DataFrame, bits: np.ndarray, index_bits: int) -> DataFrame:
    """Rows with ``bytes``: a stretch to compare. Rows without: string starts from ``place + low``
    to ``place + high`` that are known to repeat earlier; their ``gram`` is any number."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def cut(batches):
        own_bits = sent.value
        for batch, numbers, data, ends, base, low, high in _pieces(batches, "text"):
            p, g, a, b, t = _clipped(anchors(data, ends), low, high)
            ok = is_repeated(g, own_bits, index_bits)
            p, g, a, b, t = p[ok], g[ok], a[ok], b[ok], t[ok]
            if not len(p):
                continue
            left = np.minimum(REACH, p - ends[t])
            right = np.minimum(LENGTH, ends[t + 1] - p)
            doc = batch.column(batch.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)[numbers][t]
            tie = batch.column(batch.schema.get_field_index("tie")).to_numpy(zero_copy_only=False)[numbers][t]
            place = p - ends[t] + base
            up, down = _powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            around = mixed((sums[p + right] - sums[p - left]) * down[p - left]) ^ (left * 512 + right).astype(np.uint64)
            # Equal stretches in this slice: the first stands for all, where it owns as much.
            order = np.lexsort((place, tie, doc, b - p, p - a, around, g))
            same = np.zeros(len(order), bool)
            x, y = order[1:], order[:-1]
            same[1:] = (g[x] == g[y]) & (around[x] == around[y]) & (a[x] - p[x] == a[y] - p[y]) & (b[x] - p[x] == b[y] - p[y])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            first = order[head]
            itself = (doc[order] == doc[first]) & (tie[order] == tie[first]) & (place[order] == place[first])
            rest = order[~same]
            # Known starts that follow one another are one row. It needs no task of its gram and goes anywhere,
            # so that a gram met everywhere is no load.
            known = np.sort(order[same & ~itself])
            new, end = np.ones(len(known), bool), np.ones(len(known), bool)
            new[1:] = (a[known[1:]] != b[known[:-1]] + 1) | (t[known[1:]] != t[known[:-1]])
            end[:-1] = new[1:]
            known, until = known[new], b[known[end]]
            run = a[known] - ends[t[known]] + base
            anywhere = mixed(doc[known].astype(np.int64).view(np.uint64) ^ run.astype(np.uint64))
            none = np.zeros(len(known), np.int64)
            raw = data.tobytes()
            both = [np.concatenate(x) for x in ((g[rest], anywhere), (doc[rest], doc[known]), (tie[rest], tie[known]), (place[rest], run),
                                                ((a - p)[rest], none), ((b - p)[rest], until - a[known]), (left[rest], none))]
            text = [raw[p[i] - left[i]: p[i] + right[i]] for i in rest.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[0].view(np.int64)), pa.array(both[1], pa.int64()), pa.array(both[2], pa.int32()), pa.array(both[3], pa.int64()),
                 *[pa.array(x, pa.int32()) for x in both[4:]], pa.array(text + [None] * len(known), pa.binary())], _FIELDS)

    return map_arrow(rows.select("doc", "tie", "text"), cut, _STRETCH)


# --- 3: difference cover --------------------------------------------------------------------

def _named(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each composite key (most significant first) among the distinct ones."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


def prefix_names(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Names of the ``LENGTH``-byte prefixes at the ``wanted`` (row, column) places of a matrix of bytes.

    ``wanted`` is a boolean matrix of the first columns; ``text`` may end before a prefix does
    and counts as zeros there. Places of one residue modulo 3 have comparable names: smaller
    name, smaller prefix; equal name, equal prefix. Other places get 0.
    """
    rows, columns = wanted.shape
    steps = (0, 24, 48, 72, 75)  # 3 blocks of 24 bytes, then 27 bytes as two that overlap
    span = columns + 1 + steps[-1]
    wide = np.zeros((rows, span + 24), np.uint8)
    wide[:, : text.shape[1]] = text[:, : span + 24]
    # The 8 bytes from each place as one number, without a copy.
    words = np.ndarray((max(0, wide.size - 7),), ">u8", wide, strides=(1,))
    need = np.zeros((rows, columns + 1), bool)  # sampled columns whose 99 bytes need a name
    need[:, :columns] = wanted
    need[:, 1:] |= wanted  # the suffix behind one of residue 0
    need[:, ::3] = False
    sample = np.zeros((rows, span), bool)
    for s in steps:
        sample[:, s: s + columns + 1] |= need
    at = np.flatnonzero(sample)
    del sample
    byte = at + at // span * 24
    names24 = np.zeros(rows * span, np.uint32)
    names24[at] = _named([words[byte + k].astype(np.uint64) for k in (0, 8, 16)])
    del at, byte
    place = np.flatnonzero(need)
    at = place + place // (columns + 1) * steps[-1]
    shift = np.uint64(21) if max(names24.max(initial=0), len(at)) < 1 << 21 else None

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        if shift is None:
            return _named(parts)
        return _named([parts[0] << shift << shift | parts[1] << shift | parts[2]])

    def of(k: int) -> np.ndarray:
        return names24[at + k].astype(np.uint64)

    names72 = joined([of(0), of(24), of(48)])
    names99 = np.zeros(rows * (columns + 1), np.uint64)
    names99[place] = joined([names72, of(72), of(75)])
    names99 = names99.reshape(rows, columns + 1)
    # 100 bytes: of the sample, 99 and the last byte; of the rest, the first byte and the next 99.
    out = np.zeros(wanted.shape, np.uint64)
    r, c = np.nonzero(wanted)
    in_sample = c % 3 != 0
    out[r[in_sample], c[in_sample]] = names99[r[in_sample], c[in_sample]] << np.uint64(8) | wide[r[in_sample], c[in_sample] + LENGTH - 1]
    r, c = r[~in_sample], c[~in_sample]
    out[r, c] = wide[r, c].astype(np.uint64) << np.uint64(48) | names99[r, c + 1]
    return out


def _matrix(raw: list[bytes], left: np.ndarray) -> np.ndarray:
    """The stretches as rows of ``WIDTH`` bytes, anchors at ``REACH``, zeros around."""
    text = np.zeros((len(raw), WIDTH), np.uint8)
    flat = text.reshape(-1)
    for a in range(0, len(raw), CHUNK):
        part = raw[a: a + CHUNK]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes)
        starts = np.arange(a, a + len(part)) * WIDTH + REACH - left[a: a + CHUNK]
        flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])] = np.frombuffer(b"".join(part), np.uint8)
    return text


def _bands(rows: int) -> list[tuple[int, int]]:
    """Ranges of columns, from multiples of 3, that hold for so many rows about as many places
    as all columns do for ``CHUNK`` rows."""
    step = max(3, (REACH + 1) * CHUNK // max(1, rows) // 3 * 3)
    return [(a, min(a + step, REACH + 1)) for a in range(0, REACH + 1, step)]


def _repeats(gram: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, raw: list[bytes],
             doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(stretch, start relative to the anchor plus ``REACH``) of strings that also start earlier, as a boolean matrix.

    Stretches come ordered by gram and place in the corpus. Equal strings of one gram start
    equally far from it, so many stretches are compared in some columns at a time.
    """
    text = _matrix(raw, left)
    group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
    late = np.zeros((len(raw), REACH + 1), bool)
    for a, z in _bands(len(raw)):
        rows = np.flatnonzero((REACH + low < z) & (REACH + high >= a))  # these own strings here
        if not len(rows):
            continue
        column = np.arange(a, z)
        wanted = (column >= REACH + low[rows, None]) & (column <= REACH + high[rows, None])
        names = prefix_names(text[rows, a: z + LENGTH], wanted)
        r, c = np.nonzero(wanted)
        key, r = names[r, c], rows[r]
        column = group[r] * (z - a) + c
        order = np.lexsort((key, column))  # stable: earlier stretches first
        r, c, key, column = r[order], c[order], key[order], column[order]
        same = np.zeros(len(r), bool)
        same[1:] = (key[1:] == key[:-1]) & (column[1:] == column[:-1])
        first = r[np.maximum.accumulate(np.where(same, 0, np.arange(len(r))))]
        same &= (doc[r] != doc[first]) | (tie[r] != tie[first]) | (place[r] != place[first])
        late[r[same], c[same] + a] = True
    return late


def _marks(stretches: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc, tie, first, last``: runs of string starts that repeat earlier.

    Where one gram has over ``hot`` different stretches, its strings are dealt out again by
    their own 128-bit digest and the first of each is found by a pre-aggregated minimum.
    """
    names = ["doc", "tie", "first", "last", "digest"]

    def batch_of(doc, tie, first, last, digest=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(tie, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
             pa.array(digest, pa.binary()) if digest is not None else pa.nulls(n, pa.binary())], names)

    def known(table: pa.Table):
        """What the slices found out already."""
        cols = [table.column(k).to_numpy() for k in ("doc", "tie", "place", "low", "high")]
        return batch_of(cols[0], cols[1], cols[2] + cols[3], cols[2] + cols[4])

    def sorted_out(table: pa.Table):
        cols = {k: table.column(k).to_numpy() for k in _FIELDS[:7]}
        g = cols["gram"]
        met = np.zeros(len(g), bool)  # grams met once here own nothing that repeats
        met[1:] = g[1:] == g[:-1]
        met[:-1] |= met[1:].copy()
        if not met.any():
            return batch_of(*[np.zeros(0, np.int64)] * 4)
        cols = {k: v[met] for k, v in cols.items()}
        raw = table.column("bytes").filter(pa.array(met)).to_pylist()
        late = _repeats(*[cols[k] for k in ("gram", "low", "high", "left")], raw, *[cols[k] for k in ("doc", "tie", "place")])
        edge = np.diff(late.view(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
        r, a = np.nonzero(edge == 1)
        z = np.nonzero(edge == -1)[1] - 1
        return batch_of(cols["doc"][r], cols["tie"][r], cols["place"][r] + a - REACH, cols["place"][r] + z - REACH)

    def dealt_out(table: pa.Table):
        for part in table.to_batches(max_chunksize=2000):
            out = []
            for row in part.to_pylist():
                for k in range(row["low"], row["high"] + 1):
                    at = row["left"] + k
                    out.append((row["doc"], row["tie"], row["place"] + k,
                                hashlib.blake2b(row["bytes"][at: at + LENGTH], digest_size=16).digest()))
            doc, tie, start, digest = zip(*out, strict=True)
            yield batch_of(doc, tie, start, start, digest)

    def compare(batches):
        hold: list[pa.RecordBatch] = []
        held, burning = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            blank = table.column("bytes").is_null()
            yield known(table.filter(blank))
            table = table.filter(pa.compute.invert(blank))
            if burning is not None:
                again = pa.compute.equal(table.column("gram"), burning)
                yield from dealt_out(table.filter(again))
                table = table.filter(pa.compute.invert(again))
            hold += table.to_batches()
            held += len(table)
            if held < 2 * CHUNK:
                continue
            table = pa.Table.from_batches(hold).combine_chunks()
            gram = table.column("gram").to_numpy()
            end = int(np.searchsorted(gram, gram[-1], side="left"))  # more of the last gram may come
            for a, z in _cuts(gram[:end]):
                yield sorted_out(table.slice(a, z - a))
            table = table.slice(end)
            if len(table) >= hot:
                burning = int(gram[-1])
                yield from dealt_out(table)
                table = table.slice(len(table))
            hold, held = table.to_batches(), len(table)
        if held:
            table = pa.Table.from_batches(hold).combine_chunks()
            for a, z in _cuts(table.column("gram").to_numpy()):
                yield sorted_out(table.slice(a, z - a))

    dealt = stretches.repartition("gram").sortWithinPartitions("gram", "doc", "tie", "place")
    found = written(map_arrow(dealt, compare, "doc long, tie int, first long, last long, digest binary"), "marks")
    again = found.where("digest is not null").select("digest", F.struct("doc", "tie", "first").alias("at"))
    least = again.groupBy("digest").agg(F.min("at").alias("least"))
    late = (again.join(least, "digest").where("at <> least")
            .select("at.doc", "at.tie", "at.first", F.col("at.first").alias("last")))
    return found.where("digest is null").drop("digest").union(late)


def _cuts(gram: np.ndarray):
    """Ranges of about ``CHUNK`` rows that end between grams."""
    at = 0
    while at < len(gram):
        end = min(len(gram), at + CHUNK)
        if end < len(gram):
            before = int(np.searchsorted(gram, gram[end], side="left"))
            end = before if before > at else int(np.searchsorted(gram, gram[end], side="right"))
        yield at, end
        at = end


# --- 4: cutting -----------------------------------------------------------------------------

def removed_spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings starting from ``first`` to ``last`` (pairwise)."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], last[order] + LENGTH
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(a)) - 1
    return list(zip(a[at].tolist(), reach[end].tolist(), strict=True))


@lean_workers()
def suffix_dedup(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, n_removed, kept_sha256`` and, if
    ``with_text``, ``kept`` (the remaining bytes).

    ``spans`` are the removed maximal byte runs ``[from, to)``. Strings never cross
    documents and are judged on the input. "Earlier" is a smaller ``doc_id`` (null first)
    or, in one text, a smaller place; rows of one ``doc_id`` with different texts are
    ordered by a hash of the text; rows that repeat id and text are one document and all
    come out with its result. Null texts count as empty; texts under ``LENGTH`` bytes lose
    nothing. An empty table gives no rows; other columns are ignored.
    """
    raw = text_or_empty().cast("binary")
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc"),
                       F.xxhash64(raw).bitwiseAND(0x7FFFFFFF).cast("int").alias("tie"), raw.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index_bits, bucket_bits = sizes(total // (REACH // 2), 8)
    bits = repeat_filter(rows, index_bits, bucket_bits)
    marks = _marks(_stretches(rows, bits, index_bits), hot)
    runs = written(marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    # Texts without a mark need no join.
    met = with_known(rows.withColumn("h", F.xxhash64("doc", "tie")), runs.select(F.xxhash64("doc", "tie").alias("h")))
    none = F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")
    joined = (met.where("known").join(runs, ["doc", "tie"], "left").select("doc_id", "text", "runs")
              .union(met.where("not known").select("doc_id", "text", none)))

    def cut(batches):
        for batch in slices(batches, "text", 4 << 20):
            data, ends = utf8_bytes(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            spans, sizes, removed, digest, kept = [], [], [], [], []
            for k, own in enumerate(batch.column(2).to_pylist()):
                text = view[ends[k]: ends[k + 1]]
                gone = removed_spans(np.array([x["first"] for x in own]), np.array([x["last"] for x in own])) if own else []
                parts, at = [], 0
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                sha = hashlib.sha256()
                for x in parts:
                    sha.update(x)
                spans.append([{"from": a, "to": b} for a, b in gone])
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in gone))
                digest.append(sha.hexdigest())
                if with_text:
                    kept.append(b"".join(parts))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "spans", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<`from`:long,`to`:long>>, n_removed long, kept_sha256 string"
    return map_arrow(joined, cut, schema + (", kept binary" if with_text else ""))
