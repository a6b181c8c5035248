"""N-gram Jaccard join by parity sketches, and its connected components.

A text's set is its distinct word shingles, as 64-bit hashes. Texts with one set are one
class; only classes are joined.

Sketch: each shingle flips one bit of a wide (virtual, 2^64) bit sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. The sketch is
cut into segments by hash; a segment is kept as the XOR of its set bits' numbers. A pair
whose similarity reaches the threshold and whose larger set has at most U shingles has a
symmetric difference of at most D = floor((1-t)/(1+t) * 2U), so with more than D segments
one is equal in both (pigeonhole). Sizes fall in bands with one U each; a class enters its
own band and, where a partner can be that large, the next one.

What keeps equal segments rare among unlike texts, without losing a pair:

* A set linked with another shares at least the threshold's part of its shingles, so a set
  with too many shingles that occur nowhere else makes no sketch. A bitmap of the shingles
  that repeat tells (it may overlook some that do not, which only weakens the test).
* There are about twice as many segments as needed. Of its K segments a class has at most
  D unlike its partner's, so any D+1 hold a common one; ordered by how many classes have a
  segment, the rarest common segment is among the D+1 rarest of both. Only these stay;
  segments found in one class alone come first, so a class with more than D of them leaves.
* Empty segments say nothing: a class with more than D non-empty ones has a sketch of these
  alone. A class with at most D ("thin") has one of all its segments, in which empty ones
  count; so has, beside its other one, each class that may be linked with a thin one. The
  shingles common with a thin partner lie in at most D segments, so only a class whose D
  fullest segments hold the threshold's part of its shingles may, in bands with thin classes.

Equal segments become links to one pivot a segment (the smallest class), never all pairs;
a batch of texts first links its own repeats, so a segment that a third of all texts
share sends one row a batch. Links are verified on the full sets in three rounds:

1. each class against the pivot with which it shares most segments;
2. the remaining pivot links between different components;
3. inside segments whose classes are still in different components, the pairs across
   components that no bound excludes: the Hamming distance of their bit sketches (now of
   fixed width), the numbers of shingles found nowhere else, and the triangle inequality
   over the verified pivot distances.

After that every pair with an equal segment is verified, excluded, or already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, release, slices, text_or_empty, utf8_bytes, written
from decantry.llm.components import components
from decantry.llm.repeats import is_repeated, packed, repeated_bits, sizes, with_known
from decantry.llm.textwords import SPACED, mixed, words

SHINGLE = 4
NEED, OF = 85, 100  # linked: OF * intersection >= NEED * union
SLICE_BYTES = 6 << 20
BAND_RATIO = 1.5
SPARE = 2.0  # times the segments that the pigeonhole needs
GROUPS = 64  # parts that a key many classes have is dealt over
SKETCH_WORDS = 8
FIRST_KEYS = 32  # of a class, by which a pair is told apart from its other meetings
PART = 1 << 17  # shingles that are dealt to segments at a time when only loads are wanted
PER_GROUP = 2000  # members verified together against one pivot

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# --- sets ---------------------------------------------------------------------------------

def shingle_sets(data: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending, one after the other; borders)."""
    h, _, _, first = words(data, ends, SPACED)
    count = np.diff(first)
    n = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    border = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    begin = first[:-1][text] + np.arange(len(text)) - border[:-1][text]
    out = np.full(len(begin), shingle, np.uint64)
    last = max(0, len(h) - 1)
    for k in range(shingle):
        out = out * _A + h[np.minimum(begin + k, last)] * _B
    for t in np.flatnonzero((count > 0) & (count < shingle)).tolist():  # the whole sequence is one
        value = np.full(1, count[t], np.uint64)
        for k in range(count[t]):
            value = value * _A + h[first[t] + k: first[t] + k + 1] * _B
        out[border[t]] = value[0]
    out = mixed(out)
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[border[:-1][n > 0]] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], counts[border]


def class_ids(tokens: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set (0 for the empty set): equal sets, equal names."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens * _B + _A))])
    n = np.diff(border)
    name = mixed(sums[border[1:]] - sums[border[:-1]] + n.astype(np.uint64) * _A) >> np.uint64(1)
    return np.where(n > 0, name, 0).astype(np.int64)


# --- sketches -----------------------------------------------------------------------------

class Bands:
    """Size bands and their segment counts for sets of up to ``most`` shingles."""

    def __init__(self, most: int, need: int = NEED, of: int = OF):
        lows = [1]
        while lows[-1] <= most * of // need + 1:
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND_RATIO)))
        self.low = np.array(lows, np.int64)
        up = np.append(self.low[1:] - 1, self.low[-1] * 2)
        self.differ = (of - need) * 2 * up // (of + need)
        self.segments = np.where(self.differ > 0, np.ceil((self.differ + 1) * SPARE).astype(np.int64), 1)
        self.need, self.of = need, of

    def jobs(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) of each sketch to make; empty sets make none."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        ids = np.flatnonzero(sizes > 0)
        all_ids, all_bands = [ids], [own[ids]]
        k = 1
        while True:  # bands whose smallest set can still reach the threshold with this one
            nxt = own[ids] + k
            ok = nxt < len(self.low)
            ok[ok] = sizes[ids[ok]] * self.of >= self.low[nxt[ok]] * self.need
            if not ok.any():
                return np.concatenate(all_ids), np.concatenate(all_bands)
            ids = ids[ok]
            all_ids.append(ids)
            all_bands.append(nxt[ok])
            k += 1


def _dealt(tokens: np.ndarray, border: np.ndarray, sets: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shingles of all jobs, their segments' places among all jobs' segments, and each segment's load."""
    size = np.diff(border)[sets]
    job = np.repeat(np.arange(len(sets)), size)
    own = tokens[border[sets[job]] + np.arange(len(job)) - np.repeat(np.cumsum(size) - size, size)]
    off = np.concatenate([[0], np.cumsum(count)])
    where = mixed(own ^ (band[job].astype(np.uint64) + np.uint64(1)) * _A) >> np.uint64(32)
    at = off[:-1][job] + (where * count[job].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    return own, at, np.bincount(at, minlength=off[-1])


def thin_bands(tokens: np.ndarray, border: np.ndarray, bands: Bands) -> np.ndarray:
    """For each set the bands in which its sketch is thin, a bit a band."""
    all_sets, all_bands = bands.jobs(np.diff(border))
    out = np.zeros(len(border) - 1, np.int64)
    part = np.cumsum(np.diff(border)[all_sets]) // PART  # a few jobs at a time, for memory
    for jobs in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
        sets, band = all_sets[jobs], all_bands[jobs]
        count = bands.segments[band]
        _, _, load = _dealt(tokens, border, sets, band, count)
        made = np.bincount(np.repeat(np.arange(len(sets)), count)[load > 0], minlength=len(sets))
        thin = made <= bands.differ[band]
        np.bitwise_or.at(out, sets[thin], np.int64(1) << band[thin])
    return out


def sketch_keys(tokens: np.ndarray, border: np.ndarray, bands: Bands, thin_in: int = -1) -> tuple[np.ndarray, ...]:
    """(set, key, sketch, spare): the sets that must meet, by equal keys.

    ``sketch`` is twice the band, and one more for the sketch of all segments. A set's keys
    of one sketch have at most ``K - spare - 1`` that a partner lacks, K being their number.
    ``thin_in`` has a bit for each band in which some set's sketch is thin.
    """
    sets, band = bands.jobs(np.diff(border))
    none = np.zeros(0, np.int64)
    if not len(sets):
        return none, none.astype(np.uint64), none, none
    need, count = bands.differ[band] + 1, bands.segments[band]
    own, at, load = _dealt(tokens, border, sets, band, count)
    w = np.zeros(len(load), np.uint64)
    np.bitwise_xor.at(w, at, own)
    del own, at
    owner = np.repeat(np.arange(len(sets)), count)
    seg = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    made = np.bincount(owner[load > 0], minlength=len(sets))
    thin = made < need
    may = np.flatnonzero(thin | (np.int64(thin_in) >> band & 1 > 0))  # jobs that may meet a thin sketch
    open_ = np.flatnonzero(np.isin(owner, may))
    order = open_[np.lexsort((-load[open_], owner[open_]))]
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count[may]) - count[may], count[may])
    top = np.bincount(owner[order], weights=np.where(rank < need[owner[order]] - 1, load[order], 0), minlength=len(sets))
    whole = np.zeros(len(sets), bool)
    whole[may] = thin[may] | (top[may] * bands.of >= np.diff(border)[sets[may]] * bands.need)

    def keys(kept: np.ndarray, kind: int, k: np.ndarray) -> tuple[np.ndarray, ...]:
        o = owner[kept]
        sketch = 2 * band[o] + kind
        key = mixed(w[kept] * _A + seg[kept].astype(np.uint64) * _B + sketch.astype(np.uint64))
        return sets[o], key, sketch, (k - need)[o]

    parts = zip(keys((load > 0) & ~thin[owner], 0, made), keys(whole[owner], 1, count), strict=True)
    return tuple(np.concatenate(p) for p in parts)


# --- passes over the texts ------------------------------------------------------------------

def _sets(docs: DataFrame, shingle: int, need: int, of: int) -> DataFrame:
    """``id, class, n, thin`` of each row; ``thin`` as by ``thin_bands``."""
    def scan(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            data, ends = utf8_bytes(batch.column(1))
            tokens, border = shingle_sets(data, ends, shingle)
            n = np.diff(border).astype(np.int64)
            thin = thin_bands(tokens, border, Bands(int(n.max(initial=0)), need, of))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(class_ids(tokens, border)), pa.array(n), pa.array(thin)],
                                             ["id", "class", "n", "thin"])

    return map_arrow(docs, scan, f"id {docs.schema['id'].dataType.simpleString()}, class long, n long, thin long")


def _distinct_sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, borders, class) of the distinct sets of a slice whose first column is the text."""
    data, ends = utf8_bytes(batch.column(0))
    tokens, border = shingle_sets(data, ends, shingle)
    name = class_ids(tokens, border)
    _, once = np.unique(name, return_index=True)
    once.sort()
    n = np.diff(border)
    own = np.zeros(len(name), bool)
    own[once] = True
    return tokens[np.repeat(own, n)], np.concatenate([[0], np.cumsum(n[once])]), name[once]


def _repeated_shingles(docs: DataFrame, total: int, shingle: int) -> tuple[np.ndarray, int]:
    index_bits, bucket_bits = sizes(total, 2)

    def gather(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            tokens, _, _ = _distinct_sets(batch, shingle)
            yield packed(mixed(tokens), bucket_bits)

    return repeated_bits(docs.select("text"), gather, index_bits, bucket_bits), index_bits


def _keys(docs: DataFrame, bands: Bands, thin_in: int, bits: np.ndarray, index_bits: int, shingle: int) -> DataFrame:
    """``key, class, head, many, sketch`` of each distinct class of a slice: ``head`` is true once a
    key and slice, ``many`` where the slice has several classes of the key; ``sketch`` is
    the number of shingles found nowhere else, ``spare`` (24 bits) and twice the band plus the kind (8 bits)."""
    sent = docs.sparkSession.sparkContext.broadcast((bands, bits))

    def scan(batches):
        own_bands, own_bits = sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            tokens, border, name = _distinct_sets(batch, shingle)
            n = np.diff(border)
            sums = np.concatenate([[0], np.cumsum(~is_repeated(mixed(tokens), own_bits, index_bits))])
            alone = sums[border[1:]] - sums[border[:-1]]
            can = alone * own_bands.of <= (own_bands.of - own_bands.need) * n
            tokens, name = tokens[np.repeat(can, n)], name[can]
            sets, key, band, spare = sketch_keys(tokens, np.concatenate([[0], np.cumsum(n[can])]), own_bands, thin_in)
            cls = name[sets]
            order = np.lexsort((cls, key))
            key, cls = key[order].view(np.int64), cls[order]
            sketch = (alone[can][sets] << 32 | spare << 8 | band)[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            many = ~head
            many[:-1] |= ~head[1:]
            for a in range(0, len(key), 100_000):
                z = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(cls[z]), pa.array(head[z]), pa.array(many[z]), pa.array(sketch[z])],
                                                 ["key", "class", "head", "many", "sketch"])

    return map_arrow(docs.select("text"), scan, "key long, class long, head boolean, many boolean, sketch long")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` on its ``first_id``; other texts are not shuffled."""
    known = with_known(docs.withColumn("h", F.xxhash64("id")), wanted.select(F.xxhash64("first_id").alias("h"))).where("known")
    return known.join(wanted, known["id"].eqNullSafe(wanted["first_id"]))


# --- verification ---------------------------------------------------------------------------

def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``pivot, class, inter, n_pivot, n_class`` of each pair, from the full sets.

    The texts of the classes concerned are read again; each class's set travels once to
    each of its pivots, and a pivot with many classes is copied to groups of ``PER_GROUP``.
    """
    groups = pairs.groupBy("pivot").agg(F.count("*").alias("members"))
    many = F.ceil(F.col("members") / PER_GROUP).cast("int")
    to_pivot = (pairs.join(groups, "pivot")
                .select("class", "pivot", F.pmod(F.hash("class"), many).alias("salt"), F.lit(1).alias("part")))
    selves = groups.select(F.col("pivot").alias("class"), "pivot",
                           F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), F.lit(0).alias("part"))
    sends = written(to_pivot.union(selves).groupBy("class")
                    .agg(F.collect_list(F.struct("pivot", "salt", "part")).alias("to"))
                    .join(classes.select("class", "first_id"), "class"), "sends")
    texts = _texts_of(docs, sends).select("text", "class", "to")

    def scan(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            data, ends = utf8_bytes(batch.column(0))
            tokens, border = shingle_sets(data, ends, shingle)
            name = class_ids(tokens, border)
            # Other rows under the same id, and copies of the row, are not wanted.
            ok = np.flatnonzero(name == batch.column(1).to_numpy(zero_copy_only=False))
            to = batch.column(2).to_pylist()
            rows = [(t["pivot"], t["salt"], t["part"], int(name[i]), tokens[border[i]: border[i + 1]].tobytes())
                    for i in ok.tolist() for t in to[i]]
            for a in range(0, len(rows), 500):
                part = rows[a: a + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in part], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    ["pivot", "salt", "part", "class", "set"])

    sent = (map_arrow(texts, scan, "pivot long, salt int, part int, class long, set binary")
            .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "part", "class"))

    def compare(batches):
        at, own, last = None, None, None
        for batch in batches:
            out = []
            for pivot, salt, part, cls, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, salt) != at:
                    at, own, last = (pivot, salt), np.frombuffer(raw, np.uint64), None
                if part == 0 or cls == last:  # the pivot itself, or a repeated row
                    continue
                last = cls
                other = np.frombuffer(raw, np.uint64)
                k = np.searchsorted(own, other)
                k[k == len(own)] = 0
                out.append((pivot, cls, int((own[k] == other).sum()), len(own), len(other)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)],
                                             ["pivot", "class", "inter", "n_pivot", "n_class"])

    return written(map_arrow(sent, compare, "pivot long, class long, inter long, n_pivot long, n_class long"), "verified")


def _links(verified: DataFrame, need: int, of: int) -> DataFrame:
    union = F.col("n_pivot") + F.col("n_class") - F.col("inter")
    return verified.where(of * F.col("inter") >= need * union).select(F.col("pivot").alias("u"), F.col("class").alias("v"))


def _rooted(frame: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return frame.join(r, column, "left").withColumn(name, F.coalesce(name, column))


# --- the join ---------------------------------------------------------------------------------

def ngram_join(docs: DataFrame, shingle: int = SHINGLE, need: int = NEED, of: int = OF) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, class, component_id``.

    Two texts are linked when ``of * intersection >= need * union`` of their sets of
    distinct ``shingle``-word shingles (A-Z as a-z; words are split at ASCII white space; a
    text of fewer words is one shingle). ``component_id`` is the smallest ``doc_id``
    reachable by links. ``class`` names the set: equal sets share it (64-bit hash).

    Null, empty and blank texts have ``n_shingles`` 0, class 0 and link with nothing, not
    even with each other: ``component_id`` is their own id. A null ``doc_id`` is never the
    smallest; it is given back only where a component has no other. Repeated rows and rows
    that share an id are rows of their own. An empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty().cast("binary").alias("text"))
    meta = written(_sets(rows, shingle, need, of), "sets")
    classes = (meta.where("n > 0").groupBy("class")
               .agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("thin").alias("thin")))
    classes = written(classes, "classes")
    largest = classes.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.bit_or("thin").alias("thin")).first()
    bits, index_bits = _repeated_shingles(rows, largest["total"] or 0, shingle)
    keys = _keys(rows, Bands(largest["most"] or 0, need, of), largest["thin"] or 0, bits, index_bits, shingle)
    roots = _linked_classes(keys, rows, classes, shingle, need, of)
    named = _rooted(meta.select("id", "class", "n"), "class", roots, "component")
    least = named.where("n > 0").groupBy("component").agg(F.min("id").alias("least_id"))
    return (named.join(least, "component", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class",
                    F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("id")).alias("component_id")))


def _rarest(keys: DataFrame) -> DataFrame:
    """``key, class, alone``: of each sketch the keys of several classes that it needs, rarest first.

    A key's rank is the number of slices that have it. Slices send one head row a key, and
    only heads meet under the key; the other rows join the keys' counts.
    """
    spread = F.when(F.col("head"), 0).otherwise(1 + F.pmod(F.hash("class"), F.lit(GROUPS)))
    by_key = Window.partitionBy("key", "spread")
    rows = keys.withColumn("spread", spread).withColumn("often", F.count("*").over(by_key))
    rows = written(rows.where(~F.col("head") | F.col("many") | (F.col("often") > 1)).drop("spread"), "keys")
    heads = rows.where("head")
    counts = heads.where("many").groupBy("key").agg(F.max("often").alias("often"))
    others = rows.where("not head").drop("often").join(counts, "key")
    names = ["key", "class", "sketch", "often"]
    by_sketch = Window.partitionBy("class", "band")
    return (heads.select(names).union(others.select(names))
            .withColumn("band", F.expr("sketch & 255")).repartition("class", "band")
            .groupBy("class", "band", "key").agg(F.first("sketch").alias("sketch"), F.first("often").alias("often"))
            .withColumn("place", F.row_number().over(by_sketch.orderBy("often", "key")))
            .withColumn("keys", F.count("*").over(by_sketch))
            .where(F.col("place") <= F.col("keys") - F.expr("sketch >> 8 & 16777215"))
            .select("key", "class", F.expr("sketch >> 32").alias("alone")))


def _starred(met: DataFrame) -> DataFrame:
    """``key, class, alone, via, pivot``: the smallest class of the key (``pivot``), by way of the
    smallest of one of ``GROUPS`` parts of the key's classes (``via``)."""
    part = met.withColumn("part", F.pmod(F.hash("class"), F.lit(GROUPS)))
    part = part.withColumn("via", F.first("class").over(Window.partitionBy("key", "part").orderBy("class")))
    tops = part.where("class = via").withColumn("pivot", F.first("class").over(Window.partitionBy("key").orderBy("class")))
    tops = tops.select("key", "part", "pivot")
    return part.join(tops, ["key", "part"]).select("key", "class", "alone", "via", "pivot")


def _linked_classes(keys: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, need: int, of: int) -> DataFrame:
    """``node, root``: classes that hang on another class of their component."""
    spark = keys.sparkSession
    met = written(_starred(_rarest(keys)), "met")
    release(spark)
    star = (met.select(F.col("via").alias("pivot"), "class").union(met.where("class = via").select("pivot", "class"))
            .where("pivot <> class").groupBy("pivot", "class").agg(F.count("*").alias("shared")))
    star = written(star, "star")

    best = star.groupBy("class").agg(F.max_by("pivot", F.struct("shared", F.negative("pivot"))).alias("pivot"))
    done = _verified(best.select("pivot", "class"), rows, classes, shingle)
    release(spark)
    links = _links(done, need, of)
    roots = written(components(links), "roots")

    def crossing(pairs: DataFrame) -> DataFrame:
        c = _rooted(_rooted(pairs, "pivot", roots, "pivot_root"), "class", roots, "class_root")
        return (c.where("pivot_root <> class_root").select("pivot", "class")
                .join(done.select("pivot", "class"), ["pivot", "class"], "left_anti"))

    second = written(crossing(star.select("pivot", "class")), "second")
    release(spark)
    if not second.isEmpty():
        more = _verified(second, rows, classes, shingle)
        done = written(done.union(more), "done")
        links = links.union(_links(more, need, of))
        roots = written(components(links), "roots")

    release(spark)
    third = written(_third_round(met, done, roots, rows, classes, shingle, need, of), "third")
    release(spark)
    if not third.isEmpty():
        links = links.union(_links(_verified(third, rows, classes, shingle), need, of))
        roots = written(components(links), "roots")
    return roots


def _bit_sketches(wanted: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``class, s0, s1, ...``: parity sketches of ``64 * SKETCH_WORDS`` bits; each shingle flips one."""
    ids = written(wanted.join(classes.select("class", "first_id"), "class"), "sketched")
    texts = _texts_of(docs, ids).select("text", "class")
    names = [f"s{k}" for k in range(SKETCH_WORDS)]

    def scan(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            data, ends = utf8_bytes(batch.column(0))
            tokens, border = shingle_sets(data, ends, shingle)
            name = class_ids(tokens, border)
            n = len(name)
            bits = 64 * SKETCH_WORDS
            bit = (mixed(tokens ^ _B) % np.uint64(bits)).astype(np.int64) + bits * np.repeat(np.arange(n), np.diff(border))
            sketch = np.packbits((np.bincount(bit, minlength=bits * n) & 1).astype(np.uint8)).view(np.int64).reshape(n, SKETCH_WORDS)
            ok = name == batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(name[ok]), *[pa.array(sketch[ok, k]) for k in range(SKETCH_WORDS)]], ["class", *names])

    return written(map_arrow(texts, scan, "class long, " + ", ".join(f"{k} long" for k in names)).dropDuplicates(["class"]), "bits")


def _third_round(met: DataFrame, done: DataFrame, roots: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int,
                 need: int, of: int) -> DataFrame:
    """Unverified pairs across components inside one key that no bound excludes."""
    far = 1.0 - need / of + 1e-9
    union = F.col("n_pivot") + F.col("n_class") - F.col("inter")
    distance = done.select("pivot", "class", (1 - F.col("inter") / union).alias("d")).dropDuplicates(["pivot", "class"])
    m = _rooted(met, "class", roots, "root")
    open_keys = m.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    m = m.join(open_keys, "key", "left_semi")
    d1 = distance.select(F.col("pivot").alias("via"), "class", F.col("d").alias("d1"))
    d2 = distance.select("pivot", F.col("class").alias("via"), F.col("d").alias("d2"))
    m = (m.join(d1, ["via", "class"], "left").join(d2, ["pivot", "via"], "left")
         .withColumn("d1", F.when(F.col("via") == F.col("class"), 0.0).otherwise(F.col("d1")))
         .withColumn("d2", F.when(F.col("via") == F.col("pivot"), 0.0).otherwise(F.col("d2"))))
    # Bounds of the distance to the key's pivot; unknown distances bound nothing.
    m = (m.withColumn("lo", F.coalesce(F.abs(F.col("d1") - F.col("d2")), F.lit(0.0)))
         .withColumn("hi", F.coalesce(F.col("d1") + F.col("d2"), F.lit(1.0)))
         .join(classes.select("class", "n"), "class").select("key", "class", "root", "n", (F.col("n") - F.col("alone")).alias("may"), "lo", "hi"))
    m = written(m, "open")
    if m.isEmpty():
        return m.select(F.col("class").alias("pivot"), "class")
    # A pair with many common keys comes out at the smallest of its classes' first ones.
    firsts = m.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("keys"))
    m = m.join(firsts, "class").join(_bit_sketches(m.select("class").distinct(), rows, classes, shingle), "class")
    x, y = m.alias("x"), m.alias("y")
    most = F.least("x.may", "y.may")  # of the intersection: shingles found nowhere else are in none
    hamming = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class"))
                   & (F.col("x.root") != F.col("y.root"))
                   & (of * most >= need * (F.col("x.n") + F.col("y.n") - most))
                   & (F.col("x.lo") <= F.col("y.hi") + far) & (F.col("y.lo") <= F.col("x.hi") + far)
                   & ((need + of) * hamming <= (of - need) * (F.col("x.n") + F.col("y.n")))
                   & F.coalesce(F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"), F.lit(True)))
    pairs = pairs.select(F.col("x.class").alias("pivot"), F.col("y.class").alias("class")).distinct()
    known = done.select(F.least("pivot", "class").alias("pivot"), F.greatest("pivot", "class").alias("class"))
    return pairs.join(known, ["pivot", "class"], "left_anti")
