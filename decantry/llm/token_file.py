"""Token ids of a corpus as a Huffman-coded file, and back.

The file is a folder with two Parquet tables, so that Spark's committer makes it whole or
not at all and lost tasks are repeated:

* ``codes``: one row; ``lengths`` (a byte an id, 0: not used), ``end_id``, ``stride``.
  The canonical codes follow from the lengths.
* ``blocks``: one row a block of whole documents, about ``BLOCK_IDS`` ids (a longer
  document is a block of its own): ``shard``, ``first_seq`` (order of blocks),
  ``doc_ids``, ``doc_sizes``, ``n_ids``, ``n_bits``, ``payload`` and ``checkpoints``
  (little-endian 32-bit bit offset of every ``stride``-th id). A block is decoded alone.

Shards are ranges of ``doc_id``; in a shard, documents are in ascending order.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decantry.llm import huffman
from decantry.llm.common import arrow_rows, map_arrow, scratch_path, slices, text_or_empty, utf8_bytes, written
from decantry.llm.textwords import SPACED

END_ID = 1
BLOCK_IDS = 1 << 17
CACHE_BYTES = 96 << 20  # words and ids that a worker keeps
WORD_BYTES = 150  # of Python objects a word beside its characters and ids
SLICE_BYTES = 4 << 20
BATCH_ROWS = 2000  # documents in one Arrow batch between the JVM and a worker


#: The rules of a tokenizer file that never joins text across white space and cuts
#: ASCII letters from what follows them.
SPLIT_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "post_processor": None}


#: Words of letters below U+0250, but for the one (U+0130) whose lower case is not letters alone.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[.,]?$"


class WordEncoder:
    """Ids of texts by the tokenizers library.

    Where the file's own rules say that no token crosses white space (``SPLIT_BY_WORD``), each
    distinct word goes through the library and its ids are laid out by numpy; letters below
    U+0250 with a full stop or comma behind them are looked up apart, in lower case, as the
    rules cut and fold them. Any other file encodes whole texts. Words are kept in a cache of at most
    ``cache_bytes`` (``CACHE_BYTES`` if not given), which lasts as long as the Python worker.
    """

    _kept: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = all(rules.get(k) == v for k, v in SPLIT_BY_WORD.items())
        self.kind = np.dtype(id_type(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)))
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.cache_bytes: int | None = None

    @classmethod
    def of(cls, path: str, cache_bytes: int | None = None) -> WordEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        cls._kept[path].cache_bytes = cache_bytes
        return cls._kept[path]

    @classmethod
    def forget(cls) -> None:
        """Give the worker's memory back."""
        cls._kept.clear()

    def _learn(self, words: list[str]) -> None:
        """Ids of words the cache lacks, as little-endian 32-bit integers."""
        for k in range(0, len(words), 1000):
            part = words[k: k + 1000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw = np.array(got.ids, self.kind).tobytes()
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            cuts = self.kind.itemsize * np.searchsorted([a for a, _ in got.offsets], np.concatenate([[0], ends[:-1]]))
            stops = [*cuts[1:].tolist(), len(raw)]
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, cuts.tolist(), stops, strict=True))
            self.held += len(raw) + int(ends[-1]) + WORD_BYTES * len(part)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words in turn, how many each has)."""
        # Plain letters are read in lower case and always cut from a full stop or comma behind them.
        plain = pc.match_substring_regex(words, PLAIN)
        dot, comma = pc.and_(plain, pc.ends_with(words, ".")), pc.and_(plain, pc.ends_with(words, ","))
        bases = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(words), ".,"), words).dictionary_encode()
        names = as_list(bases.dictionary)
        ids = list(map(self.known.get, names))
        new = [w for w, x in zip(names, ids, strict=True) if x is None]
        if new or "." not in self.known:
            self._learn(list(dict.fromkeys([*new, ".", ","])))
            ids = [self.known[w] if x is None else x for w, x in zip(names, ids, strict=True)]
        if self.held > (CACHE_BYTES if self.cache_bytes is None else self.cache_bytes):  # of the words kept, those of this slice stay
            self.known = dict(zip(names, ids, strict=True)) | {w: self.known[w] for w in ".,"}
            self.held = sum(map(len, ids)) + sum(map(len, names)) + WORD_BYTES * len(names)
        ids += [self.known["."], self.known[","]]
        flat, size = np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        base = bases.indices.to_numpy()
        ended = np.flatnonzero(pc.or_(dot, comma).to_numpy(zero_copy_only=False))
        mark = np.where(dot.to_numpy(zero_copy_only=False)[ended], len(names), len(names) + 1)
        # A word is one piece, or two with its ending.
        pieces = np.insert(base, ended + 1, mark) if len(ended) else base
        total = size[base]
        total[ended] += size[mark]
        return flat[laid_out(begin[pieces], size[pieces])], total

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn with ``end_id`` after each, where each begins and the last ends)."""
        if not self.by_word:
            found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return (np.concatenate([np.array(x, self.kind) for x in found]) if found else np.zeros(0, self.kind),
                    np.cumsum([0, *map(len, found)]))
        data, ends = utf8_bytes(texts)
        place, words, first = distinct_words(data, ends)
        flat, size = self._ids_of(words)
        sizes = size[place]
        stops = np.cumsum(sizes)
        ids = flat[laid_out((np.cumsum(size) - size)[place], sizes)]
        bounds = np.concatenate([[0], stops])[first]
        out = np.empty(len(ids) + len(texts), self.kind)
        at = bounds + np.arange(len(bounds))
        inner = np.ones(len(out), bool)
        inner[at[1:] - 1] = False
        out[inner] = ids
        out[~inner] = end_id
        return out, at


def laid_out(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``begin[i]`` to ``begin[i] + size[i]`` for all i in turn."""
    total = int(size.sum())
    kind = np.int32 if max(total, int(begin.max(initial=0)) + int(size.max(initial=0))) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)


def as_list(words: pa.Array) -> list[str]:
    """Words (without white space in them) as Python strings, by one split."""
    if not len(words):
        return []
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", words.type))
    return line[0].as_py().split("\n")


def distinct_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place among the distinct words of each word, these, first word of each text and the end)."""
    inside = SPACED[data]
    borders = np.zeros(len(data) + 1, bool)
    borders[ends] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | borders[1:-1]
    finishes[:-1] &= ~inside[1:] | borders[1:-1]
    starts = np.flatnonzero(begins)
    # Words without what lies between them, as one Arrow array.
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(finishes) + 1 - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(starts, ends)


def id_type(vocab_size: int) -> str:
    """The smallest little-endian unsigned type that holds the ids between the steps."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, vocab_path: str, vocab_size: int, end_id: int = END_ID,
              slice_bytes: int = SLICE_BYTES, cache_bytes: int | None = None) -> DataFrame:
    """``shard, seq, doc_id, n, ids`` in ascending ``doc_id`` order (ids as ``id_type``)."""
    kind_of_id = np.dtype(id_type(vocab_size))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def encode(batches):
        encoder, shard, seq = WordEncoder.of(vocab_path, cache_bytes), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", slice_bytes):
            ids, at = encoder.encode(batch.column(1), end_id)
            n = batch.num_rows
            raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((at * kind_of_id.itemsize).astype(np.int64)),
                                                               pa.py_buffer(np.ascontiguousarray(ids, kind_of_id))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column(0),
                 pa.array(np.diff(at)), raw.cast(pa.binary())],
                ["shard", "seq", "doc_id", "n", "ids"])
            seq += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, encode, f"shard int, seq long, doc_id {kind}, n long, ids binary")


def id_counts(tokens: DataFrame, vocab_size: int) -> np.ndarray:
    """How often each id occurs; summed by Spark, at most ``vocab_size`` rows reach the driver."""
    def count(batches):
        WordEncoder.forget()
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            raw, _ = utf8_bytes(batch.column(0))
            every = np.frombuffer(raw.tobytes() if raw.ctypes.data % 4 else raw, id_type(vocab_size))
            for lo in range(0, len(every), 1 << 22):
                total += np.bincount(every[lo: lo + (1 << 22)], minlength=vocab_size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    counted = map_arrow(tokens.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocab_size, np.int64)
    for r in counted.collect():
        out[r["id"]] = r["n"]
    return out


def write_token_file(docs: DataFrame, path: str, vocab_path: str, vocab_size: int, end_id: int = END_ID,
                     block_ids: int = BLOCK_IDS, slice_bytes: int = SLICE_BYTES, cache_bytes: int | None = None) -> str:
    """Encode every whole text (null: empty), append ``end_id`` to each and write the file.

    Repeated rows are all written; a null ``doc_id`` comes first; other columns are
    ignored. An empty table gives a file without blocks. ``slice_bytes`` of text at a time
    and ``cache_bytes`` of words bound a worker's memory; the file is the same for any.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        tokens = written(tokenized(docs, vocab_path, vocab_size, end_id, slice_bytes, cache_bytes), "tokens")
    with arrow_rows(spark, BATCH_ROWS):
        lengths = huffman.code_lengths(id_counts(tokens, vocab_size))
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id, huffman.STRIDE)],
                          "lengths binary, end_id int, stride int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast(lengths)
    kind = docs.schema["doc_id"].dataType

    def pack(batches):
        WordEncoder.forget()  # workers are used again; this step needs no words
        own = sent.value
        codes = huffman.canonical_codes(own)
        ids, sizes, names, at, n = [], [], [], None, 0

        def block():
            every = np.frombuffer(b"".join(ids), id_type(vocab_size))
            payload, bits, marks = huffman.encode(every, codes, own)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()),
                 pa.array([names], pa.list_(id_kind)), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([n], pa.int64()), pa.array([bits], pa.int64()), pa.array([payload], pa.binary()),
                 pa.array([marks.tobytes()], pa.binary())],
                ["shard", "first_seq", "doc_ids", "doc_sizes", "n_ids", "n_bits", "payload", "checkpoints"])

        follows = None
        for batch in batches:
            id_kind = batch.column(2).type
            for shard, seq, name, size, own_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (n + size > block_ids or (shard, seq) != follows):
                    yield block()
                    ids, sizes, names, n = [], [], [], 0
                if not ids:
                    at = (shard, seq)
                ids.append(own_ids)
                sizes.append(size)
                names.append(name)
                n += size
                follows = (shard, seq + 1)
        if ids:
            yield block()

    blocks = map_arrow(tokens, pack, f"shard int, first_seq long, doc_ids array<{kind.simpleString()}>, "
                       "doc_sizes array<long>, n_ids long, n_bits long, payload binary, checkpoints binary")
    # Payload and bit offsets are dense already.
    with arrow_rows(spark, BATCH_ROWS):
        blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_blocks(spark: SparkSession, path: str, fn, schema: str) -> DataFrame:
    """``fn(shard, first_seq, doc_ids, doc_sizes, ids)`` yields rows for each decoded block."""
    code = spark.read.parquet(f"{path}/codes").first()
    lengths, stride = np.frombuffer(bytes(code["lengths"]), np.uint8), code["stride"]
    sent = spark.sparkContext.broadcast(lengths)

    def unpack(batches):
        entries, bits = huffman.decode_table(sent.value)
        for batch in batches:
            for shard, seq, names, sizes, n, payload, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = huffman.decode(payload, n, np.frombuffer(marks, np.uint32), entries, bits, stride)
                yield fn(shard, seq, names, sizes, ids)

    blocks = spark.read.parquet(f"{path}/blocks").select(
        "shard", "first_seq", "doc_ids", "doc_sizes", "n_ids", "payload", "checkpoints")
    return map_arrow(blocks, unpack, schema)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, first_seq, before``: ids of all blocks before this one.

    Sums a shard first; the window without a partition sees one row a shard.
    """
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "first_seq", "n_ids")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    within = Window.partitionBy("shard").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
            .join(shards, "shard").select("shard", "first_seq", (F.col("base") + F.col("inner")).alias("before")))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """From the file alone: ``doc_id, start, n_tokens, ids_crc32`` for every document row."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def digest(shard, seq, names, sizes, ids):
        ends = np.cumsum(sizes)
        raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        crc = [zlib.crc32(raw[4 * (e - s): 4 * e]) for e, s in zip(ends.tolist(), sizes, strict=True)]
        n = len(sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(names),
             pa.array(ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
            ["shard", "first_seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = read_blocks(spark, path, digest, f"shard int, first_seq long, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    return (found.join(block_starts(spark, path), ["shard", "first_seq"])
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_file_path(spark: SparkSession) -> str:
    return scratch_path(spark, "token-file")
