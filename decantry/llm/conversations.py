"""Repair of role and fault sequences of conversations, shared through one grammar.

Rows of a conversation are taken by turn (nulls first; rows of one turn by the MD5 of role
and text), cut into chunks of at most ``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` of text, and
named by symbols (``grammar_dp``). Re-Pair runs over the distinct symbol strings of the
corpus, counted and weighted by Spark, a few rules a round; each rule has one min-plus
transfer with an audit rope, made bottom-up. A chunk's transfer is that of its few parsed
symbols. A conversation of one chunk (nearly all) is solved where its texts lie. Of a longer
one only the transfers move: they are joined level by level in groups of 64 and the
chosen states handed down again, so that no task ever holds a whole conversation. Chunks
come from a range partitioning, so one conversation with a third of all rows is spread too.

Null roles and texts count as one space, as do null ids and turns where they are written
out as text. A null id is a conversation like others; a turn is read as a whole number. An
empty role or one that begins with none of s, u, a cannot stay as it is. Repeated rows are
duplicates. An empty table gives no rows; other columns are ignored. Memory: the rows of a
chunk, one text at least, and in the cutting pass nothing else of the conversation.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decantry.llm import grammar_dp as G
from decantry.llm.common import map_arrow, written
from decantry.session import ship_package

CHUNK_ROWS = 256
CHUNK_BYTES = 1 << 20
FAN_BITS = 6  # groups of 64 parts a level
RULES_A_ROUND, MOST_RULES = 16, 64
SPACES = " \t\n\x0b\x0c\r"

_CHUNK = ("c string, part long, seq long, symbols binary, roles array<string>, texts array<string>, blank long, duplicate long, "
          "truncated long, illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long")
_PIECE = ("c string, key long, place long, cost array<long>, rank array<long>, blank long, duplicate long, truncated long, "
          "illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long")
_SUMMARY = ["blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns"]
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au as places in grammar_dp.ROLES


class Repair(NamedTuple):
    """``report``: a row a conversation; ``chunks``: the repaired rows, a row a chunk, in order of part and seq."""
    report: DataFrame
    chunks: DataFrame


def conversation_key(name: str = "conv_id") -> Column:
    """The id as text that is never null."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out:
    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 makes it the user's."""
    lot = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = (F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    role = F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role"))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
            .select("conv_id", "turn", "role", "text"))


def _faulted(rows: DataFrame) -> DataFrame:
    """Rows with role class, fault so far (0 none, 1 blank, 3 truncated) and whether the row repeats an earlier turn's."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    rows = rows.select(conversation_key().alias("c"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"),
                       or_space("text").alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    # Only texts that come back in a later turn reach the join.
    back = (rows.groupBy("c", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
            .select("c", "digest", "first"))
    return (rows.join(back, ["c", "digest"], "left")
            .select("c", "turn", "role", "text", "digest", role.alias("class"), fault.alias("fault"),
                    F.coalesce(at > F.col("first"), F.lit(False)).alias("later")))


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("digest")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        part, seq, row, before, held = TaskContext.get().partitionId(), 0, None, None, 0
        out: list[tuple] = []

        def close():
            nonlocal row, seq, held
            if row is not None:
                out.append((row["c"], part, seq, bytes(row["symbols"]), row["roles"], row["texts"], *(row[k] for k in _SUMMARY)))
                held += row["bytes"] + 512
                seq, row = seq + 1, None

        def batch_of():
            nonlocal out, held
            table = _arrow(out, _CHUNK_TYPES)
            out, held = [], 0
            return table

        for batch in batches:
            for c, turn, role, text, digest, kind, fault, later in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row is not None and (row["c"] != c or len(row["symbols"]) >= chunk_rows or row["bytes"] >= CHUNK_BYTES):
                    close()
                    if held >= 4 * CHUNK_BYTES:
                        yield batch_of()
                if row is None:
                    row = {"c": c, "symbols": bytearray(), "roles": [], "texts": [], "bytes": 0, "blank": 0, "duplicate": 0,
                           "truncated": 0, "illegal": 0, "first_role": kind, "last_role": None, "first_turn": None,
                           "last_turn": None, "turns": 0}
                if fault != 1 and (later or before == (c, turn, digest)):
                    fault = 2
                before = (c, turn, digest)
                row["blank"] += fault == 1
                row["duplicate"] += fault == 2
                row["truncated"] += fault == 3
                row["symbols"].append(G.DEAD if fault in (1, 2) else kind + 4 * (fault == 3))
                row["illegal"] += row["last_role"] is not None and (row["last_role"], kind) not in _LEGAL
                row["last_role"] = kind
                if turn is not None:
                    row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
                    row["turns"] += turn != row["last_turn"]
                    row["last_turn"] = turn
                row["roles"].append(role)
                row["texts"].append(text)
                row["bytes"] += len(text) + len(role)
        close()
        if out:
            yield batch_of()

    return map_arrow(laid, cut, _CHUNK)


def _types(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]


_CHUNK_TYPES, _PIECE_TYPES = _types(_CHUNK), _types(_PIECE)


def _arrow(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])


def learn_grammar(strings: DataFrame, most_rules: int = MOST_RULES, a_round: int = RULES_A_ROUND) -> G.Grammar:
    """Re-Pair over ``symbols, n`` (distinct strings and how often each occurs).

    Each round Spark counts all neighbouring pairs of the strings as parsed so far; the most
    frequent ones become rules, applied in that order (a pair that loses its places to one
    before it costs an idle rule, no result). It ends when no pair occurs twice or at
    ``most_rules``. At most (symbols)^2 counts meet in a round, ``a_round`` reach the driver.
    """
    pairs: list[tuple[int, int]] = []
    while len(pairs) < most_rules:
        known = list(pairs)

        def count(batches, known=known):
            grammar = G.Grammar(known)
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                for pair, n in G.pair_counts(grammar.parsed(batch.column(0).to_pylist()), batch.column(1).to_pylist()).items():
                    total[pair] = total.get(pair, 0) + n
            if total:
                a, b = zip(*total, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(total.values()), pa.int64())],
                                                 ["a", "b", "n"])

        top = (map_arrow(strings.select("symbols", "n"), count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
               .where("n > 1").orderBy(F.desc("n"), "a", "b").limit(min(a_round, most_rules - len(pairs))).collect())
        if not top:
            break
        pairs += [(r["a"], r["b"]) for r in top]
    return G.Grammar(pairs)


def _piece(row: dict, key: int, place: int, cost, rank) -> tuple:
    return (row["c"], key, place, np.ravel(cost).tolist(), np.ravel(rank).tolist(), *(row[k] for k in _SUMMARY))


def _merged(a: dict, b: dict) -> dict:
    """Counts of two stretches in turn."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + ((a["last_role"], b["first_role"]) not in _LEGAL)
    out["first_role"], out["last_role"] = a["first_role"], b["last_role"]
    out["turns"] = a["turns"] + b["turns"] - (b["first_turn"] is not None and a["last_turn"] == b["first_turn"])
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return out


def _square(values) -> np.ndarray:
    return np.array(values, np.int64).reshape(G.STATES, G.STATES)


def _up(table: pa.Table, fan_bits: int) -> pa.Table:
    """One group's pieces joined in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    all_, cost, rank = dict(rows[0]), _square(rows[0]["cost"]), _square(rows[0]["rank"])
    for r in rows[1:]:
        cost, rank, _ = G.joined(cost, rank, _square(r["cost"]), _square(r["rank"]))
        all_ |= _merged(all_, r)
    key = rows[0]["key"]
    return pa.Table.from_batches([_arrow([_piece(all_, key >> fan_bits, key, cost, rank)], _PIECE_TYPES)])


_WAY = "c string, key long, place long, i int, j int, closing string"


def _down(pieces: pa.Table, ways: pa.Table) -> pa.Table:
    """The states at each piece's two ends, from those of its group."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["place"])
    way = ways.to_pylist()[0]
    cost, rank, middles = _square(rows[0]["cost"]), _square(rows[0]["rank"]), []
    for r in rows[1:]:
        cost, rank, middle = G.joined(cost, rank, _square(r["cost"]), _square(r["rank"]))
        middles.append(middle)
    out, j, closing = [], way["j"], way["closing"]
    for r, middle in zip(rows[:0:-1], reversed(middles), strict=True):
        k = int(middle[way["i"], j])
        out.append((r["c"], r["key"], r["place"], k, j, closing))
        j, closing = k, ""
    out.append((rows[0]["c"], rows[0]["key"], rows[0]["place"], way["i"], j, closing))
    return pa.Table.from_batches([_arrow(out, _types(_WAY))])


def _long_ways(chunks: DataFrame, grammar: G.Grammar, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """For conversations of several chunks: (``c, cost, gaps ...`` of each, ``part, seq, i, j, closing`` of each chunk)."""
    spark = chunks.sparkSession
    many = chunks.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("part")).where("n > 1")
    last_part = many.agg(F.max("part")).first()[0]
    narrow = chunks.join(many.select("c"), "c", "left_semi").select("c", "part", "seq", "symbols", *_SUMMARY)

    def transfers(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [grammar.transfer(p) for p in grammar.parsed([r["symbols"] for r in rows])]
            yield _arrow([_piece(r, r["part"], r["seq"], c, k) for r, (c, k, _) in zip(rows, found, strict=True)], _PIECE_TYPES)

    if last_part is None:
        none = spark.createDataFrame([], _PIECE)
        return none.withColumn("total", F.lit(0)), spark.createDataFrame([], "part long, seq long, i int, j int, closing string")
    levels = [written(map_arrow(narrow, transfers, _PIECE), "conv-pieces")]
    for _ in range(2 + last_part.bit_length() // fan_bits):
        levels.append(written(levels[-1].groupBy("c", "key").applyInArrow(lambda t: _up(t, fan_bits), _PIECE), "conv-pieces"))

    def end(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                total, j, closing = G.ending(_square(r["cost"]), _square(r["rank"]))
                out.append((r["c"], r["key"], r["place"], 0, j, closing, total))
            yield _arrow(out, [*_types(_WAY), ("total", pa.int64())])

    top = written(map_arrow(levels[-1], end, _WAY + ", total long"), "conv-ways")
    ways = top.select("c", F.col("place").alias("key"), "i", "j", "closing")
    for level in reversed(levels[:-1]):
        given = (level.select("c", "key", "place", "cost", "rank").groupBy("c", "key").cogroup(ways.groupBy("c", "key")))
        below = written(given.applyInArrow(_down, _WAY), "conv-ways")
        ways = below.select("c", F.col("place").alias("key"), "i", "j", "closing")
    report = levels[-1].join(top.select("c", "total"), "c")
    return report, below.select(F.col("key").alias("part"), F.col("place").alias("seq"), "i", "j", "closing")


_MENDED = ("c string, part long, seq long, whole boolean, total long, audit string, edits array<string>, roles array<string>, "
           "texts array<string>, places array<int>, blank long, duplicate long, truncated long, illegal long, first_role int, "
           "last_role int, first_turn long, last_turn long, turns long")


def _mended(chunks: DataFrame, ways: DataFrame, grammar: G.Grammar) -> DataFrame:
    """Every chunk with its audit and its repaired rows."""
    rows = chunks.join(ways, ["part", "seq"], "left").select(
        "c", "part", "seq", "symbols", "roles", "texts", "i", "j", "closing", *_SUMMARY)
    types = _types(_MENDED)

    def mend(batches):
        solved: dict[bytes, tuple] = {}
        for batch in batches:
            told = batch.to_pylist()
            fresh = list({r["symbols"] for r in told if r["i"] is None}.difference(solved))
            if len(solved) > 20_000:
                solved, fresh = {}, list({r["symbols"] for r in told if r["i"] is None})
            for s, p in zip(fresh, grammar.parsed(fresh), strict=True):
                cost, rank, middles = grammar.transfer(p)
                total, j, closing = G.ending(cost, rank)
                solved[s] = (total, grammar.written(p, middles, 0, j) + closing)
            out = []
            for r in told:
                if r["i"] is None:
                    total, audit = solved[r["symbols"]]
                else:
                    p = grammar.parsed([r["symbols"]])[0]
                    total, audit = None, grammar.written(p, grammar.transfer(p)[2], r["i"], r["j"]) + r["closing"]
                done, _ = G.repaired(audit, list(zip(r["roles"], r["texts"], strict=True)), r["i"] or 0)
                edits, roles, texts, places = zip(*done, strict=True) if done else ((), (), (), ())
                out.append((r["c"], r["part"], r["seq"], r["i"] is None, total, audit, edits, roles, texts, places, *(r[k] for k in _SUMMARY)))
            yield _arrow(out, types)

    return map_arrow(rows, mend, _MENDED)


def repair_conversations(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_bits: int = FAN_BITS) -> Repair:
    """Cheapest repair of every conversation of ``conv_id, turn, role, text``.

    ``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row a
    distinct id. ``chunks``: ``c, part, seq, whole, audit, edits, roles, texts, places``: the rows
    that stay, in order; ``places`` points into the chunk's source rows (-1: inserted); ``whole``
    tells that the chunk is all of its conversation; ``c`` is ``conversation_key``.
    """
    spark = rows.sparkSession
    ship_package(spark)
    chunks = written(_chunks(_faulted(rows), chunk_rows), "conv-chunks")
    strings = written(chunks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "conv-strings")
    grammar = learn_grammar(strings)
    long_report, ways = _long_ways(chunks, grammar, fan_bits)
    mended = written(_mended(chunks, ways, grammar), "conv-mended")
    audits = (mended.where("not whole").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))).alias("a"))
              .select("c", F.array_join("a.audit", "").alias("audit")))
    fields = ["c", "total", "audit", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns"]
    found = mended.where("whole").select(*fields).unionByName(long_report.join(audits, "c").select(*fields))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    number = lambda name, to: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(to)
    report = (rows.select("conv_id", conversation_key().alias("c")).distinct().join(found, "c", "left")
              .select("c", "conv_id", gaps, *(number(n, n) for n in ("blank", "duplicate", "truncated", "illegal")), number("total", "cost"),
                      F.coalesce("audit", F.lit("")).alias("audit")))
    return Repair(report, mended.select("c", "part", "seq", "whole", "audit", "edits", "roles", "texts", "places"))


def digests(chunks: DataFrame) -> DataFrame:
    """``c, repaired_sha256``: SHA-256 of a conversation's repaired ``role:text`` lines.

    Conversations of one chunk are hashed where they lie. The hash of a longer one runs
    through its text in order, chunk by chunk as a stream: one task a conversation, as the
    definition of the hash asks, and in memory one chunk.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    near = chunks.where("whole").select("c", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    laid = (chunks.where("not whole").select("c", "part", "seq", lines.alias("lines"), F.size("roles").alias("n"))
            .repartition("c").sortWithinPartitions("c", "part", "seq"))

    def stream(batches):
        import hashlib

        at, h, some = None, None, False
        for batch in batches:
            out = []
            for c, text, n in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if c != at:
                    if at is not None:
                        out.append((at, h.hexdigest()))
                    at, h, some = c, hashlib.sha256(), False
                if n:
                    h.update((b"\n" if some else b"") + text.encode())
                    some = True
            if out:
                yield _arrow(out, [("c", pa.string()), ("repaired_sha256", pa.string())])
        if at is not None:
            yield _arrow([(at, h.hexdigest())], [("c", pa.string()), ("repaired_sha256", pa.string())])

    return near.unionByName(map_arrow(laid, stream, "c string, repaired_sha256 string"))
