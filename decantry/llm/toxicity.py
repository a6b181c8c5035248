"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms to Latin,
digits and signs that stand for letters inside a word (``1d10t``) to those letters.

Lexicon: beginnings of words (or whole words), learned from labelled rows by how much
oftener toxic texts hold them; a beginning covers all its endings. Exception phrases
(a lexicon word with its neighbour that occurs in clean training texts only) take a match
back. The matched weight is normalised by text length and calibrated to 0..1.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, slices, text_or_empty
from decantry.llm.labelled import fit_logistic, held_out, logistic, training_labels

#: Bounds of the training sample and of what is learned from it.
SAMPLE_ROWS = 20_000
MOST_ENTRIES = 2_000
MOST_EXCEPTIONS = 500
LEAST_DOCS = 8
LEAST_SHARE = 0.01  # of the toxic training texts
LEAST_WEIGHT = 4.0
PREFIX_LENGTHS = range(4, 13)
THRESHOLD = 0.5
FOLDS, FOLD = 5, 0
SLICE_BYTES = 4 << 20

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
    **{chr(0xFF41 + k): chr(97 + k) for k in range(26)}, **{chr(0xFF10 + k): chr(48 + k) for k in range(10)},
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
})
# Digits and signs read as letters inside words.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
_FOREIGN = re.compile("[ıɡ­Ͱ-ԯ​-‍⁠﻿０-ｚ]")
_STANDING_IN = re.compile(r"[0134578@$!|]+(?=[^\W\d_])")
_TRAILING = re.compile(r"(?<=[^\W\d_])[0134578]+(?![\w])")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOK_ALIKES)
    text = _STANDING_IN.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return _TRAILING.sub(lambda m: m[0].translate(SUBSTITUTES), text)


@dataclass(frozen=True)
class ToxicityModel:
    """``entries``: (folded beginning, True where it must be the whole word, weight)."""

    entries: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float


class _Matcher:
    def __init__(self, entries, exceptions):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for word, whole, weight in entries:
            kinds = self.auto.get(word, ())
            self.auto.add_word(word, (*kinds, (len(word), whole, weight)))
        self.has = len(entries) > 0
        if self.has:
            self.auto.make_automaton()
        self.exceptions = ahocorasick.Automaton()
        for phrase in exceptions:
            self.exceptions.add_word(phrase, len(phrase))
        self.excepting = len(exceptions) > 0
        if self.excepting:
            self.exceptions.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in folded text: at word beginnings, the longest entry at each."""
        found: dict[int, tuple[int, float]] = {}
        if not self.has:
            return []
        for last, kinds in self.auto.iter(text):
            for size, whole, weight in kinds:
                begin, end = last - size + 1, last + 1
                if begin and text[begin - 1].isalnum():
                    continue
                if whole and end < len(text) and text[end].isalnum():
                    continue
                if begin not in found or end > found[begin][0]:
                    found[begin] = (end, weight)
        if found and self.excepting:
            for last, size in self.exceptions.iter(text):
                a, b = last - size + 1, last + 1
                if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
                    continue
                for begin in [k for k in found if a <= k < b]:
                    del found[begin]
        return [(a, b, w) for a, (b, w) in sorted(found.items())]

    def strength(self, text: str) -> float:
        """Matched weight by length; 0 without a match."""
        f = folded(text)
        weight = sum(w for _, _, w in self.matches(f))
        return weight / math.log2(8 + f.count(" ") + f.count("\n")) if weight else 0.0


def _word_sets(rows: DataFrame) -> DataFrame:
    """``word, y``: the distinct folded words of each training text."""
    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            y = batch.column(1).to_pylist()
            for t, label in zip(batch.column(0).to_pylist(), y, strict=True):
                own = list(set(_WORD.findall(folded(t))))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], ["word", "y"])

    return map_arrow(rows.select("text", "y"), cut, "word string, y int")


def learn_lexicon(rows: DataFrame, most: int = MOST_ENTRIES) -> list[tuple[str, bool, float]]:
    """Beginnings of words and whole words that mark the toxic of ``rows`` (``text``, ``y``)."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    words = _word_sets(rows).groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    # A whole word is the beginning that ends in a blank.
    starts = F.concat(F.transform(F.filter(F.array(*[F.lit(k) for k in PREFIX_LENGTHS]), lambda k: k <= F.length("word")),
                                  lambda k: F.substring(F.col("word"), F.lit(1), k)),
                      F.array(F.concat("word", F.lit(" "))))
    sums = (words.select(F.explode(F.array_distinct(starts)).alias("start"), "bad", "good")
            .groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    weight = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    best = (sums.where(F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * n[1])).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc("bad"), F.length("start"), "start").limit(20 * most).collect())
    found = {r["start"]: (r["bad"], r["weight"]) for r in best}

    def stem(start: str) -> str:
        """The longest beginning that still holds nearly all of this one's texts."""
        while True:
            longer = [s for s in after.get(start, ()) if found[s][0] >= 0.95 * found[start][0]]
            if not longer:
                return start
            start = longer[0]

    after: dict[str, list[str]] = {}
    for s in found:
        before = s[:-1]
        if before in found:
            after.setdefault(before, []).append(s)
    out: dict[str, float] = {}
    for s in sorted(found, key=len):
        if not any(s[:k] in found for k in range(1, len(s))):
            t = stem(s)
            out[t] = found[t][1]
    ranked = sorted(out.items(), key=lambda kv: (-found[kv[0]][0], kv[0]))[:most]
    return [(s.rstrip(" "), s.endswith(" "), w) for s, w in ranked]


def learn_exceptions(rows: DataFrame, entries: list[tuple[str, bool, float]], most: int = MOST_EXCEPTIONS) -> list[str]:
    """Two-word phrases around a match that clean texts hold at least three times and toxic ones never."""
    sent = rows.sparkSession.sparkContext.broadcast(entries)

    def cut(batches):
        matcher = _Matcher(sent.value, [])
        for batch in slices(batches, "text", SLICE_BYTES):
            phrases, labels = [], []
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, own = folded(t), set()
                for a, _, _ in matcher.matches(f):
                    end = re.compile(r"[^\W_]*").match(f, a).end()
                    nxt = re.compile(r"\s[^\W_]+").match(f, end)
                    if nxt:
                        own.add(f[a: nxt.end()])
                    prev = re.search(r"(?<![^\W_])[^\W_]+\s$", f[max(0, a - 40): a])
                    if prev:
                        own.add(prev[0] + f[a:end])
                phrases += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], ["phrase", "y"])

    found = (map_arrow(rows.select("text", "y"), cut, "phrase string, y int").groupBy("phrase")
             .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).where("bad = 0 and good >= 3")
             .orderBy(F.desc("good"), "phrase").limit(most))
    return [r["phrase"] for r in found.collect()]


def _strengths(rows: DataFrame, entries, exceptions) -> DataFrame:
    """All columns of ``rows`` but ``_text``, and ``strength``."""
    sent = rows.sparkSession.sparkContext.broadcast((tuple(entries), tuple(exceptions)))
    names = [c for c in rows.columns if c != "_text"]

    def scan(batches):
        matcher = _Matcher(*sent.value)
        for batch in slices(batches, "_text", SLICE_BYTES):
            x = [matcher.strength(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(x, pa.float64())], [*names, "strength"])

    ddl = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    return map_arrow(rows.select(*names, "_text"), scan, ddl + "strength double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, sample_rows: int = SAMPLE_ROWS,
                 exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Lexicon, exception phrases and calibration from at most ``sample_rows`` labelled rows
    outside the fold (whole texts, equal texts once). ``exceptions`` are phrases to add."""
    from decantry.llm.common import written

    wanted = training_labels(labels, "toxic", folds, fold, sample_rows)
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")
            .select("text", "y", F.sha2(F.col("text").cast("binary"), 256).alias("same")).dropDuplicates(["same", "y"]).drop("same"))
    rows = written(rows, "toxic-training")
    entries = learn_lexicon(rows)
    phrases = [folded(p) for p in exceptions] + (learn_exceptions(rows, entries) if entries else [])
    x = _strengths(rows.select("y", F.col("text").alias("_text")), entries, phrases).collect()
    slope, intercept = fit_logistic(np.array([r["strength"] for r in x], float), np.array([r["y"] for r in x], float))
    return ToxicityModel(tuple(entries), tuple(phrases), slope, intercept if x else 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All input columns and ``strength``, ``score``: whole texts, one row per input row.

    Null and empty texts have strength 0 and the score of a text without matches.
    ``strength`` and ``score`` replace columns of that name; only ``text`` is read.
    """
    kept = docs.drop("strength", "score").withColumn("_text", text_or_empty())
    scored = _strengths(kept, model.entries, model.exceptions)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("strength") * model.slope + F.lit(model.intercept)))
    return scored.withColumn("score", 1 / (1 + F.exp(-z)))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, strength``.

    A null ``doc_id`` is never held out and never trained on. Repeated rows score alike.
    Without labels of both classes the lexicon is empty and every text gets the prior.
    """
    model = fit_toxicity(docs, labels, folds, fold)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), "strength")
