"""Quality by compression: which of two zstandard dictionaries explains a text better.

One dictionary is trained on good, one on bad labelled text. A text is cut in pieces (so
that the dictionary, not the text's own beginning, explains it), each piece is compressed
with both, and the normalised difference ``(bad - good) / (bad + good)`` of the summed
sizes goes through a logistic curve calibrated on labelled rows the dictionaries never saw.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow, slices, text_or_empty, utf8_bytes, written
from decantry.llm.labelled import fit_logistic, held_out, logistic, training_labels

#: Bounds of the training sample: labelled rows, whose whole texts are read; and of them the pieces
#: of ``SAMPLE_BYTES`` that make one dictionary, the first of all their pieces by hash.
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 4096
SAMPLE_PIECES = 3_000
DICT_BYTES = 112_640
LEVEL = 3
PIECE = 1024
THRESHOLD = 0.7
FOLDS, FOLD = 4, 2
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


class _Scorer:
    def __init__(self, good: bytes, bad: bytes):
        made = []
        for raw in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False))
        self.good, self.bad = made

    def difference(self, raw: memoryview) -> float:
        """0 for an empty text."""
        g = b = 0
        for k in range(0, len(raw), PIECE):
            part = raw[k: k + PIECE]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / (b + g) if b + g else 0.0


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, that text itself."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD,
                sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Dictionaries and calibration from at most ``sample_rows`` labelled ids outside the fold.

    The fit depends on the texts and labels alone, not on the order or the partitions of the
    rows: equal texts count once (texts with both labels not at all), and hashes of the text
    decide which half makes dictionaries, from all its pieces, and which calibrates, as whole
    texts scored by Spark. The driver gets ``2 * SAMPLE_PIECES`` pieces and two numbers a
    calibration text.
    """
    wanted = training_labels(labels, "quality", folds, fold, sample_rows)
    texts = written(docs.select("doc_id", text_or_empty().alias("text")).join(wanted, "doc_id").where("text <> ''")
                    .groupBy("text").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("text", "y"), "quality-sample")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    raw = F.col("text").cast("binary")
    pieces = (texts.where(half == 0).select("y", raw.alias("raw"), F.explode(F.sequence(
        F.lit(0), (F.ceil(F.octet_length("text") / SAMPLE_BYTES) - 1).cast("int"))).alias("k"))
        .select("y", F.substring("raw", F.col("k") * SAMPLE_BYTES + 1, F.lit(SAMPLE_BYTES)).alias("piece")).distinct())
    by_class = {c: [bytes(r["piece"]) for r in pieces.where(F.col("y") == c).orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_PIECES)
                    .select("piece").collect()] for c in (0, 1)}
    good, bad = _dictionary(by_class[1]), _dictionary(by_class[0])
    rest = texts.where(half == 1)
    if not good or not bad:
        y = sorted(r["y"] for r in texts.select("y").collect())
        _, intercept = fit_logistic(np.zeros(len(y)), np.array(y, float)) if y else (0.0, 0.0)
        return QualityModel(good or b"\0" * 8, bad or b"\0" * 8, 0.0, intercept if any(y) else min(intercept, 0.0))
    found = sorted((r["quality_diff"], r["y"]) for r in score_quality(rest, QualityModel(good, bad, 0.0, 0.0)).select("quality_diff", "y").collect())
    slope, intercept = fit_logistic(np.array([x for x, _ in found]), np.array([y for _, y in found], float))
    return QualityModel(good, bad, slope, intercept)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All input columns and ``quality_diff``, ``score``: whole texts, one row per input row.

    Null and empty texts have difference 0. ``score`` and ``quality_diff`` replace columns
    of that name; only ``text`` is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "quality_diff")
    names = kept.columns
    rows = kept.withColumn("_scored", text_or_empty().cast("binary"))

    def scan(batches):
        own = sent.value
        scorer = _Scorer(own.good, own.bad)
        for batch in slices(batches, "_scored", SLICE_BYTES):
            data, ends = utf8_bytes(batch.column(len(names)))
            view = memoryview(np.ascontiguousarray(data))
            x = np.array([scorer.difference(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(x), pa.array(logistic(x, own.slope, own.intercept))],
                [*names, "quality_diff", "score"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return map_arrow(rows, scan, ddl + "quality_diff double, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                     folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, quality_diff``.

    Trained on labelled rows outside the held-out fold; a null ``doc_id`` is never held out
    and never trained on. Repeated rows are scored alike. Without labels of both classes
    every text gets the prior (0.5 without any label).
    """
    model = fit_quality(docs, labels, folds, fold)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), "quality_diff")
