"""Corpus preparation in stages over ``documents``; each stage works on all that the last one kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; ``run`` writes each stage's
result as Parquet in the shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decantry.llm.common import drop_paths, lean_workers, scratch_made, table, written
from decantry.llm.decontaminate import decontaminate
from decantry.llm.mixing import repeat_mixed
from decantry.llm.ngram_join import ngram_join
from decantry.llm.quality import THRESHOLD, fit_quality, score_quality
from decantry.llm.queries import VOCAB_SIZE, vocab_path
from decantry.llm.token_file import document_index, token_file_path, write_token_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_BYTES = 7 << 20
SLICE_BYTES, CACHE_BYTES = 1 << 20, 32 << 20  # text at a time and words kept in a tokenizer's worker
NEAR = {"shingle": 5, "need": 80, "of": 100}  # of the stage; op2's own values bind op2 only


def arrow_bytes(spark: SparkSession) -> None:
    """Bound the Arrow batches between the JVM and its Python workers, which hold whole texts, from
    here on: the frame that a stage returns is run after it. A longer text is a batch alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_lean_workers(stage):
    """The stage with bounded Arrow batches, its Python workers giving back what they free: they
    outlast the stage, and the executors' memory is the next one's too."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        arrow_bytes(spark)
        with lean_workers():
            return stage(spark, docs, sf_dir)

    return run


@in_lean_workers
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject (score at the threshold or above).

    Null and empty texts get the score of an empty text; repeated rows stay or go together;
    columns beyond those of documents are left out; an empty table stays empty."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, a number of their own that a second reading repeats.

    Rows of Parquet files, as ``run`` hands them on, are named by file and place, without a
    copy of the texts; any other frame is written with its numbers first.
    """
    try:
        at = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    # One row a file.
    files = written(at.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_n")), "files")
    return at.join(files, "_file").select(*COLUMNS, F.shiftleft("_n", 40).bitwiseOR(F.col("_at")).alias("_row"))


@in_lean_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id (null only where no row has one).

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Rows are told apart by a number of their own, not by ``doc_id``: of repeated rows one
    stays, and a row goes only with its own group, whatever id it shares. Of rows with the
    smallest id the first by that number stays. Texts without words are linked with nothing
    and stay, each row of them.
    """
    rows = numbered(docs)
    groups = ngram_join(rows.select(F.col("_row").alias("doc_id"), "text"), **NEAR)
    linked = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "linked")
    members = linked.union(linked.select(F.col("_group").alias("_row"), "_group").distinct())
    members = written(members.join(rows.select("_row", "doc_id"), "_row"), "members")
    kept = members.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).getField("_row").alias("_kept"))
    gone = members.join(kept, "_group").where("_row <> _kept").select("_row")
    return rows.join(written(gone, "near-duplicates"), "_row", "left_anti").select(*COLUMNS)


@in_lean_workers
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; those without words, null or empty, stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times); those without words are
    taken by their hash like the others. A null source is a source of its own."""
    return repeat_mixed(docs).select(*COLUMNS)


@in_lean_workers
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of all taken documents, as its index read back from the file: a row a document
    row, null and empty texts with the end id alone."""
    path = write_token_file(docs, token_file_path(spark), vocab_path(), VOCAB_SIZE, slice_bytes=SLICE_BYTES, cache_bytes=CACHE_BYTES)
    return document_index(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("tokens", tokens)]

#: A compression classifier and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage's result is written, what it and the stage before left in the
    shared folder is deleted, but for the last result and the token file."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_made() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_paths(spark, before + [p for p in made[:-1] if "/token-file-" not in p])
        before = made[-1:]
    return docs
