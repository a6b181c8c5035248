"""Each pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables
and columns beyond those of documents, against the operators' own outputs or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from decantry.llm.common import table
from decantry.llm.labelled import logistic
from decantry.llm.mixing import mix_sources
from decantry.llm.quality import THRESHOLD, _Scorer, fit_quality


@pytest.fixture(scope="module")
def odd(spark, sf_small):
    """Documents of the small data, some odd ones, and a column more."""
    docs = table(spark, sf_small, "documents")
    item = table(spark, sf_small, "benchmark").where("length(text) > 100").orderBy("item_id").first()["text"]
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (7, None, "en", None, 1), (7, None, "en", None, 1),
            (900, "word " * 30_000, "en", "big", 5), (901, "a b " + item.upper() + " c", "en", "s", 5), (902, " \n\t", "xx", "s", 3)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).withColumn("score", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("_row", F.lit(2))


def _texts(df):
    return sorted((repr(r["doc_id"]), r["text"] or "", repr(r["source"])) for r in df.collect())


def test_quality_keeps_what_the_model_scores_high(spark, sf_small, odd):
    model = fit_quality(odd, table(spark, sf_small, "labels"))
    scorer = _Scorer(model.good, model.bad)
    want = sorted((repr(r["doc_id"]), r["text"] or "", repr(r["source"])) for r in odd.collect()
                  if logistic(np.array([scorer.difference(memoryview((r["text"] or "").encode()))]), model.slope, model.intercept)[0] >= THRESHOLD)
    out = c.quality(spark, odd, sf_small)
    assert out.columns == c.COLUMNS and _texts(out) == want and 0 < len(want) < odd.count()


def test_decontamination_drops_only_hit_documents(spark, sf_small, odd):
    out = c.decontamination(spark, odd, sf_small)
    kept = _texts(out)
    assert out.columns == c.COLUMNS and not any(k[0] == "901" for k in kept)
    assert sum(k[1] == "" for k in kept) == 4 and any(k[0] == "900" for k in kept) and any(k[0] == "902" for k in kept)


def test_mixing_takes_each_row_as_often_as_planned(spark, sf_small, odd):
    out = c.mixing(spark, odd, sf_small)
    assert out.columns == c.COLUMNS
    want = {r["doc_id"]: r["n"] for r in mix_sources(odd).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_tokens_hold_every_row_once(spark, sf_small, odd, vocab):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocab)
    out = sorted((repr(r["doc_id"]), r["n_tokens"]) for r in c.tokens(spark, odd, sf_small).collect())
    assert out == sorted((repr(r["doc_id"]), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.collect())


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stages_take_an_empty_table(spark, sf_small, name, stage):
    assert stage(spark, table(spark, sf_small, "documents").where("false"), sf_small).count() == 0


def test_run_leaves_its_result_and_the_token_file_only(spark, sf_small, tmp_dir, monkeypatch):
    import os

    import decantry.llm.common as common
    import decantry.llm.token_file as token_file
    monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda s: tmp_dir)
    monkeypatch.setattr(token_file, "scratch_path", common.scratch_path)
    out = c.run(spark, sf_small)
    assert out.count() > 0
    left = sorted(p.split("-")[0] for p in os.listdir(os.path.join(tmp_dir, "decantry-llm")))
    assert left == ["stage", "token"]


def test_workers_of_stages_give_freed_memory_back(spark, sf_small):
    import pyarrow as pa

    from decantry.llm.common import map_arrow

    def private_mb():
        with open("/proc/self/smaps_rollup") as f:
            return int(f.read().split("Private_Dirty:")[1].split()[0]) / 1024

    def freeing(batches):
        """Frees some 160 MB of small pieces but for one in a thousand; last, what the worker then holds."""
        some = []
        for batch in batches:
            held = [bytearray(1000) for _ in range(160_000)]
            some = held[::1000]
            del held
            yield pa.RecordBatch.from_arrays(batch.columns, ["id"])
        yield pa.RecordBatch.from_arrays([pa.array([int(private_mb()) + 0 * len(some)])], ["id"])

    def stage(session, docs, sf_dir):
        return map_arrow(session.range(0, 4, 1, 1), freeing, "id long")

    plain = [r["id"] for r in stage(spark, None, sf_small).collect()]
    lean = [r["id"] for r in c.in_lean_workers(stage)(spark, None, sf_small).collect()]
    assert lean[:-1] == plain[:-1] == [0, 1, 2, 3]
    assert lean[-1] < plain[-1] - 80


def test_every_python_stage_runs_in_lean_workers(spark, sf_small, monkeypatch):
    import decantry.llm.common as common
    docs, made, plain = table(spark, sf_small, "documents"), [], []
    own = common.lean
    monkeypatch.setattr(common, "lean", lambda fn: made.append(fn.__qualname__) or own(fn))
    for name, stage in c.STAGES:
        before = len(made)
        stage(spark, docs, sf_small)
        if len(made) == before:
            plain.append(name)
    assert plain == ["mixing"]


def test_token_file_does_not_depend_on_the_memory_bounds(spark, sf_small, odd, vocab):
    from decantry.llm.queries import VOCAB_SIZE
    from decantry.llm.token_file import document_index, token_file_path, write_token_file
    rows = []
    for bounds in ({}, {"slice_bytes": 5000, "cache_bytes": 1000}):
        path = write_token_file(odd, token_file_path(spark), vocab, VOCAB_SIZE, **bounds)
        rows.append(sorted(map(repr, document_index(spark, path).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == odd.count()
