"""The quality fit against partitions, copies and contradicting labels; the mix keeps all columns."""

import random

import pytest
from pyspark.sql import functions as F

from decantry.llm.mixing import mix_sources, repeat_mixed
from decantry.llm.quality import classify_quality

GOOD = ["the method", "was measured", "results show", "in detail", "with care", "we describe", "a table of", "clear steps"]
BAD = ["click here", "BUY now!!!", "free $$$", "win win", "best deal", "!!! wow", "cheap cheap", "subscribe"]


def _labelled(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(GOOD if k % 2 else BAD) for _ in range(rng.randint(5, 60))) for k in range(300)]
    docs, labels = [], []
    for k, t in enumerate(texts):
        for copy in range(3):
            i = k * 3 + copy
            docs.append((i, t if copy else t + " "))
            # A fifth of the texts has one label that contradicts the others.
            labels.append((i, 1 - k % 2 if k % 5 == 0 and copy == 2 else k % 2, 0))
    docs += [(None, "free"), (10_000, None), (10_001, ""), (10_002, "results show " * 20_000)]
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_scores_do_not_depend_on_partitions(spark):
    docs, labels = _labelled(spark)
    found = [sorted((repr(r["doc_id"]), r["score"], r["predicted"]) for r in
                    classify_quality(docs.repartition(n, F.rand(n)), labels.repartition(n)).collect()) for n in (1, 7, 50)]
    assert found[0] == found[1] == found[2]
    scores = dict((a, b) for a, b, _ in found[0])
    right = sum((scores[str(k * 3 + 1)] > 0.5) == bool(k % 2) for k in range(300))
    assert right > 290 and scores["10002"] > 0.5


@pytest.mark.parametrize("labels_of", [lambda d: [], lambda d: [(i, 1, 0) for i in range(30)], lambda d: [(0, 0, 0), (0, 1, 0)]])
def test_quality_with_few_labels(spark, labels_of):
    docs, _ = _labelled(spark)
    labels = spark.createDataFrame(labels_of(docs), "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in classify_quality(docs, labels).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_repeated_rows_keep_every_column(spark, docs_of):
    rows = [(k, "w " * (k % 9)) for k in range(200)] + [(None, None), (3, "w w w "), (3, "w w w ")]
    names = ("h", "threshold", "source_size", "whole", "target", "rest", "row", "key", "copies", "copy", "_copy", "t_source", "prefix", "spent")
    docs = docs_of(rows)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    out = repeat_mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        key = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[n] == f"{n}-{key}" for n in names) and r["a.b"] == 1
        taken[key, r["text"]] = taken.get((key, r["text"]), 0) + 1
    want = {}
    texts = {("none" if i is None else str(i)): t for i, t in rows}
    for r in mix_sources(docs).collect():
        key = "none" if r["doc_id"] is None else str(r["doc_id"])
        if r["copies"]:
            want[key, texts[key]] = want.get((key, texts[key]), 0) + r["copies"]
    assert taken == want
