"""Texts that once ended the JVM, and columns of the user's own names."""

import time

from pyspark.sql import functions as F

from decantry.llm.pseudonyms import pseudonymise


def test_long_domains_and_long_runs(spark, docs_of):
    rows = [(1, "x@" + "ab." * 100_000 + "com"), (2, "a." * 5_000_000), (3, "a" * 3_000_000 + "@b.com"), (4, "x@" + "a-" * 1_000_000),
            (5, "1." * 500_000), (6, "x@" * 200_000), (7, "write x.y@ab.com... or x.y@ab.com.org, not x@a..b")]
    at = time.time()
    got = {r["doc_id"]: r for r in pseudonymise(docs_of(rows), key="k").collect()}
    assert time.time() - at < 120
    assert [got[i]["n_replaced"] for i in range(1, 8)] == [1, 0, 0, 0, 0, 0, 2]
    assert got[1]["text"].endswith("ab.com") and len(got[1]["text"]) == len(rows[0][1])
    words = got[7]["text"].split()
    assert words[1].split("@")[0] == words[3].split("@")[0] != "x.y" and words[-1] == "x@a..b"
    back = pseudonymise(spark.createDataFrame([(i, r["text"]) for i, r in got.items()], "doc_id long, text string"), key="k", restore=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(rows)


def test_columns_of_the_same_names_stay(spark, docs_of):
    docs = docs_of([(1, "a@b.org")], extra=("found", "made", "rest", "_found", "_made", "n_replaced")).withColumn("odd name.x", F.lit(1))
    out = pseudonymise(docs, key="k").first().asDict()
    assert [out[c] for c in ("found", "made", "rest", "_found", "_made", "odd name.x", "n_replaced")] == ["other"] * 5 + [1, 1]
