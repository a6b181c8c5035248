import os

import pytest


@pytest.fixture()
def docs_of(spark):
    """Rows of (doc_id, text) with the other columns of documents and some that clash."""
    def make(rows, extra=()):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, "en", f"src{k % 12}", len(t or "")) for k, (i, t) in enumerate(rows)],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        for name in extra:
            df = df.withColumn(name, F.lit("other"))
        return df
    return make


@pytest.fixture(scope="session")
def vocab():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    return path
