"""Artwork corpus (O-D11): a JSON document ``{"works": [...]}`` read with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("artwork", T.StringType()),
    T.StructField("accords", T.ArrayType(T.StringType())),
    T.StructField("notes", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
])
DOCUMENT = T.StructType([T.StructField("works", T.ArrayType(WORK))])


def read_artworks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per work, explicit schema (no inference).

    ``multi_line=True`` reads a pretty-printed file holding ONE document (Spark then parses only
    the first document of a file, and each file is one task); ``multi_line=False`` reads JSON
    Lines with one document per line, which is splittable: use it for what
    ``write_artworks`` produces."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return doc.select(F.explode("works").alias("w")).select("w.*")


WORKS_PER_DOCUMENT = 10_000


def write_artworks(museum: DataFrame, path: str, works_per_document: int = WORKS_PER_DOCUMENT) -> None:
    """Write museum works as JSON Lines of documents ``{"works": [...]}`` (read them back with
    ``multi_line=False``). Each document holds at most ``works_per_document`` works (a chunk of
    one task's rows), so no row grows with the data."""
    works = museum.select(F.struct(
        F.col("perfume_name").alias("id"), F.col("perfume_name").alias("name"), "brand",
        F.col("artwork_path").alias("artwork"), F.col("accords"),
        F.col("notes") if "notes" in museum.columns else F.array().cast("array<string>").alias("notes"), "description").alias("w"))
    # monotonically_increasing_id = (partition index << 33) + position in the partition.
    chunk = F.floor(F.monotonically_increasing_id() / F.lit(works_per_document))
    (works.groupBy(chunk.alias("_doc")).agg(F.collect_list("w").alias("works"))
     .select("works").write.mode("overwrite").json(path))
