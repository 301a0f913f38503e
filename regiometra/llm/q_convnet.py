"""op1: quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import convnet
from regiometra.llm.registry import query, table

#: The network is fitted on at most this many labelled documents of each class, and this many bytes of each.
ROWS_PER_CLASS, LONGEST = 1_000, 32_768
THRESHOLD = 0.7


@query("op1_byte_convnet_quality")
def byte_convnet_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality probability of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    texts, marks = convnet.labelled_sample(docs, table(spark, folder, "labels").where(~held_out), "quality", ROWS_PER_CLASS, LONGEST)
    scored = convnet.score(docs, convnet.train(texts, marks))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
