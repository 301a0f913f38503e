"""op8 and op10: removal of long passages that occur again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import repeats, suffix_array, suffix_tree
from regiometra.llm.registry import query, table


def _digests(docs: DataFrame, found: DataFrame, units: str) -> DataFrame:
    digest = found.select("id", "th", F.col("units").alias(units), F.col("removed").alias("n_removed"),
                          F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return repeats.attach(docs, digest).select("doc_id", *[F.col(f"__cut.{c}") for c in digest.columns[2:]])


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document left after removing 50-byte strings that a smaller document has."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _digests(docs, suffix_array.remove_repeats(docs), "n_bytes")


@query("op10_suffix_tree_dedup")
def suffix_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document left after removing 20-word windows that start earlier."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _digests(docs, suffix_tree.remove_repeats(docs), "n_words").drop("n_spans")
