"""op5: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import mixing, rules
from regiometra.llm.registry import query, table
from regiometra.session import stage


@query("op5_subset_sum_mixing")
def subset_sum_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = stage(rules.measure(docs, "n_words").select("doc_id", "source", F.col("n_words").alias("size")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"))
