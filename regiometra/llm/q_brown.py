"""op2: language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import brown
from regiometra.llm.registry import query, table


@query("op2_brown_class_scores")
def brown_class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document under word classes and single words, learned outside the held-out fold."""
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return brown.lm_scores(table(spark, folder, "documents").select("doc_id", "text"), held)
