"""op6: n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import jaccard
from regiometra.llm.registry import query, table
from regiometra.llm.repeats import NO_ID


@query("op6_bayes_jaccard_join")
def bayes_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document: five words, a similarity of 0.8 or more."""
    found = jaccard.similar(table(spark, folder, "documents"))
    return found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), "n_links")
