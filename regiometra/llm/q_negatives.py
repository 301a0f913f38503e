"""op13: hard-negative mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import negatives
from regiometra.llm.registry import query, table


@query("op13_cover_tree_negatives")
def cover_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(negatives.index(vectors), vectors.where("vec_id % 100 = 0"))
