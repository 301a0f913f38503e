"""op7: approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiometra.llm import ann
from regiometra.llm.registry import query, table

NEAREST, FACTOR = 20, 2.0


@query("op7_vantage_point_search")
def vantage_point_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all vectors."""
    vectors = table(spark, folder, "embeddings")
    trees, shards = ann.index(vectors, NEAREST)
    return ann.search(trees, shards, vectors.where("vec_id % 20 = 0"), NEAREST, FACTOR)
