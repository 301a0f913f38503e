"""op4: sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import sharding
from regiometra.llm.registry import query, table
from regiometra.session import stage

SHARDS = 16


@query("op4_hash_tree_sharding")
def hash_tree_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards by the key law, and where a 17th shard would put them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = sharding.even_tree(SHARDS)
    rows = sharding.assign(rows, "doc_id", tree)
    rows = stage(sharding.assign(rows, "doc_id", sharding.grow(tree, SHARDS), "grown_shard"), "shards")
    placed = sharding.place(rows, order=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), "grown_shard")
