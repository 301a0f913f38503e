"""op3: packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import packing, tokens
from regiometra.llm.registry import query, table
from regiometra.session import stage

CAPACITY, END_ID = 1024, 2


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    import public_tokenizers

    pieces = tokens.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(stage(digests, "pieces"), CAPACITY, order=("doc_id", "piece", "ids_crc32"))


@query("op3_pattern_packing")
def pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed(table(spark, folder, "documents"))
