"""op11: cross-tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiometra.llm import alignment, sides
from regiometra.llm.registry import query, table


@query("op11_hash_set_alignment")
def hash_set_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's groups and links between a byte-level and a sentencepiece tokenization."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, folder, "documents"), lambda: (sides.byte_level(a), sides.sentence_pieces(b)))
