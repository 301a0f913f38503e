"""op12: packing with free cuts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import windows, word_cache
from regiometra.llm.registry import query, table

WINDOW, END_ID = 4096, 2


@query("op12_least_squares_windows")
def least_squares_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, without padding."""
    import public_tokenizers

    encoder = partial(word_cache.lower_words, public_tokenizers.path("word_bpe_49k.json"))
    pieces = windows.pack(table(spark, folder, "documents"), encoder, WINDOW, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
