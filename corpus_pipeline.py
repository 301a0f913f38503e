"""The corpus pipeline: stages over documents, each calling one operator of ``regiometra.llm``.

Nulls, empty and very long texts, ties, repeated rows and empty tables are handled as each operator says. Extra
columns ride along through all stages but the last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regiometra.llm import jaccard, mixing, packing, q_packing, repeats, rules, suffix_array, tokens
from regiometra.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id."""
    return jaccard.keep_one(docs)


@F.pandas_udf(StringType())
def _text(kept: pd.Series) -> pd.Series:
    """Bytes as text; parts of characters that a cut has split go."""
    return kept.map(lambda data: data.decode("utf-8", "ignore"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document of smaller id has; those left without a word go.

    ``n_chars`` follows the text. Untouched documents, null texts included, stay as they are.
    """
    found = suffix_array.remove_repeats(docs).where("removed > 0").select("id", "th", _text("kept").alias("left_text"))
    cut = repeats.attach(docs, found, how="left")
    touched = F.col("__cut").isNotNull()
    text = F.when(touched, F.col("__cut.left_text")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(touched, F.length("__cut.left_text").cast("bigint")).otherwise(F.col("n_chars"))}
    wordless = touched & (F.btrim(F.col("__cut.left_text"), F.lit(rules.SPACES)) == "")
    return cut.where(~wordless).select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    sized = stage(rules.measure(docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("th")), "n_words")
                  .select("doc_id", "source", "th", F.col("n_words").alias("size")), "sizes")
    mixed = mixing.mix(sized, key=("doc_id", "th")).where("copies > 0")
    # Repeated rows are told apart by nothing, so their copies are added up and attached to one of them.
    copies = mixed.groupBy(F.xxhash64("doc_id", "source", "th").alias("__row")).agg(F.sum("copies").cast("int").alias("__copies"))
    marked = docs.withColumn("__row", F.xxhash64(F.col("doc_id"), F.col("source"), F.xxhash64("doc_id", "text")))
    once = marked.dropDuplicates(["__row"]).join(copies, "__row")
    repeated = once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its ids, sequence and place."""
    import public_tokenizers

    pieces = tokens.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), q_packing.CAPACITY, q_packing.END_ID)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(stage(digests, "pieces"), q_packing.CAPACITY, order=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: The stages hash, fit and tokenize, which SQL cannot express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
