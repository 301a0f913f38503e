"""Exact stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiometra.operators.filters import LEVELS, hash_slice, sample_order


def _quotas(hashed: DataFrame, test: float) -> DataFrame:
    """(_label, _quota) by largest remainders; one row per label of a fixed, short list."""
    everyone = Window.partitionBy()
    counts = hashed.groupBy("_label").agg(F.count("*").alias("_n"))
    draws = F.ceil(F.lit(float(test)) * F.sum("_n").over(everyone))
    share = F.col("_n") / F.sum("_n").over(everyone) * draws
    shares = counts.select("_label", draws.alias("_draws"), F.floor(share).alias("_whole"), (share - F.floor(share)).alias("_rest"))
    place = F.row_number().over(everyone.orderBy(F.desc("_rest"), "_label"))
    more = F.when(place <= F.col("_draws") - F.sum("_whole").over(everyone), 1).otherwise(0)
    return shares.select("_label", (F.col("_whole") + more).cast("double").alias("_quota"))


def stratified_split(df: DataFrame, label: str, key: str, labels: Sequence[str],
                     test: float = 0.20, seed: int = 42, output: str = "is_test", apportion: bool = False) -> DataFrame:
    """Flag exactly rint(test * n) rows of every label, by smallest hash of the key.

    With ``apportion`` there are exactly ceil(test * n) flagged rows over all labels: every label gets the whole part
    of its share and the largest fractions one more, the earlier label on ties.

    Rows are counted per coarse slice of the hash and then per fine slice of the one in which the cut falls; only
    that fine slice is ordered. The result is one cut per label (a fixed, short list), against which every row is
    compared in place: the table itself is never shuffled.
    """
    value = F.col(f"`{label}`")
    hashed = (df.filter(value.isin(list(labels)))
              .select(value.alias("_label"), F.col(f"`{key}`").alias("_key"),
                      sample_order(key, seed).alias("_hash")))
    whole = Window.partitionBy("_label")

    def lookup(table: DataFrame, entry):
        """One-row map over the labels, as a constant."""
        pairs = F.collect_list(F.struct("_label", entry))
        return table.agg(F.map_from_entries(pairs).alias("m")).scalar()

    rows, edge = hashed, None
    quota = lookup(_quotas(hashed, test), "_quota") if apportion else None
    for digits in LEVELS:
        slices = rows.groupBy("_label", hash_slice(F.col("_hash"), digits).alias("_slice")).agg(F.count("*").alias("_n"))
        wanted = F.rint(F.lit(float(test)) * F.sum("_n").over(whole)) if quota is None else F.try_element_at(quota, F.col("_label"))
        take = (wanted if edge is None
                else F.try_element_at(edge, F.col("_label"))["need"])
        slices = (slices.withColumn("_take", take)
                  .withColumn("_before", F.sum("_n").over(whole.orderBy("_slice")) - F.col("_n"))
                  .filter((F.col("_before") < F.col("_take"))
                          & (F.col("_take") <= F.col("_before") + F.col("_n"))))
        edge = lookup(slices, F.struct("_slice", (F.col("_take") - F.col("_before")).alias("need")))
        rows = hashed.filter(hash_slice(F.col("_hash"), digits) == F.try_element_at(edge, F.col("_label"))["_slice"])

    order = Window.partitionBy("_label").orderBy("_hash", "_key")
    cuts = (rows.withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") == F.try_element_at(edge, F.col("_label"))["need"]))
    cut = F.try_element_at(lookup(cuts, F.struct("_hash", "_key")), value)
    here = F.struct(sample_order(key, seed).alias("_hash"), F.col(f"`{key}`").alias("_key"))
    return df.withColumn(output, F.coalesce(here <= cut, F.lit(False)))
