"""Joins, lookups and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.operators.scalars import with_scalars

_ROWS_TO_BROADCAST = 100_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """A table, broadcast if it has no more than that many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def left_attach(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                match_flag: str | None = None) -> DataFrame:
    """Left outer equi-join with the right key dropped, optionally with a match flag.

    No strategy is forced: ``right`` grows with the data, so Spark picks one by size.
    """
    lookup = right.withColumnRenamed(right_key, "_right_key")
    if match_flag:
        lookup = lookup.withColumn("_matched", F.lit(True))
    joined = left.join(lookup, F.col(f"`{left_key}`") == F.col("_right_key"), "left")
    if match_flag:
        joined = (joined.withColumn(match_flag, F.coalesce(F.col("_matched"), F.lit(False)))
                  .drop("_matched"))
    return joined.drop("_right_key")


def match_coverage(df: DataFrame, flag: str) -> DataFrame:
    """One row: matched rows and all rows."""
    return df.agg(F.count_if(F.col(f"`{flag}`")).alias("matched"), F.count("*").alias("total"))


def reindex_to_domain(counts: DataFrame, key: str, count: str, domain: DataFrame,
                      domain_key: str = "status", fill: int = 0) -> DataFrame:
    """Every domain value in domain order, absent ones filled; values outside it vanish.

    ``counts`` is filtered to the domain first, so the join is small on both sides.
    """
    wanted = domain.select(F.col(f"`{domain_key}`").alias(key), "ordinal")
    joined = wanted.join(counts.select(F.col(f"`{key}`"), F.col(f"`{count}`")), key, "left")
    return (joined.withColumn(count, F.coalesce(F.col(f"`{count}`"), F.lit(fill).cast("bigint")))
            .orderBy("ordinal").drop("ordinal"))


def lookup_explode(df: DataFrame, column: str, lookup: DataFrame, lookup_key: str,
                   values: Sequence[str]) -> DataFrame:
    """One row per lookup entry of the key; a key without entry gives no row.

    ``lookup`` is broadcast behind a count, as Spark knows no size of a table made in the driver and would send all
    rows of a key to one task; beyond the bound the join shuffles.
    """
    entries = small(lookup.select(F.col(f"`{lookup_key}`").alias("_lookup"), *values), _ROWS_TO_BROADCAST)
    return (df.join(entries, F.col(f"`{column}`") == F.col("_lookup"))
            .drop("_lookup"))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates stay, columns one side lacks become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


__all__ = ["left_attach", "lookup_explode", "match_coverage",
           "reindex_to_domain", "small", "union_by_name", "with_scalars"]
