"""Attach one-row aggregates to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a struct column.

    It becomes an uncorrelated scalar subquery: run once, then a constant to the
    main scan, so nothing is joined or shuffled. More than one row raises.
    """
    return stats.select(F.struct("*").alias("scalars")).scalar()


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of the one-row table ``stats`` added."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    added = [F.col(f"_stats.`{c}`").alias(c) for c in stats.columns]
    return df.withColumn("_stats", one_row(stats)).select(*keep, *added)
