"""Gapless ranks within groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, per_key: DataFrame | None = None,
                 seed: int = 0) -> DataFrame:
    """Adds ``name``, 0, 1, 2, … within each group of equal ``keys``, seeded by the hash of ``order``.

    A group is cut into about as many hash buckets as the square root of the table's rows; rows are sorted within
    a bucket and buckets are offset by prefix sums of their counts, so no task holds a whole hot group. Equal rows
    take different ranks in any order. Columns of ``per_key`` (one row per group) are attached on the way, so that
    a hot group needs no join of its own. Keys must not be null; ``df`` is read three times and should be stored.
    """
    buckets = max(1, math.isqrt(df.count()))
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(buckets)).cast("int"))
    cell = [*keys, "__b"]
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*cell).agg(F.count("*").alias("__n"))
    cells = cells.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if per_key is not None:
        cells = cells.join(per_key, keys, "left")
    inside = Window.partitionBy(*cell).orderBy(*order)
    return (dealt.withColumn("__r", F.row_number().over(inside)).join(cells, cell)
            .withColumn(name, F.col("__before") + F.col("__r") - 1).drop("__b", "__r", "__before"))
