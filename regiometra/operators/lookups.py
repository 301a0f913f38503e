"""Bands and patches that come from tables: equality joins behind a count, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.domain import NO_BAND
from regiometra.functions import missing_to_null, order_bin
from regiometra.operators.cleaning import as_number
from regiometra.operators.joins import small
from regiometra.session import stage

_ROWS_TO_BROADCAST = 100_000
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _small(table: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small enough."""
    return small(table, _ROWS_TO_BROADCAST)


def band_from_table(df: DataFrame, score: str, status: str, bands: DataFrame, output: str, other: str = NO_BAND) -> DataFrame:
    """``near_upgrade_band`` with any number of bands from a table ``status, low, high, label``; adds ``output``.

    A band holds ``low <= score < high``; of several that hold a score the one of the least (low, high, label) counts.
    Bands without a status or with ``low >= high`` hold nothing.

    Scores and bounds meet in the same order bins. A band is filed at the level at which it covers two neighbouring
    buckets at most, a bucket of level l being 2**l bins. A row looks into one bucket of every level in use, so there
    is one equality join per level, of which bands of like width share one and there are 25 at most.
    """
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    filed = (bands.where(F.col("status").isNotNull() & (low < high))
             .select(F.col("status").alias("__s"), F.struct(low.alias("low"), high.alias("high"), "label").alias("__band"),
                     order_bin(low).alias("__low"), order_bin(high).alias("__high"))
             .withColumn("__level", F.length(F.bin(F.col("__high") - F.col("__low")))))
    ends = F.expr("array(shiftright(__low, __level), shiftright(__high, __level))")
    filed = (filed.withColumn("__b", F.explode(F.array_distinct(ends))).groupBy("__level", "__s", "__b")
             .agg(F.collect_list("__band").alias("__held")))
    filed = stage(filed, "bands")
    value = missing_to_null(F.col(f"`{score}`").cast("double"))
    placed, held = df.withColumn("__v", value), []
    for level in sorted(r["__level"] for r in filed.select("__level").distinct().collect()):
        name = f"__held{level}"
        here = filed.where(F.col("__level") == level).select("__s", "__b", F.col("__held").alias(name))
        key = (F.col(f"`{status}`") == F.col("__s")) & (F.shiftright(order_bin(F.col("__v")), level) == F.col("__b"))
        placed = placed.join(_small(here), key, "left").drop("__s", "__b")
        held.append(F.coalesce(F.col(name), F.array().cast(here.schema[name].dataType)))
    if not held:
        return df.withColumn(output, F.lit(other))
    v = F.col("__v")
    hits = F.filter(F.concat(*held), lambda band: (band["low"] <= v) & (v < band["high"]))
    label = F.coalesce(F.array_min(hits)["label"], F.lit(other))
    return placed.withColumn(output, label).drop("__v", *[c for c in placed.columns if c.startswith("__held")])


def patch_from_table(df: DataFrame, key: str, patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Overwrite cells by a table ``key, column, value``; numeric keys are compared as numbers, values cast.

    Of several patches of one cell the largest value stands; a null value empties the cell. Patches of other columns
    than the listed ones, or with a null key, do nothing.
    """
    numeric = dict(patches.dtypes)["key"] in _NUMBERS
    wanted = patches.where(F.col("key").isNotNull() & F.col("column").isin(list(columns)))
    per_key = stage(wanted.groupBy(F.col("key").cast("double") if numeric else F.col("key").cast("string")).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("value"))).alias(f"__p{i}") for i, c in enumerate(columns)
    ]).toDF("__key", *[f"__p{i}" for i in range(len(columns))]), "patches")
    own: Column = as_number(df, key) if numeric else F.col(f"`{key}`").cast("string")
    kinds = dict(df.dtypes)
    patched = {c: F.when(F.col(f"__p{i}").isNotNull(), F.col(f"__p{i}.value").try_cast(kinds[c])).otherwise(F.col(f"`{c}`"))
               for i, c in enumerate(columns)}
    joined = df.join(_small(per_key), own == F.col("__key"), "left").withColumns(patched)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])
