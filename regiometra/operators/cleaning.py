"""Coercion, audit, patching, imputation and filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometra.functions import coerce_numeric, missing_to_null, normalize_code
from regiometra.operators.aggregates import mode_of
from regiometra.operators.quantiles import exact_quantiles
from regiometra.operators.scalars import with_scalars
from regiometra.session import stage

_RUNS_TO_BROADCAST = 100_000


def as_number(df: DataFrame, column: str) -> Column:
    """The column as a double; text goes through ``coerce_numeric``."""
    if dict(df.dtypes)[column] == "string":
        return coerce_numeric(F.col(f"`{column}`"))
    return missing_to_null(F.col(f"`{column}`").cast("double"))


def coerce_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns that exist become doubles, all in one projection."""
    found = {c: as_number(df, c) for c in columns if c in df.columns}
    return df.withColumns(found) if found else df


def invalid_rows(df: DataFrame, column: str, report: Sequence[str]) -> DataFrame:
    """Audit list: rows whose ``column`` is not a number, with its text as the reason."""
    return (df.filter(as_number(df, column).isNull())
            .select(*[F.col(f"`{c}`") for c in report], F.col(f"`{column}`").alias("reason")))


def drop_invalid(df: DataFrame, column: str) -> DataFrame:
    """Complement of ``invalid_rows``; a missing value counts as invalid."""
    return df.filter(as_number(df, column).isNotNull())


def patch_cells(df: DataFrame, key: str, column: str, patches: Mapping[Any, Any]) -> DataFrame:
    """Overwrite ``column`` for the given keys. Numeric keys are compared as numbers."""
    value = F.col(f"`{column}`")
    for wanted, replacement in patches.items():
        at = F.col(f"`{key}`")
        if isinstance(wanted, (int, float)):
            at = as_number(df, key)
        value = F.when(at == F.lit(wanted), F.lit(replacement)).otherwise(value)
    return df.withColumn(column, value)


def normalize_codes(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    return df.withColumn(column, normalize_code(F.col(f"`{column}`"), strict))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers with the exact median of the column, all columns in one pass."""
    typed = coerce_columns(df, columns)
    names = {f"_median_{i}": (c, 0.5) for i, c in enumerate(columns)}
    filled = with_scalars(typed, exact_quantiles(typed, names))
    return (filled.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"_median_{i}"))
                                for i, c in enumerate(columns)})
            .drop(*names))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill missing values with the most frequent one, the smallest on ties."""
    filled = with_scalars(df, mode_of(df, column, "_mode"))
    return filled.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.col("_mode"))).drop("_mode")


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def null_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: missing cells per column and their sum, ``n_missing``."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0).cast("bigint"))
    return counts.withColumn("n_missing", total)


def fill_constant(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in values.items()})


def fill_from(df: DataFrame, column: str, other: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.col(f"`{other}`")))


def forward_fill(df: DataFrame, columns: Sequence[str], partition: str, order: str,
                 chunk: int = 1_000_000) -> DataFrame:
    """Carry the last present value down ``order`` (an integer) within ``partition``.

    A partition is cut into runs of ``chunk`` positions. Runs are filled on their own,
    and what enters a run comes from a table with one row per run, so that a partition
    holding most of the rows still spreads over many tasks.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    cut = df.withColumn("_run", F.floor(F.col(f"`{order}`") / F.lit(chunk)).cast("bigint"))
    run_keys = [F.col(f"`{partition}`"), F.col("_run")]

    lasts = cut.groupBy(*run_keys).agg(*[
        F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{order}`")))
        .alias(f"_last_{i}") for i, c in enumerate(present)])
    earlier = (Window.partitionBy(f"`{partition}`").orderBy("_run")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(
        F.col(f"`{partition}`").alias("_part"), F.col("_run").alias("_run_in"),
        *[F.last(f"_last_{i}", ignorenulls=True).over(earlier).alias(f"_in_{i}")
          for i in range(len(present))])
    carried = stage(carried, "carried")
    if carried.count() <= _RUNS_TO_BROADCAST:
        carried = F.broadcast(carried)  # else the filled rows, which are many, would be shuffled to meet them

    within = (Window.partitionBy(*run_keys).orderBy(f"`{order}`")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = cut.withColumns(
        {f"_own_{i}": F.last(F.col(f"`{c}`"), ignorenulls=True).over(within)
         for i, c in enumerate(present)})
    joined = filled.join(carried, F.col(f"`{partition}`").eqNullSafe(F.col("_part"))
                         & (F.col("_run") == F.col("_run_in")), "left")
    position = {c: i for i, c in enumerate(present)}
    return joined.select(*[
        F.coalesce(F.col(f"_own_{position[c]}"), F.col(f"_in_{position[c]}")).alias(c)
        if c in position else F.col(f"`{c}`") for c in df.columns])
