"""Derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.domain import CUT_POINTS, NO_BAND, STATUS_ORDER, UPGRADE_BANDS
from regiometra.operators.quantiles import exact_quantiles
from regiometra.operators.scalars import with_scalars


def arg_min_column(labels: Mapping[str, str]) -> Column:
    """Label of the smallest column; missing ones are skipped, ties go to the first listed."""
    columns = [F.col(f"`{c}`") for c in labels]
    lowest = F.least(*columns) if len(columns) > 1 else columns[0]
    hits = [F.when(c == lowest, F.lit(label)) for c, label in zip(columns, labels.values())]
    return F.coalesce(*hits)


def difference(a: str, b: str) -> Column:
    return F.col(f"`{a}`") - F.col(f"`{b}`")


def abs_difference(a: str, b: str) -> Column:
    return F.abs(difference(a, b))


def ratio_to_mean(df: DataFrame, column: str, mask: Column, output: str) -> DataFrame:
    """Value over the mean of the masked rows; the divisor is 1 where that mean is not positive."""
    stats = df.agg(F.avg(F.when(mask, F.col(f"`{column}`"))).alias("_mean"))
    divisor = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(F.lit(1.0))
    return (with_scalars(df, stats)
            .withColumn(output, F.col(f"`{column}`") / divisor).drop("_mean"))


def outlier_name(column: str) -> str:
    return "is_outlier_" + column.split("_")[0].lower()


def iqr_outlier_flags(df: DataFrame, columns: Mapping[str, str] | Sequence[str],
                      k: float = 1.5) -> DataFrame:
    """Flag values outside [q1 - k*iqr, q3 + k*iqr]; all fences come from one aggregate.

    ``columns`` is a list, or a mapping of column -> flag name. A missing value gives False.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: outlier_name(c) for c in columns}
    wanted = {}
    for i, c in enumerate(names):
        wanted[f"_q1_{i}"], wanted[f"_q3_{i}"] = (c, 0.25), (c, 0.75)
    flags = {}
    for i, (c, flag) in enumerate(names.items()):
        q1, q3, value = F.col(f"_q1_{i}"), F.col(f"_q3_{i}"), F.col(f"`{c}`")
        reach = F.lit(float(k)) * (q3 - q1)
        flags[flag] = F.coalesce((value < q1 - reach) | (value > q3 + reach), F.lit(False))
    return with_scalars(df, exact_quantiles(df, wanted)).withColumns(flags).drop(*wanted)


def is_member(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(f"`{column}`").isin(list(values)), F.lit(False))


def near_upgrade_band(score: str, status: str, bands: Sequence[tuple] = UPGRADE_BANDS,
                      other: str = NO_BAND) -> Column:
    """Label of the band just under the next class. The stored status decides, not the score."""
    s, v = F.col(f"`{status}`"), F.col(f"`{score}`")
    hits = [F.when((s == name) & (v >= lo) & (v < hi), F.lit(label))
            for name, lo, hi, label in bands]
    return F.coalesce(*hits, F.lit(other))


def classify_by_threshold(score: str, cuts: Sequence[float] = CUT_POINTS,
                          statuses: Sequence[str] = STATUS_ORDER) -> Column:
    """Status by cut points, each the included lower bound of its class; missing stays missing."""
    v = F.col(f"`{score}`")
    chain = F.when(v < cuts[0], F.lit(statuses[0]))
    for cut, status in zip(cuts[1:], statuses[1:]):
        chain = chain.when(v < cut, F.lit(status))
    return chain.when(v.isNotNull(), F.lit(statuses[-1]))


def one_hot(column: str, categories: Sequence[str], dtype: str = "boolean") -> dict[str, Column]:
    """One flag per category, none dropped, named ``column_value`` and sorted by value."""
    value = F.col(f"`{column}`")
    return {f"{column}_{c}": F.coalesce(value == c, F.lit(False)).cast(dtype)
            for c in sorted(categories)}


def encode_label(column: str, labels: Sequence[str]) -> Column:
    """Index of the label in alphabetical order; an unknown or missing label raises."""
    value = F.col(f"`{column}`")
    index = reduce(lambda chain, item: chain.when(value == item[1], F.lit(item[0])),
                   enumerate(sorted(labels)), F.when(F.lit(False), F.lit(0)))
    text = F.concat(F.lit("label outside the domain: "), F.coalesce(value, F.lit("NULL")))
    return index.otherwise(F.raise_error(text).cast("int"))


def decode_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(s) for s in sorted(labels)]), index.cast("int"))


def derive_label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def balanced_flag(columns: Sequence[str], tolerance: float = 0.1) -> Column:
    values = [F.col(f"`{c}`") for c in columns]
    return (F.greatest(*values) - F.least(*values)) < F.lit(tolerance)


def select_prefixed(df: DataFrame, prefix: str) -> list[str]:
    """Names of the columns that start with ``prefix``."""
    return [c for c in df.columns if c.startswith(prefix)]


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the named columns, under their new names, in the given order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
