"""Row filters, option lists, sorts, limits and exact-size samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_members(df: DataFrame, choices: Mapping[str, Sequence[Any]]) -> DataFrame:
    """AND of IN lists. An empty list, or a column that is absent, filters nothing."""
    for column, values in choices.items():
        if values and column in df.columns:
            df = df.filter(F.col(f"`{column}`").isin(list(values)))
    return df


def where_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.filter(F.col(f"`{column}`") == F.lit(value))


def distinct_options(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    """Sorted distinct present values; ``first`` keeps the default selection only."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{column}` string")
    options = (df.select(F.col(f"`{column}`")).filter(F.col(f"`{column}`").isNotNull())
               .distinct().orderBy(f"`{column}`"))
    return options.limit(first) if first is not None else options


def sort_by(df: DataFrame, by: str, key: str | Sequence[str], ascending: bool = True) -> DataFrame:
    """Sort by one column, ties by ``key``."""
    keys = [key] if isinstance(key, str) else list(key)
    lead = F.col(f"`{by}`").asc() if ascending else F.col(f"`{by}`").desc()
    return df.orderBy(lead, *[F.col(f"`{k}`") for k in keys])


def top_n(df: DataFrame, by: str, key: str | Sequence[str], n: int,
          ascending: bool = False) -> DataFrame:
    return sort_by(df, by, key, ascending).limit(n)


def clamp_top_n(groups: int, requested: int | None = None) -> int:
    """Size of the dashboard's top list: all of up to five groups, else 5..min(20, groups)."""
    if groups <= 5:
        return groups
    most = min(20, groups)
    return max(5, min(most, requested if requested is not None else 10))


def dashboard_top(df: DataFrame, by: str, key: str, requested: int | None = None) -> DataFrame:
    """``clamp_top_n`` without counting the groups: a limit of 5..20 already shows them all."""
    return top_n(df, by, key, clamp_top_n(20, requested))


def select_top(df: DataFrame, condition: Column, by: str, key: str | Sequence[str],
               columns: Sequence[str], n: int = 5, ascending: bool = False) -> DataFrame:
    """Filter, sort, project, first n."""
    ordered = sort_by(df.filter(condition), by, key, ascending)
    return ordered.limit(n).select(*[F.col(f"`{c}`") for c in columns])


def preview(df: DataFrame, key: str | Sequence[str], n: int = 3) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[F.col(f"`{k}`") for k in keys]).limit(n)


def sample_order(key: str, seed: int) -> Column:
    """Repeatable random order of rows, the same on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{key}`").cast("string")))


#: Digits of a hash by which rows are counted, one level after the other; a level has 4,096 slices.
LEVELS = (3, 6)


def hash_slice(digest: Column, digits: int = LEVELS[-1]) -> Column:
    """Even slices of a hash by its first digits, in the order of the hash."""
    return F.substring(digest, 1, digits)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, clamp: bool = True) -> DataFrame:
    """Exactly ``n`` rows without replacement; with fewer rows, all of them or an error.

    The sample is the n smallest hashes. Counts per coarse slice of the hash, then per fine slice of the one that
    holds the cut, tell how far those reach: a task sends at most 4,096 counts each time, and only about n rows are
    sorted, however many tasks read the table.
    """
    if not clamp:
        have = df.count()
        if n > have:
            raise ValueError(f"cannot take {n} rows out of {have}")
    digest = sample_order(key, seed)
    rows, sooner = df, F.lit(0)
    for digits in LEVELS:
        slices = rows.groupBy(hash_slice(digest, digits).alias("_slice")).agg(F.count("*").alias("_n"))
        # At most 4,096 slices, hence one window over all of them.
        before = sooner + F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")
        edge = (slices.withColumn("_before", before).filter(F.col("_before") < n)
                .agg(F.max_by(F.struct("_slice", "_before"), "_slice").alias("_edge")).scalar())
        last, sooner = edge["_slice"], edge["_before"]
        rows = df.filter(hash_slice(digest, digits) == last)
    return (df.filter(hash_slice(digest) <= last)
            .orderBy(digest, F.col(f"`{key}`")).limit(n))
