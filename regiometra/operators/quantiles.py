"""Exact quantiles and ranks whose state does not grow with the group.

``percentile`` keeps a value -> count map of a whole group in one task. Here rows are counted per order bin first,
which a task combines to at most as many records as there are bins; the bins that hold a wanted rank are known from
prefix sums of those counts, and only the values in these bins are counted and ordered. No task sees a whole group,
and no value outside of those bins is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometra.functions import missing_to_null, order_bin
from regiometra.session import stage

_BINS_TO_BROADCAST = 100_000

Wanted = dict[str, tuple[str, float]]  # output name -> (column, probability)


def _values(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, measure, value, bin) of every present value."""
    keys = [F.col(f"`{g}`") for g in group]
    pairs = [item for c in columns
             for item in (F.lit(c), missing_to_null(F.col(f"`{c}`").cast("double")))]
    grouped = reduce(lambda d, k: d.filter(k.isNotNull()), keys, df)
    return (grouped.select(*keys, F.stack(F.lit(len(columns)), *pairs).alias("measure", "value"))
            .filter(F.col("value").isNotNull()).withColumn("bin", order_bin(F.col("value"))))


def _value_counts(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, measure, value, bin, n) for every distinct present value."""
    keys = [F.col(f"`{g}`") for g in group]
    return _values(df, columns, group).groupBy(*keys, "measure", "value", "bin").agg(F.count("*").alias("n"))


def _chosen_bins(values: DataFrame, group: list[str], probabilities: list[float]) -> DataFrame:
    """(group, measure, bin, total, before) of the bins that hold a wanted rank."""
    keys = [F.col(f"`{g}`") for g in group]
    # Bins of a group are bounded in number, so this running sum is small.
    whole = Window.partitionBy(*keys, "measure")
    bins = (values.groupBy(*keys, "measure", "bin").agg(F.count("*").alias("in_bin"))
            .withColumn("total", F.sum("in_bin").over(whole))
            .withColumn("before", F.sum("in_bin").over(whole.orderBy("bin")) - F.col("in_bin"))
            .withColumn("ranks", F.array(*[f(_rank(p)) for p in probabilities
                                           for f in (F.floor, F.ceil)])))
    return (bins.filter(F.exists("ranks", lambda k: (k >= F.col("before"))
                                 & (k < F.col("before") + F.col("in_bin"))))
            .select(*keys, "measure", "bin", "total", "before"))


def exact_quantiles(df: DataFrame, wanted: Wanted, group: list[str] | None = None) -> DataFrame:
    """One row per group with each wanted quantile, linearly interpolated.

    Groups with a null key are left out; a quantile over no value is null, and a group
    none of whose columns has a value is absent. Without ``group`` there is one row.

    The wanted bins are broadcast. With groups they are staged at once and counted before that; of so many groups that they are not, a group has few rows, and its distinct values are counted.
    """
    group = list(group or [])
    keys = [F.col(f"`{g}`") for g in group]
    columns = sorted({c for c, _ in wanted.values()})
    probabilities = sorted({p for _, p in wanted.values()})
    values = _values(df, columns, group)
    chosen = _chosen_bins(values, group, probabilities)
    few = True  # without groups at most two bins per column and probability
    if group:
        chosen = stage(chosen, "quantile-bins")
        few = chosen.count() <= _BINS_TO_BROADCAST
    rows = values.withColumn("n", F.lit(1)) if few else _value_counts(df, columns, group)
    counts = (rows.join(F.broadcast(chosen) if few else chosen, [*group, "measure", "bin"])
              .groupBy(*keys, "measure", "value", "bin", "total", "before").agg(F.sum("n").alias("n")))

    inside = Window.partitionBy(*keys, "measure", "bin").orderBy("value")
    located = counts.withColumn("upto", F.col("before") + F.sum("n").over(inside))
    found = located.groupBy(*keys, "measure").agg(
        *[_interpolated(p).alias(f"q{i}") for i, p in enumerate(probabilities)])
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == c, F.col(f"q{probabilities.index(p)}"))).alias(name)
          for name, (c, p) in wanted.items()])


def _rank(p: float) -> Column:
    return F.lit(float(p)) * (F.col("total") - 1)


def _interpolated(p: float) -> Column:
    # The smallest value whose rows reach beyond a rank is the value at that rank; bins
    # between the chosen ones hold no wanted rank.
    low, high = (F.min(F.when(F.col("upto") > f(_rank(p)), F.col("value"))) for f in (F.floor, F.ceil))
    if p == 0.5:
        return (low + high) / 2
    part = F.max(_rank(p) - F.floor(_rank(p)))
    # Equal ends are returned as they are: inf - inf would be NaN.
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def count_below(population: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, value, below): population rows strictly under each distinct point.

    Points and population meet in the same order bin, so the inequality needs no
    pairing of rows: full bins count as a prefix sum, the rest is a running sum.
    """
    have = _value_counts(population, columns, []).select("measure", "bin", "value", "n")
    asked = (_value_counts(points, columns, [])
             .select("measure", "bin", "value", F.lit(0).cast("bigint").alias("n"),
                     F.lit(True).alias("asked")))
    merged = (have.withColumn("asked", F.lit(False)).unionByName(asked)
              .groupBy("measure", "bin", "value")
              .agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")))
    by_bin = Window.partitionBy("measure").orderBy("bin")
    bins = (merged.groupBy("measure", "bin")
            .agg(F.sum("n").alias("in_bin"), F.bool_or("asked").alias("any_asked"))
            .withColumn("before", F.sum("in_bin").over(by_bin) - F.col("in_bin"))
            .filter("any_asked").select("measure", "bin", "before"))
    inside = Window.partitionBy("measure", "bin").orderBy("value")
    return (merged.join(bins, ["measure", "bin"])
            .withColumn("below", F.col("before") + F.sum("n").over(inside) - F.col("n"))
            .filter("asked").select("measure", "value", "below"))
