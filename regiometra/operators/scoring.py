"""Batch what-if scoring: a table of scenarios of any size against a model and a population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.domain import BALANCE_TOLERANCE, DIMENSIONS, Columns, advice_table
from regiometra.functions import round_half_even
from regiometra.operators.aggregates import default_medians
from regiometra.operators.features import abs_difference, arg_min_column, balanced_flag, difference, one_hot
from regiometra.operators.joins import lookup_explode
from regiometra.operators.quantiles import count_below
from regiometra.operators.scalars import with_scalars


def scenario_features(scenarios: DataFrame, population: DataFrame, cols: Columns,
                      signed: bool = False) -> DataFrame:
    """Model inputs for scenarios given as the three indices.

    Gaps are absolute, as when a single village is scored by hand, although training uses
    signed ones; ``signed=True`` follows training. The features a scenario cannot give
    are the medians of the whole population.
    """
    gap = difference if signed else abs_difference
    medians = default_medians(population, [cols.child_count, cols.child_total, cols.intensity])
    derived = scenarios.withColumns({
        cols.gap_economic: gap(cols.social, cols.economic),
        cols.gap_environment: gap(cols.social, cols.environment),
        cols.weakest: arg_min_column(cols.dimension_of)})
    flagged = derived.withColumns(one_hot(cols.weakest, DIMENSIONS, "int"))
    return with_scalars(flagged, medians)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Scenarios with ``predicted_status`` and ``confidence``, the largest probability."""
    return (model.transform(features)
            .withColumn("probabilities", vector_to_array("probability"))
            .withColumn("confidence", F.array_max("probabilities"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def class_probabilities(scored: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """(key, status, probability), per scenario the most likely first."""
    names = F.array(*[F.lit(s) for s in sorted(labels)])
    return (scored.select(F.col(f"`{key}`"), F.posexplode("probabilities").alias("_i", "probability"))
            .select(F.col(f"`{key}`"), F.get(names, F.col("_i")).alias("status"), "probability")
            .orderBy(F.col(f"`{key}`"), F.col("probability").desc(), "status"))


def benchmark_percentile(scenarios: DataFrame, population: DataFrame,
                         outputs: Mapping[str, str]) -> DataFrame:
    """Share of the whole population strictly below each index of each scenario, 1 decimal.

    ``outputs`` maps index column -> result column. Ranks are found once per distinct value
    (see ``count_below``) and looked up by equality.
    """
    columns = list(outputs)
    below = count_below(population, scenarios, columns)
    result = with_scalars(scenarios, population.agg(F.count("*").alias("_all")))
    for i, (column, output) in enumerate(outputs.items()):
        ranks = (below.filter(F.col("measure") == column)
                 .select(F.col("value").alias(f"_v{i}"), F.col("below").alias(f"_b{i}")))
        share = round_half_even(F.try_divide(F.col(f"_b{i}").cast("double"), F.col("_all")) * 100, 1)
        result = (result.join(ranks, F.col(f"`{column}`") == F.col(f"_v{i}"), "left")
                  .withColumn(output, F.coalesce(share, F.lit(0.0))).drop(f"_v{i}", f"_b{i}"))
    return result.drop("_all")


def advice(scenarios: DataFrame, weakest: str, indices: Sequence[str]) -> DataFrame:
    """One row per scenario and advice text of its weakest dimension, with ``balanced``."""
    flagged = scenarios.withColumn("balanced", balanced_flag(indices, BALANCE_TOLERANCE))
    return lookup_explode(flagged, weakest, advice_table(scenarios.sparkSession), "dimension",
                          ["seq", "advice"])
