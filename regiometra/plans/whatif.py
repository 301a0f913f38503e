"""Batch what-if scoring from stored or fresh models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from regiometra.domain import STATUS_ORDER, Columns
from regiometra.operators import scoring

PERCENTILES = ("iks_pct", "ike_pct", "ikl_pct")


def what_if(scenarios: DataFrame, population: DataFrame, model: PipelineModel | None, key: str,
            cols: Columns = Columns(), signed: bool = False) -> dict[str, DataFrame]:
    """Named lazy tables for scenarios (key and three indices). Without a model, no predictions."""
    features = scoring.scenario_features(scenarios, population, cols, signed)
    tables = {
        "features": features,
        "benchmark": scoring.benchmark_percentile(scenarios, population,
                                                  dict(zip(cols.indices, PERCENTILES))),
        "advice": scoring.advice(features, cols.weakest, cols.indices),
    }
    if model is not None:
        scored = scoring.score(model, features)
        tables["scored"] = scored.drop("probabilities")
        tables["probabilities"] = scoring.class_probabilities(scored, key, STATUS_ORDER)
    return tables
