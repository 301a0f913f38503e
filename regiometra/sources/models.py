"""Stored models: pipeline folders instead of pickles."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from regiometra.sources.tables import path_exists


def save_model(model: PipelineModel, path: str) -> None:
    """Scaler and clusters, or encoder and forest, are stages of one pipeline: one folder."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The stored pipeline, or None if it is absent or a stage of it is."""
    if not path_exists(spark, f"{path}/metadata"):
        return None
    stages = json.loads(spark.read.text(f"{path}/metadata").first()[0])["paramMap"]["stageUids"]
    width = len(str(len(stages) - 1))
    if not all(path_exists(spark, f"{path}/stages/{i:0{width}d}_{uid}/metadata") for i, uid in enumerate(stages)):
        return None
    return PipelineModel.load(path)
