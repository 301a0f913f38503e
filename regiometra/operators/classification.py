"""Tree and forest over an assembled feature vector, their evaluation and importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.domain import DIMENSIONS
from regiometra.operators.features import encode_label, one_hot


def feature_names(numeric: Sequence[str], category: str,
                  categories: Sequence[str] = DIMENSIONS) -> list[str]:
    """Model inputs in order: the numeric columns, then one flag per category, sorted."""
    return [*numeric, *(f"{category}_{c}" for c in sorted(categories))]


def prepare(df: DataFrame, numeric: Sequence[str], category: str, status: str,
            labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as doubles and ``label``, the alphabetical index of the status."""
    flags = one_hot(category, DIMENSIONS, "double")
    return df.select(*[F.col(f"`{c}`") for c in keep],
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric],
                     *[flag.alias(name) for name, flag in flags.items()],
                     encode_label(status, labels).cast("double").alias("label"))


def _pipeline(estimator, inputs: Sequence[str], labels: Sequence[str]) -> Pipeline:
    """Assembler (raises on a missing value), estimator, and the label decoded to text."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(inputs), outputCol="features"),
        estimator,
        IndexToString(inputCol="prediction", outputCol="predicted_status", labels=sorted(labels)),
    ])


def decision_tree(train: DataFrame, inputs: Sequence[str], labels: Sequence[str],
                  max_depth: int = 5, max_bins: int = 256, seed: int = 42) -> PipelineModel:
    tree = DecisionTreeClassifier(maxDepth=max_depth, impurity="gini", maxBins=max_bins, seed=seed)
    return _pipeline(tree, inputs, labels).fit(train)


def random_forest(train: DataFrame, inputs: Sequence[str], labels: Sequence[str],
                  trees: int = 100, max_depth: int = 10, max_bins: int = 256,
                  seed: int = 42) -> PipelineModel:
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, maxBins=max_bins,
                                    featureSubsetStrategy="sqrt", seed=seed)
    return _pipeline(forest, inputs, labels).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(FITUR, IMPORTANCE), most important first; one number per model input."""
    names = model.stages[0].getInputCols()
    values = model.stages[1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return (df.sparkSession.createDataFrame(rows, "FITUR string, IMPORTANCE double")
            .orderBy(F.col("IMPORTANCE").desc(), "FITUR"))
