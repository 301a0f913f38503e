"""Status classification: encode, split, fit tree and forest, evaluate both on one test set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.domain import DIMENSIONS, STATUS_ORDER, Columns
from regiometra.operators import classification as clf
from regiometra.operators import evaluation as ev
from regiometra.operators.splitting import stratified_split
from regiometra.session import stage


_PARTITIONS = 8
_ROWS_PER_PARTITION = 300_000
#: Up to as many training rows stand in the order of their keys, beyond in that of their inputs.
_ROWS_BY_KEY = 800_000


def training_layout(train: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """``inputs`` and ``label`` in the layout the models are fitted on.

    The forest draws rows per partition, so the layout is a hash of the key and sorted, and its number of partitions
    follows the rows: the same forest on every machine. In a large table rows alike stand together: one after the
    other goes through the same nodes of every tree and adds to the same counts, which then are still in the
    processor's cache. Every partition sends counts of all nodes, so there are few large ones.
    """
    rows = train.count()
    alike = ["label", *inputs[-len(DIMENSIONS):], *inputs[:-len(DIMENSIONS)]]  # the flags of the category come last
    order = [key, *inputs, "label"] if rows <= _ROWS_BY_KEY else alike
    parts = max(_PARTITIONS, -(-rows // _ROWS_PER_PARTITION))
    return train.repartition(parts, F.xxhash64(key)).sortWithinPartitions(*order).select(*inputs, "label")


@dataclass(frozen=True)
class Classification:
    tree: PipelineModel
    forest: PipelineModel
    predictions: DataFrame
    tables: dict[str, DataFrame]


def model_inputs(cols: Columns = Columns()) -> list[str]:
    return clf.feature_names(cols.model_numeric, cols.weakest)


def training_table(modeling: DataFrame, cols: Columns = Columns(), test: float = 0.20,
                   seed: int = 42) -> DataFrame:
    """Key, status, model inputs, ``label`` and ``is_test``."""
    flagged = stratified_split(modeling, cols.status, cols.unit, STATUS_ORDER, test, seed)
    return clf.prepare(flagged, cols.model_numeric, cols.weakest, cols.status, STATUS_ORDER,
                       keep=[cols.unit, cols.status, "is_test"])


def evaluate(models: dict[str, PipelineModel], test: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """(model, key, status, predicted_status, prediction) of every model on the same rows."""
    parts = [clf.predict(m, test).select(F.lit(name).alias("model"), cols.unit, cols.status,
                                         "predicted_status", "label", "prediction")
             for name, m in models.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def classify(modeling: DataFrame, cols: Columns = Columns(), trees: int = 100, tree_depth: int = 5,
             forest_depth: int = 10, max_bins: int = 256, test: float = 0.20,
             seed: int = 42) -> Classification:
    """Fits run at once, the tables are lazy. The forest is the model to store.

    The units are staged, as the split reads them once a slice and once more to flag them, and so is the split table:
    both fits and every evaluation read it.
    """
    units = stage(modeling.select(cols.unit, cols.status, *cols.model_numeric, cols.weakest), "units")
    table = stage(training_table(units, cols, test, seed), "training")
    inputs = model_inputs(cols)
    train = table.filter(~F.col("is_test")).select(cols.unit, *inputs, "label")
    train = training_layout(train, cols.unit, inputs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tree = clf.decision_tree(train, inputs, STATUS_ORDER, tree_depth, max_bins, seed)
        forest = clf.random_forest(train, inputs, STATUS_ORDER, trees, forest_depth, max_bins, seed)
    finally:
        train.unpersist()
    predictions = evaluate({"decision_tree": tree, "random_forest": forest},
                           table.filter("is_test"), cols)

    def of(name: str) -> DataFrame:
        return predictions.filter(F.col("model") == name)

    tables = {
        "report": ev.classification_report(predictions, cols.status, "predicted_status",
                                           STATUS_ORDER, by=["model"]),
        "accuracy": predictions.groupBy("model").agg(
            F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")),
        "confusion_tree": ev.confusion_matrix(of("decision_tree"), cols.status, "predicted_status",
                                              STATUS_ORDER),
        "confusion_forest": ev.confusion_matrix(of("random_forest"), cols.status,
                                                "predicted_status", STATUS_ORDER),
        "importance": clf.feature_importance(forest, modeling),
    }
    return Classification(tree, forest, predictions, tables)
