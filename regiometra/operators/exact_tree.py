"""A decision tree whose every split is the best of all: no bins bound the thresholds.

A level is one pass: class counts by (node, feature, distinct value), combined in the tasks, then prefix sums over the
ordered values. The sums run over order bins first and then inside a bin, so no task holds a whole feature. The best
split of a node has the least weighted gini impurity; ties go to the earlier feature and the smaller value, and the
threshold lies midway between two neighbouring values. The driver sees one row per node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiometra.functions import order_bin


@dataclass(frozen=True)
class Split:
    """Rows of ``node`` with ``feature <= threshold`` go to node 2n, the others to 2n + 1; counts are per class."""

    node: int
    feature: int
    threshold: float
    left: tuple[int, ...]
    right: tuple[int, ...]

    def gain(self) -> float:
        """Fall of the impurity, times rows."""
        both = [a + b for a, b in zip(self.left, self.right)]
        return sum(map(_kept, (self.left, self.right))) - _kept(both)


def _kept(counts: Sequence[int]) -> float:
    return sum(c * c for c in counts) / max(sum(counts), 1)


@dataclass(frozen=True)
class ExactTree:
    inputs: tuple[str, ...]
    labels: tuple[str, ...]
    counts: tuple[int, ...]
    splits: dict[int, Split]

    def _case(self, node: int, counts: Sequence[int], leaf) -> str:
        split = self.splits.get(node)
        if split is None:
            return leaf(node, counts)
        return (f"CASE WHEN `{self.inputs[split.feature]}` <= {split.threshold!r}D "
                f"THEN {self._case(2 * node, split.left, leaf)} ELSE {self._case(2 * node + 1, split.right, leaf)} END")

    def node_sql(self) -> str:
        """The node that a row has reached."""
        return self._case(1, self.counts, lambda node, counts: str(node))

    def model(self) -> PipelineModel:
        """The tree as a storable pipeline: adds ``prediction``, the class of most rows, and ``predicted_status``."""
        index = self._case(1, self.counts, lambda node, counts: str(max(range(len(counts)), key=lambda k: (counts[k], -k))))
        names = ", ".join("'" + n.replace("'", "\\'") + "'" for n in self.labels)
        return PipelineModel([
            SQLTransformer(statement=f"SELECT *, CAST({index} AS DOUBLE) AS prediction FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, element_at(array({names}), CAST(prediction AS INT) + 1) AS predicted_status FROM __THIS__")])

    def importance(self) -> dict[str, float]:
        """Share of every input in the fall of impurity."""
        fall = {name: 0.0 for name in self.inputs}
        for split in self.splits.values():
            fall[self.inputs[split.feature]] += split.gain()
        whole = sum(fall.values())
        return {name: value / whole if whole else 0.0 for name, value in fall.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(node, feature, threshold, n_left, n_right) of every split."""
        rows = [(s.node, self.inputs[s.feature], s.threshold, sum(s.left), sum(s.right)) for s in self.splits.values()]
        return spark.createDataFrame(rows, "node int, feature string, threshold double, n_left bigint, n_right bigint")


def _best_splits(rows: DataFrame, inputs: Sequence[str], classes: int) -> DataFrame:
    """The best split of every node of ``rows`` (``_node``, inputs, ``label``) that has one."""
    k = range(classes)
    cells = [item for i, c in enumerate(inputs) for item in (F.lit(i), F.col(f"`{c}`").cast("double"))]
    # Zero has two signs; adding zero leaves one.
    long = rows.select("_node", "label", F.stack(F.lit(len(inputs)), *cells).alias("f", "v")).withColumn("v", F.col("v") + F.lit(0.0))
    counts = (long.withColumn("bin", order_bin(F.col("v"))).groupBy("_node", "f", "bin", "v")
              .agg(*[F.count_if(F.col("label") == i).alias(f"c{i}") for i in k]))
    whole = Window.partitionBy("_node", "f")
    by_bin = whole.orderBy("bin")
    bins = counts.groupBy("_node", "f", "bin").agg(F.min("v").alias("low"), *[F.sum(f"c{i}").alias(f"b{i}") for i in k])
    bins = bins.select("_node", "f", "bin", F.lead("low").over(by_bin).alias("next_low"),
                       *[(F.sum(f"b{i}").over(by_bin) - F.col(f"b{i}")).alias(f"b{i}") for i in k],
                       *[F.sum(f"b{i}").over(whole).alias(f"t{i}") for i in k])
    inside = Window.partitionBy("_node", "f", "bin").orderBy("v")
    placed = counts.join(bins, ["_node", "f", "bin"])
    placed = placed.select("_node", "f", "v", F.coalesce(F.lead("v").over(inside), F.col("next_low")).alias("next"),
                           *[(F.col(f"b{i}") + F.sum(f"c{i}").over(inside)).alias(f"l{i}") for i in k],
                           *[F.col(f"t{i}") for i in k])
    left = [F.col(f"l{i}").cast("double") for i in k]
    right = [(F.col(f"t{i}") - F.col(f"l{i}")).cast("double") for i in k]

    def kept(counts: list):
        squares, total = counts[0] * counts[0], counts[0]
        for c in counts[1:]:
            squares, total = squares + c * c, total + c
        return squares / total

    impure = F.greatest(*[F.col(f"t{i}") for i in k]) < sum((F.col(f"t{i}") for i in k), F.lit(0))
    scored = placed.where(F.col("next").isNotNull() & impure).withColumn("score", kept(left) + kept(right))
    order = F.struct((-F.col("score")).alias("worse"), "f", "v", "next", *[f"l{i}" for i in k], *[f"t{i}" for i in k])
    return scored.groupBy("_node").agg(F.min(order).alias("best"))


def fit(train: DataFrame, inputs: Sequence[str], labels: Sequence[str], max_depth: int = 5) -> ExactTree:
    """The tree over ``inputs`` and ``label`` (0-based index into the sorted labels); a missing input is an error.

    ``train`` is read once a level and should be stored or cached. A node of one class, or of equal rows, is a leaf.
    """
    classes = len(labels)
    found = train.agg(F.count_if(F.exists(F.array(*[F.col(f"`{c}`").cast("double") for c in inputs]),
                                          lambda x: x.isNull() | F.isnan(x))).alias("missing"),
                      *[F.count_if(F.col("label") == i).alias(f"c{i}") for i in range(classes)]).first()
    if found["missing"]:
        raise ValueError(f"{found['missing']} rows lack an input")
    tree = ExactTree(tuple(inputs), tuple(sorted(labels)), tuple(found[1:]), {})
    for depth in range(max_depth):
        reached = train.withColumn("_node", F.expr(tree.node_sql())).where(F.col("_node") >= 2 ** depth)
        new = {}
        for row in _best_splits(reached, inputs, classes).collect():
            best = row["best"]
            left = tuple(best[f"l{i}"] for i in range(classes))
            middle = (best["v"] + best["next"]) / 2
            threshold = middle if best["v"] <= middle < best["next"] else best["v"]
            new[row["_node"]] = Split(row["_node"], best["f"], threshold, left,
                                      tuple(best[f"t{i}"] - n for i, n in enumerate(left)))
        if not new:
            break
        tree = ExactTree(tree.inputs, tree.labels, tree.counts, {**tree.splits, **dict(sorted(new.items()))})
    return tree
