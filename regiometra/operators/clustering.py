"""Scaling, placing rows by fitted centres, K sweep and silhouettes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.domain import CLUSTER_PREFIX
from regiometra.operators.filters import sample_n
from regiometra.operators.kmeans import Centers, fit_all, point_blocks
from regiometra.operators.scalars import with_scalars
from regiometra.session import stage

_POINTS_PER_BLOCK = 2_048


def _scaled(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std per column; a constant column becomes 0."""
    stats = df.agg(*[f(F.col(f"`{c}`")).alias(f"_{name}_{i}") for i, c in enumerate(columns)
                     for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    scaled = {c + suffix: _scaled(F.col(f"`{c}`"), F.col(f"_mean_{i}"), F.col(f"_std_{i}"))
              for i, c in enumerate(columns)}
    return with_scalars(df, stats).withColumns(scaled).drop(*stats.columns)


@dataclass(frozen=True)
class Scaler:
    """Fitted means and population deviations, two numbers per column; of no rows, zeros and ones."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(*[F.avg(F.col(f"`{c}`")) for c in columns],
                     *[F.stddev_pop(F.col(f"`{c}`")) for c in columns]).first()
        d = len(columns)
        return cls(tuple(columns), tuple(0.0 if m is None else m for m in row[:d]),
                   tuple(s if s is not None and s > 0 else 1.0 for s in row[d:]))

    def stage(self, prefix: str = "_z") -> SQLTransformer:
        """The scaling as a pipeline stage that can be stored; adds ``_z0``, ``_z1``, ..."""
        terms = [f"(`{c}` - ({m!r}D)) / ({s!r}D) AS {prefix}{i}" for i, (c, m, s)
                 in enumerate(zip(self.columns, self.means, self.stds))]
        return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")

    def inverse(self, centers: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Scaled values back in original units, column by column."""
        return centers.withColumns({c: F.col(f"`{c}`") * F.lit(s) + F.lit(m) for c, m, s
                                    in zip(columns, self.means, self.stds)})


def distinct_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct feature rows with their ``weight``.

    The K-Means objective only sees points and weights, so every iteration runs on the distinct
    points; indices published with few decimals repeat a lot.
    """
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.count("*").cast("double").alias("weight"))


def cluster_model(scaler: Scaler, model: Centers, cluster: str, label: str) -> PipelineModel:
    """Scaler, nearest centre and label as one storable pipeline; a row with a null feature gets no cluster."""
    inputs = [f"_z{i}" for i in range(len(scaler.columns))]
    hidden = ", ".join([*inputs, "_ds"])
    number = "CAST(array_position(_ds, array_min(_ds)) AS INT)"
    return PipelineModel([
        scaler.stage(),
        SQLTransformer(statement=f"SELECT *, {model.distances(inputs)} AS _ds FROM __THIS__"),
        SQLTransformer(statement=f"SELECT * EXCEPT ({hidden}), {number} AS `{cluster}`, concat("
                                 f"'{CLUSTER_PREFIX}', {number}) AS `{label}` FROM __THIS__"),
    ])


def centroids(scaler: Scaler, model: Centers, df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, one column per feature) in original units, k rows."""
    rows = [(n + 1, *point) for n, point in enumerate(model.points)]
    schema = f"`{cluster}` int, " + ", ".join(f"`{c}` double" for c in scaler.columns)
    return scaler.inverse(df.sparkSession.createDataFrame(rows, schema), scaler.columns)


def silhouette_exact(sample: DataFrame, columns: Sequence[str], labels: Sequence[str],
                     weight: str | None = None) -> DataFrame:
    """(labelling, silhouette): mean of (b - a) / max(a, b), Euclidean, for each label column.

    Euclidean sums need the distance of every two points, so samples are what it is meant for; any number is
    taken. Equal points with equal labels are merged and weighted and dealt to blocks by hash. A task adds up the
    distances of one block's points to another block, per cluster; no pair ever becomes a row.
    ``weight`` names a column of row counts if the sample is merged already.
    """
    rows = F.sum(F.col(f"`{weight}`")) if weight else F.count("*").cast("double")
    merged = stage(sample.groupBy(*[F.col(f"`{c}`") for c in [*columns, *labels]]).agg(rows.alias("_weight")), "points")
    blocks = max(1, -(-merged.count() // _POINTS_PER_BLOCK))
    names = [[r[0] for r in merged.select(F.col(f"`{c}`")).distinct().sort(F.col(f"`{c}`")).collect()] for c in labels]
    d, n = len(columns), len(labels)
    codes = [F.array_position(F.lit(v), F.col(f"`{c}`")) if v else F.lit(1) for c, v in zip(labels, names)]
    dealt = merged.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                          *[(code - 1).cast("int").alias(f"c{i}") for i, code in enumerate(codes)], "_weight")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(*[f"x{i}" for i in range(d)]), F.lit(blocks)).cast("int"))

    def gather(group):
        import pandas as pd

        data = group[[*(f"x{i}" for i in range(d)), *(f"c{i}" for i in range(n)), "_weight"]].to_numpy(float)
        return pd.DataFrame({"block": group["block"].iloc[:1], "points": [data.tobytes()]})

    def opened(data):
        import numpy as np

        table = np.frombuffer(data).reshape(-1, d + n + 1)
        return table[:, :d], table[:, d:d + n].astype(int), table[:, -1]

    def distances(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for block, own, other in zip(batch["block"], batch["own"], batch["other"]):
                a, (b, code, weights) = opened(own)[0], opened(other)
                groups = np.concatenate([np.eye(len(v))[code[:, i]] * weights[:, None] for i, v in enumerate(names)], axis=1)
                sums = np.concatenate([np.sqrt(sum((part[:, j, None] - b[None, :, j]) ** 2 for j in range(d))) @ groups
                                       for part in np.array_split(a, max(1, len(a) // 256))])
                yield pd.DataFrame({"block": [block], "own": [own], "sums": [sums.tobytes()], "sizes": [groups.sum(axis=0).tobytes()]})

    def finish(group):
        import numpy as np
        import pandas as pd

        _, code, weights = opened(group["own"].iloc[0])
        sums = sum(np.frombuffer(x) for x in group["sums"]).reshape(len(code), -1)
        sizes, at, out = sum(np.frombuffer(x) for x in group["sizes"]), 0, []
        for i, v in enumerate(names):
            size, total, own, rows = sizes[at:at + len(v)], sums[:, at:at + len(v)], code[:, i], np.arange(len(code))
            at += len(v)
            a = total[rows, own] / np.maximum(size[own] - 1, 1)
            means = total / size
            means[rows, own] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)
            out.append((i, len(v), float((s * weights).sum()), float(weights.sum())))
        return pd.DataFrame(out, columns=["n", "clusters", "total", "rows"])

    held = stage(dealt.groupBy("block").applyInPandas(gather, "block int, points binary"), "point-blocks")
    left = held.select("block", F.col("points").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("right"))
    pairs = left.join(held.select(F.col("block").alias("right"), F.col("points").alias("other")), "right")
    score = F.when(F.max("clusters") > 1, F.sum("total") / F.sum("rows"))
    name = F.get(F.array(*[F.lit(c) for c in labels]), F.col("n"))
    return (pairs.select("block", "own", "other").mapInPandas(distances, "block int, own binary, sums binary, sizes binary")
            .groupBy("block").applyInPandas(finish, "n int, clusters int, total double, rows double")
            .groupBy("n").agg(score.alias("silhouette"))
            .select(name.alias("labelling"), "silhouette"))


def silhouette_fast(df: DataFrame, columns: Sequence[str], cluster: str) -> float | None:
    """Linear-time silhouette of the whole table with squared Euclidean distance; null below two clusters.

    Squared distances to all points of a cluster follow from its count, sums and sums of squares, one row per
    cluster. Rows without a cluster or a value take no part. Another measure than ``silhouette_exact``; the two must
    not be compared.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    points = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)], F.col(f"`{cluster}`").alias("_c"))
    points = points.dropna().groupBy(*names, "_c").agg(F.count("*").alias("_w"))
    sizes = points.groupBy("_c").agg(
        F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(n)).alias(f"s{n}") for n in names],
        F.sum(F.col("_w") * sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))).alias("q"))
    clusters = sizes.agg(F.collect_list(F.struct(*sizes.columns)).alias("_all"))
    square = sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))

    def total(c: Column) -> Column:
        return F.greatest(c["n"] * square + c["q"] - 2 * sum((F.col(n) * c[f"s{n}"] for n in names), F.lit(0.0)), F.lit(0.0))

    placed = with_scalars(points, clusters)
    own = F.filter("_all", lambda c: c["_c"] == F.col("_c"))[0]
    others = F.filter("_all", lambda c: c["_c"] != F.col("_c"))
    a = total(own) / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(others, lambda c: total(c) / c["n"]))
    top = F.greatest(a, b)
    score = F.when((own["n"] > 1) & (top > 0), (b - a) / top).otherwise(0.0)
    found = placed.select("_w", F.size("_all").alias("k"), score.alias("score"))
    return found.agg(F.when(F.max("k") > 1, F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("value")).first()["value"]


def k_sweep(scaled: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int] = range(2, 9),
            sample: int = 15_000, restarts: int = 20, max_iter: int = 500, seed: int = 42) -> DataFrame:
    """(k, wcss, silhouette) for each k, all fitted together and scored on one sample."""
    taken = sample_n(scaled.select(key, *columns), sample, key, seed)
    points = stage(distinct_points(taken, columns), "sweep-points")
    with point_blocks(points, columns) as blocks:
        fits = fit_all(blocks, ks, restarts, max_iter, seed)
    labelled = points.withColumns({f"k{k}": model.assign(columns) for k, model in fits.items()})
    scores = {r["labelling"]: r["silhouette"] for r in silhouette_exact(
        labelled, columns, [f"k{k}" for k in ks], weight="weight").collect()}
    rows = [(k, fits[k].cost, scores[f"k{k}"]) for k in ks]
    return scaled.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def choose_k(sweep: DataFrame) -> int:
    """k of the largest silhouette, the smallest k on ties."""
    return sweep.orderBy(F.col("silhouette").desc(), "k").first()["k"]


def cluster_sizes(df: DataFrame, label: str, output: str = "JUMLAH") -> DataFrame:
    return (df.filter(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`"))
            .agg(F.count("*").alias(output)).orderBy(f"`{label}`"))
