"""Segmentation: scale, sweep K on a sample, fit, number, score and profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.domain import STATUS_ORDER, Columns
from regiometra.operators import aggregates as agg
from regiometra.operators import clustering as km
from regiometra.operators.filters import sample_n
from regiometra.operators.kmeans import fit_all, point_blocks


@dataclass(frozen=True)
class Segmentation:
    model: PipelineModel
    k: int
    silhouette: float | None
    clustered: DataFrame
    tables: dict[str, DataFrame]


def fit_clusters(modeling: DataFrame, k: int, cols: Columns = Columns(), restarts: int = 20,
                 max_iter: int = 500, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Pipeline and centroids (original units) of the best of ``restarts`` fits on all rows."""
    scaler = km.Scaler.fit(modeling, cols.indices)
    points = scaler.stage().transform(km.distinct_points(modeling, cols.indices))
    with point_blocks(points, [f"_z{i}" for i in range(len(cols.indices))]) as blocks:
        best = fit_all(blocks, [k], restarts, max_iter, seed)[k]
    model = km.cluster_model(scaler, best, cols.cluster, cols.cluster_label)
    return model, km.centroids(scaler, best, modeling, cols.cluster)


def cluster_points(clustered: DataFrame, columns: Sequence[str], cols: Columns = Columns(),
                   n: int | None = None) -> DataFrame:
    """Points for a 2-D or 3-D chart: rows with a cluster; absent columns give no table."""
    needed = [*columns, cols.cluster]
    if any(c not in clustered.columns for c in needed):
        return clustered.sparkSession.createDataFrame([], "x double").drop("x")
    placed = clustered.filter(F.col(f"`{cols.cluster}`").isNotNull())
    if n is not None:
        placed = sample_n(placed.select(cols.unit, *needed), n, cols.unit)
    return placed.select(*needed)


def final_silhouette(clustered: DataFrame, cols: Columns = Columns(), sample: int = 10_000,
                     seed: int = 42) -> DataFrame:
    """Exact silhouette in scaled space on a sample of at most ``sample`` rows."""
    scaled = km.standardize(clustered.select(cols.unit, cols.cluster, *cols.indices), cols.indices)
    taken = sample_n(scaled, sample, cols.unit, seed)
    return km.silhouette_exact(taken, cols.indices, [cols.cluster])


def segment(modeling: DataFrame, cols: Columns = Columns(), ks: Sequence[int] = range(2, 9),
            restarts: int = 20, max_iter: int = 500, sample: int = 15_000,
            silhouette_sample: int = 10_000, seed: int = 42) -> Segmentation:
    """The whole flow; the sweep, the fit and the silhouette run at once, the tables are lazy."""
    scaled = km.standardize(modeling.select(cols.unit, *cols.indices), cols.indices)
    sweep = km.k_sweep(scaled, cols.indices, cols.unit, ks, sample, restarts, max_iter, seed)
    k = km.choose_k(sweep)
    model, centers = fit_clusters(modeling, k, cols, restarts, max_iter, seed)
    clustered = model.transform(modeling)
    means = [*cols.measures, cols.child_count, cols.child_total]
    tables = {
        "scaled_describe": agg.describe(scaled, cols.indices, digits=4),
        "sweep": sweep,
        "sizes": km.cluster_sizes(clustered, cols.cluster_label),
        "centroids": centers,
        "points_2d": cluster_points(clustered, [cols.environment, cols.economic], cols),
        "points_3d": cluster_points(clustered, [cols.environment, cols.economic, cols.social], cols),
        "profile": agg.group_profile_mean(clustered, cols.cluster_label, means),
        "status_mix": agg.crosstab_row_percent(clustered, cols.cluster_label, cols.status, STATUS_ORDER),
    }
    silhouette = final_silhouette(clustered, cols, silhouette_sample, seed).first()["silhouette"]
    return Segmentation(model, k, silhouette, clustered, tables)
