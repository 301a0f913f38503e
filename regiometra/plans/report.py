"""The filtered report: what the dashboard's pages show, as tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from regiometra.domain import Columns
from regiometra.operators import aggregates as agg
from regiometra.operators.cells import Cells
from regiometra.operators.filters import dashboard_top, distinct_options, filter_members, sort_by
from regiometra.plans.cluster import cluster_points
from regiometra.plans.explore import region_profile, scatter_points
from regiometra.plans.tables import Tables
from regiometra.sources.tables import materialize_if_absent, write_csv


def region_summary(spark: SparkSession, path: str, modeling: DataFrame,
                   cols: Columns = Columns()) -> DataFrame:
    """The stored region profile, computed and stored the first time."""
    types = {f"{m}_median": "double" for m in ("IKS", "IKE", "IKL", "NILAI_IDM")}
    return materialize_if_absent(spark, path, cols.region, lambda: region_profile(modeling, cols),
                                 {**types, "jumlah_desa": "bigint"})


def filter_options(modeling: DataFrame, cols: Columns = Columns()) -> dict[str, DataFrame]:
    """Choices of the region filter, and the first five as its default."""
    return {"regions": distinct_options(modeling, cols.region),
            "default_regions": distinct_options(modeling, cols.region, 5)}


def report(modeling: DataFrame, regions: Sequence[str] = (), statuses: Sequence[str] = (),
           clustered: DataFrame | None = None, region_stats: DataFrame | None = None,
           top: int | None = None, sample: int = 5000, cols: Columns = Columns(), cells: Cells | None = None) -> Tables:
    """Named lazy tables after filtering; an empty choice filters nothing.

    Indicators, rates and shares come from one table of cells, made in one scan when the first of them is asked for,
    or given as ``cells``, so that many choices share it. The region profile is not filtered, the clustered table is
    filtered on its own.
    """
    choices = {cols.region: list(regions), cols.status: list(statuses)}
    rows = filter_members(modeling, choices)

    @functools.cache
    def chosen() -> Cells:
        return (cells or Cells.build(modeling, cols)).where(regions, statuses)

    tables = {
        "kpis": lambda: chosen().kpis(),
        "status_summary": lambda: chosen().status_summary(),
        "lagging_rate": lambda: chosen().lagging_rate(),
        "lagging_top": lambda: dashboard_top(chosen().lagging_rate(), "persentase_tertinggal", cols.region, top),
        "weakest_share": lambda: chosen().weakest_share(),
        "weakest_share_lagging": lambda: chosen().weakest_share_lagging(),
        "correlation": lambda: agg.correlation_matrix(rows, cols.correlated),
        "scatter": lambda: scatter_points(rows, sample, cols),
    }
    if region_stats is not None:
        tables["region_stats"] = lambda: sort_by(region_stats, "NILAI_IDM_median", cols.region)
    if clustered is not None:
        view = filter_members(clustered, choices)
        tables |= {
            "cluster_kpis": lambda: agg.cluster_kpis(view, cols.cluster),
            "cluster_summary": lambda: agg.cluster_summary(
                view, cols.cluster_label, cols.cluster, [*cols.measures, cols.child_count], cols.status),
            "cluster_points_2d": lambda: cluster_points(view, [cols.environment, cols.economic], cols),
            "cluster_points_3d": lambda: cluster_points(
                view, [cols.social, cols.environment, cols.economic], cols),
        }
    return Tables(tables)


def filtered_extract(modeling: DataFrame, path: str, regions: Sequence[str] = (),
                     statuses: Sequence[str] = (), cols: Columns = Columns()) -> None:
    """The data explorer's download: the filtered rows as CSV without a byte order mark."""
    write_csv(filter_members(modeling, {cols.region: list(regions), cols.status: list(statuses)}), path)
