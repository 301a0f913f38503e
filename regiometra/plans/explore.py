"""Exploration of the modelling table: every table the study prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.domain import LAGGING, UPGRADE_BANDS, Columns
from regiometra.operators import aggregates as agg
from regiometra.operators.features import is_member, near_upgrade_band
from regiometra.operators.filters import sample_n, select_top, sort_by, top_n
from regiometra.plans.tables import Tables

BAND_COLUMN = "potensi_naik"


def region_profile(modeling: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Median of the four measures, modal status and number of units per region, by name."""
    medians = {name: column for name, column in zip(
        ("IKS_median", "IKE_median", "IKL_median", "NILAI_IDM_median"), cols.measures)}
    return agg.group_profile_median(modeling, cols.region, medians, cols.status,
                                    "STATUS_IDM_modus", cols.unit, "jumlah_desa").orderBy(cols.region)


def lagging_rate(modeling: DataFrame, cols: Columns = Columns()) -> DataFrame:
    flag = is_member(cols.status, LAGGING) if cols.status in modeling.columns else None
    return agg.group_rate(modeling, cols.region, cols.unit, flag)


def with_band(modeling: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return modeling.withColumn(BAND_COLUMN, near_upgrade_band(cols.score, cols.status))


def scatter_points(modeling: DataFrame, n: int = 5000, cols: Columns = Columns(),
                   clamp: bool = True) -> DataFrame:
    """(economic, social, status) of exactly n sampled units."""
    needed = [cols.economic, cols.social, cols.status]
    if any(c not in modeling.columns for c in needed):
        return modeling.sparkSession.createDataFrame([], "x double").drop("x")
    return sample_n(modeling.select(*needed, cols.unit), n, cols.unit, clamp=clamp).select(*needed)


def explore(modeling: DataFrame, cols: Columns = Columns(), sample: int = 5000) -> Tables:
    """Every table of the exploration by name; only those that are read are computed."""
    near_middle = UPGRADE_BANDS[2][3]
    closest = [cols.region, cols.district, cols.subdistrict, cols.unit_name, cols.score,
               cols.weakest, cols.child_count]
    return Tables({
        "describe": lambda: agg.describe(modeling, cols.correlated),
        "status_counts": lambda: agg.value_counts(modeling, cols.status),
        "status_mode": lambda: agg.mode_of(modeling, cols.status, cols.status),
        "lagging_top": lambda: top_n(lagging_rate(modeling, cols), "persentase_tertinggal",
                                     cols.region, 10),
        "status_share": lambda: agg.value_share(modeling, cols.status),
        "weakest_share": lambda: agg.value_share(modeling, cols.weakest, "DIMENSI"),
        "weakest_share_lagging": lambda: agg.value_share_where(
            modeling, is_member(cols.status, LAGGING), cols.weakest, value_name="DIMENSI"),
        "band_counts": lambda: agg.value_counts(with_band(modeling, cols), BAND_COLUMN),
        "closest_to_upgrade": lambda: select_top(
            with_band(modeling, cols), F.col(BAND_COLUMN) == near_middle, cols.score, cols.unit,
            closest, 5),
        "correlation": lambda: agg.correlation_matrix(modeling, cols.correlated),
        "scatter": lambda: scatter_points(modeling, sample, cols),
        "region_profile": lambda: region_profile(modeling, cols),
        "region_profile_by_score": lambda: sort_by(region_profile(modeling, cols),
                                                   "NILAI_IDM_median", cols.region),
    })
