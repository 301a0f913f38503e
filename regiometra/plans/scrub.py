"""Raw unit table and recommendation sheets to the modelling table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.domain import IDENTITY_COLUMNS, JUNK_COLUMNS, NAME_PATCHES, NO_RECORD_TEXT, Columns
from regiometra.functions import coerce_numeric
from regiometra.operators import cleaning as clean
from regiometra.operators.aggregates import collapse_children
from regiometra.operators.features import arg_min_column, difference, iqr_outlier_flags, ratio_to_mean
from regiometra.operators.joins import left_attach
from regiometra.session import stage
from regiometra.sources.sheets import SheetFolder, fill_identity
from regiometra.sources.tables import read_raw_csv


@dataclass(frozen=True)
class Scrubbed:
    """``modeling`` is the result; ``invalid`` and ``rejects`` say what was left out of it."""

    modeling: DataFrame
    invalid: DataFrame
    rejects: DataFrame


def valid_units(raw: DataFrame, cols: Columns, patches: Mapping[Any, Any] = NAME_PATCHES) -> DataFrame:
    """Drop invalid units and junk columns, patch names, normalise codes, coerce numbers."""
    valid = clean.drop_invalid(raw, cols.social)
    named = clean.patch_cells(valid, cols.unit, cols.unit_name, patches)
    typed = clean.coerce_columns(clean.normalize_codes(named, cols.unit), cols.measures)
    return clean.drop_if_present(typed, JUNK_COLUMNS)


def impute_units(valid: DataFrame, cols: Columns) -> DataFrame:
    """Missing measures get the median, a missing status the mode, of the valid units."""
    return clean.impute_mode(clean.impute_median(valid, cols.measures), cols.status)


def collapse_recommendations(rows: DataFrame, cols: Columns) -> DataFrame:
    """One row per unit from the rows of all sheets; rows without a code are dropped."""
    coded = clean.normalize_codes(rows, cols.child_unit, strict=False)
    valued = coded.withColumn(cols.child_value, coerce_numeric(F.col(f"`{cols.child_value}`")))
    return collapse_children(
        valued, cols.child_unit, cols.child_text, cols.child_value, cols.child_target,
        ["position"],
        {"count": cols.child_count, "total": cols.child_total, "joined": cols.child_joined,
         "target": cols.target})


def attach_recommendations(units: DataFrame, collapsed: DataFrame, cols: Columns) -> DataFrame:
    """Left join with a match flag; units without records get 0, 0.0, a text and their own status."""
    joined = left_attach(units, collapsed, cols.unit, cols.child_unit, cols.matched)
    filled = clean.fill_constant(joined, {cols.child_count: 0, cols.child_total: 0.0,
                                          cols.child_joined: NO_RECORD_TEXT})
    return clean.fill_from(filled, cols.target, cols.status)


def derive_features(joined: DataFrame, cols: Columns) -> DataFrame:
    """Weakest dimension, signed gaps, intensity and outlier flags."""
    gaps = joined.withColumns({
        cols.weakest: arg_min_column(cols.dimension_of),
        cols.gap_economic: difference(cols.social, cols.economic),
        cols.gap_environment: difference(cols.social, cols.environment)})
    rated = ratio_to_mean(gaps, cols.child_count, F.col(f"`{cols.matched}`"), cols.intensity)
    return iqr_outlier_flags(rated, cols.measures)


def scrub(spark: SparkSession, units_csv: str, sheets: str, cols: Columns = Columns(),
          header_row: int = 3, patches: Mapping[Any, Any] = NAME_PATCHES) -> Scrubbed:
    """The whole flow.

    Three tables are staged because several aggregates read them, and text would be parsed
    again each time: the valid units, the filled sheet rows, and the joined units.
    """
    raw = read_raw_csv(spark, units_csv)
    folder = SheetFolder(spark, sheets, header_row)
    rows = stage(fill_identity(folder.rows(), IDENTITY_COLUMNS), "sheet-rows")
    collapsed = collapse_recommendations(rows, cols)
    units = impute_units(stage(valid_units(raw, cols, patches), "valid-units"), cols)
    joined = stage(attach_recommendations(units, collapsed, cols), "joined")
    return Scrubbed(
        modeling=derive_features(joined, cols),
        invalid=clean.invalid_rows(raw, cols.social, [cols.unit_name, cols.unit]),
        rejects=folder.rejects)
