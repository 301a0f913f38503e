"""The summaries of any filter from one table of cells.

Units are grouped once by region, status and weakest dimension, with counts and sums. That table is small and stored;
indicators, status summary, rates and shares of every choice of regions and statuses follow from it, and no choice
reads the units again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.domain import LAGGING, STATUS_ORDER, TOP_STATUS, Columns, status_table
from regiometra.operators import aggregates as agg
from regiometra.operators.features import is_member
from regiometra.operators.filters import filter_members
from regiometra.session import stage


@dataclass(frozen=True)
class Cells:
    """Stored cells of units, or a choice of them; an absent column of the units is absent here."""

    table: DataFrame
    cols: Columns
    has_unit: bool = True

    @classmethod
    def build(cls, modeling: DataFrame, cols: Columns = Columns()) -> Cells:
        keys = [c for c in (cols.region, cols.status, cols.weakest) if c in modeling.columns]
        return cls(stage(agg.unit_cells(modeling, keys, cols.unit, cols.score), "cells"), cols, cols.unit in modeling.columns)

    def where(self, regions: Sequence[str] = (), statuses: Sequence[str] = ()) -> Cells:
        """The cells of a choice; an empty list chooses all."""
        chosen = filter_members(self.table, {self.cols.region: list(regions), self.cols.status: list(statuses)})
        return Cells(chosen, self.cols, self.has_unit)

    def _lagging(self) -> Column | None:
        return is_member(self.cols.status, LAGGING) if self.cols.status in self.table.columns else None

    def kpis(self) -> DataFrame:
        return agg.cell_kpis(self.table, self.cols.region, self.cols.status, LAGGING, TOP_STATUS)

    def status_summary(self) -> DataFrame:
        domain = status_table(self.table.sparkSession, STATUS_ORDER)
        return agg.status_summary(self.table, self.cols.status, domain, weight="_n")

    def lagging_rate(self) -> DataFrame:
        return agg.cell_rate(self.table, self.cols.region, self._lagging() if self.has_unit else None)

    def weakest_share(self) -> DataFrame:
        return agg.value_share(self.table, self.cols.weakest, "DIMENSI", weight="_n")

    def weakest_share_lagging(self) -> DataFrame:
        flag = self._lagging()
        return agg.value_share(self.table.filter(F.lit(False) if flag is None else flag), self.cols.weakest, "DIMENSI", weight="_n")
