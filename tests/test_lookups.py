"""Bands and patches from tables, and reports from cells."""

import random

import pytest
from pyspark.sql import functions as F

from checks.bindings import COLS, modeling_view
from regiometra.domain import LAGGING, TOP_STATUS
from regiometra.operators import aggregates as agg
from regiometra.operators import cells as cl
from regiometra.operators import joins, lookups
from regiometra.plans.report import report

BANDS = "status string, low double, high double, label string"


@pytest.mark.parametrize("broadcast", [True, False])
def test_bands_of_all_widths_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lookups, "_ROWS_TO_BROADCAST", -1)
    rng = random.Random(7)
    bands = [(rng.choice("ab"), low, low + rng.choice([1e-9, 1e-3, 0.3, 50.0, 1e9]) * rng.random(), f"n{i}")
             for i in range(60) for low in [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 3)]]
    bands += [("a", -1.0, 1.0, "over zero"), ("b", float("-inf"), float("inf"), "all"), (None, 0.0, 9.0, "no"), ("a", 2.0, 1.0, "none"), ("a", None, 1.0, "open")]
    values = [b[1] for b in bands if b[1] is not None] + [b[2] for b in bands] + [rng.gauss(0, 5) for _ in range(200)] + [0.0, float("nan"), None]
    rows = [(i, s, v) for i, (s, v) in enumerate((s, v) for s in ("a", "b", "c", None) for v in values)]
    df = spark.createDataFrame(rows, "id int, s string, v double")
    found = lookups.band_from_table(df, "v", "s", spark.createDataFrame(bands, BANDS), "band", "-")
    assert found.columns == ["id", "s", "v", "band"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["id"]: r["band"] for r in found.collect()}
    for i, s, v in rows:
        hits = [b for b in bands if None not in b[:3] and b[0] == s and v is not None and b[1] <= v < b[2]]
        assert got[i] == (min(hits, key=lambda b: b[1:])[3] if hits else "-")
    none = spark.createDataFrame([], BANDS)
    assert {r["band"] for r in lookups.band_from_table(df, "v", "s", none, "band", "-").collect()} == {"-"}


def test_patches_by_text_and_number(spark):
    df = spark.createDataFrame([("1", 1.0, "x"), ("01", 2.0, "y"), ("2", None, "z"), (None, 3.0, "w"), ("q", 4.0, "v")], "k string, n double, t string")
    text = spark.createDataFrame([("1", "n", "9.5"), ("q", "t", None), ("2", "n", "7"), ("2", "n", "8"), ("2", "other", "1"), (None, "t", "!")],
                                 "key string, column string, value string")
    got = sorted(map(tuple, lookups.patch_from_table(df, "k", text, ["n", "t"]).collect()), key=str)
    assert got == sorted([("1", 9.5, "x"), ("01", 2.0, "y"), ("2", 8.0, "z"), (None, 3.0, "w"), ("q", 4.0, None)], key=str)
    number = spark.createDataFrame([(1, "t", "both")], "key int, column string, value string")
    got = {r["k"]: r["t"] for r in lookups.patch_from_table(df, "k", number, ["t"]).collect()}
    assert got == {"1": "both", "01": "both", "2": "z", None: "w", "q": "v"}


def test_a_report_is_one_scan(spark, monkeypatch):
    staged, own = [], cl.stage
    monkeypatch.setattr(cl, "stage", lambda df, name: staged.append(name) or own(df, name))
    units = modeling_view(spark, "/root/testdata/sf0.001")
    tables = report(units, cols=COLS)
    for name in ("kpis", "status_summary", "lagging_rate", "lagging_top", "weakest_share", "weakest_share_lagging"):
        assert tables[name].count() > 0
    assert staged == ["cells"]
    plain = agg.kpis(units, COLS.region, COLS.status, COLS.score, LAGGING, TOP_STATUS).first()
    assert tuple(tables["kpis"].first()) == pytest.approx(tuple(plain))
    flagged = units.filter(F.col(COLS.status).isin(LAGGING)).count()
    assert tables["lagging_rate"].agg(F.sum("desa_tertinggal")).first()[0] == flagged


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_small_lookup_does_not_gather_rows_by_key(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "_ROWS_TO_BROADCAST", -1)
    keys = ["a", "a", "b", "c", None]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    entries = [("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 9), ("z", 3)]
    found = joins.lookup_explode(df, "k", spark.createDataFrame(entries, "key string, seq int"), "key", ["seq"])
    assert found.columns == ["id", "k", "seq"]
    assert sorted(map(tuple, found.collect())) == sorted(
        (i, k, n) for i, k in enumerate(keys) for key, n in entries if k is not None and k == key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" not in plan and "BroadcastHashJoin" in plan) == broadcast
