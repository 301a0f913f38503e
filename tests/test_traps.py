"""Hand-made rows for every semantic trap."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regiometra.domain import DIMENSIONS, LAGGING, STATUS_ORDER, Columns, status_table
from regiometra.functions import coerce_numeric, normalize_code, order_bin, round_half_even
from regiometra.operators import aggregates as ag
from regiometra.operators import cleaning as cl
from regiometra.operators import features as ft
from regiometra.operators import filters as fl
from regiometra.operators import joins as jn
from regiometra.operators.quantiles import count_below, exact_quantiles


def one(spark, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {dtype}")


def column(df, name="x", order="id"):
    return [row[name] for row in df.orderBy(order).select(name).collect()]


def test_coerce_numeric(spark):
    df = one(spark, ["1.0d", " 1.0 ", "nan", "1,5", "", "1e3", None, "0x1p3", "2f", "inf", "\t7 "], "string")
    got = column(df.withColumn("x", coerce_numeric(F.col("x"))))
    assert got == [None, 1.0, None, None, None, 1000.0, None, None, None, math.inf, 7.0]


def test_normalize_code(spark):
    df = one(spark, ["0011", " 1101012003 ", "12.0", "9007199254740993"], "string")
    assert column(cl.normalize_codes(df, "x")) == ["11", "1101012003", "12", "9007199254740993"]
    assert column(cl.normalize_codes(one(spark, ["x", None], "string"), "x", strict=False)) == [None, None]
    for bad in ("x", None):
        with pytest.raises(PySparkException):
            one(spark, [bad], "string").select(normalize_code(F.col("x"))).collect()


def test_rounding_is_half_even_on_the_binary_value(spark):
    df = one(spark, [0.285, 1.005, 66.665], "double")
    assert column(df.withColumn("x", round_half_even(F.col("x"), 2))) == [0.28, 1.0, 66.67]


def test_order_bin_is_monotone_and_total(spark):
    values = [-math.inf, -1e300, -2.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, 1.0000001, 2.5, 1e300, math.inf]
    bins = column(one(spark, values, "double").withColumn("x", order_bin(F.col("x"))))
    assert bins == sorted(bins) and bins[5] == bins[6] == 0 and bins[4] < 0 < bins[7]


def test_drop_invalid_also_drops_missing(spark):
    df = one(spark, ["0.5", "closed", None], "string")
    assert column(cl.drop_invalid(df, "x")) == ["0.5"]
    reasons = cl.invalid_rows(df, "x", ["id"]).orderBy("id").collect()
    assert [(r["id"], r["reason"]) for r in reasons] == [(1, "closed"), (2, None)]


def test_patch_compares_keys_as_numbers(spark):
    df = spark.createDataFrame([("0012", "a"), ("13", "b")], "k string, v string")
    assert [r["v"] for r in cl.patch_cells(df, "k", "v", {12: "z"}).orderBy("k").collect()] == ["z", "b"]


def test_impute_median_averages_the_middle_and_ignores_nan(spark):
    df = one(spark, [1.0, 2.0, None, math.nan, 4.0, 9.0], "double")
    assert column(cl.impute_median(df, ["x"])) == [1.0, 2.0, 3.0, 3.0, 4.0, 9.0]
    assert column(cl.impute_median(one(spark, [None, None], "double"), ["x"])) == [None, None]


def test_mode_takes_smallest_on_ties(spark):
    df = one(spark, ["b", "a", "a", "b", None, None, None], "string")
    assert ag.mode_of(df, "x", "m").first()["m"] == "a"
    assert column(cl.impute_mode(df, "x")) == ["b", "a", "a", "b", "a", "a", "a"]
    grouped = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "z")], "g int, x string")
    got = {r["g"]: r["m"] for r in ag.group_mode(grouped, "g", "x", "m").collect()}
    assert got == {1: "a", 2: None}


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_forward_fill_stays_in_its_file(spark, chunk):
    rows = [("f", 0, "a"), ("f", 1, None), ("f", 2, None), ("f", 3, "b"), ("f", 4, None), ("g", 0, None), ("g", 1, "c")]
    df = spark.createDataFrame(rows, "file string, n long, x string")
    filled = cl.forward_fill(df, ["x", "absent"], "file", "n", chunk).orderBy("file", "n").collect()
    assert [r["x"] for r in filled] == ["a", "a", "a", "b", "b", None, "c"]


def test_null_count(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert tuple(cl.null_count(df, ["a", "b"]).first()) == (1, 2, 3)


def test_sum_of_nothing_is_zero_and_null_keys_vanish(spark):
    df = spark.createDataFrame([("k", None), ("k", math.nan), (None, 5.0)], "k string, x double")
    assert [tuple(r) for r in ag.group_sum(df, "k", "x", "s").collect()] == [("k", 0.0)]


def test_join_distinct_text(spark):
    rows = [("k", t, i) for i, t in enumerate(["x", "x ", "-", " ", "a", "x", None])] + [("e", "-", 0), ("n", None, 0)]
    df = spark.createDataFrame(rows, "k string, t string, i int")
    got = {r["k"]: r["o"] for r in ag.join_distinct_text(df, "k", "t", ["i"], "o").collect()}
    none = "Tidak ada rekomendasi spesifik"
    assert got == {"k": "x; x; a", "e": none, "n": none}


def test_collapse_children_counts_placeholders(spark):
    rows = [("k", "-", 1.0, "B", 0), ("k", " ", None, "A", 1), ("k", None, 2.0, None, 2), (None, "t", 1.0, "A", 3)]
    df = spark.createDataFrame(rows, "k string, t string, v double, g string, i int")
    names = {"count": "n", "total": "s", "joined": "j", "target": "m"}
    got = [tuple(r) for r in ag.collapse_children(df, "k", "t", "v", "g", ["i"], names).collect()]
    assert got == [("k", 2, 3.0, "Tidak ada rekomendasi spesifik", "A")]


def test_arg_min_ties_and_nulls(spark):
    rows = [(0, 0.2, 0.2, 0.9), (1, None, 0.5, 0.4), (2, None, None, None), (3, 0.3, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    label = ft.arg_min_column(dict(zip("abc", DIMENSIONS)))
    assert column(df.withColumn("x", label)) == ["Sosial", "Lingkungan", None, "Ekonomi"]


def test_ratio_to_mean(spark):
    df = spark.createDataFrame([(0, 2.0, True), (1, 4.0, True), (2, 9.0, False)], "id int, n double, m boolean")
    assert column(ft.ratio_to_mean(df, "n", F.col("m"), "x")) == [2 / 3, 4 / 3, 3.0]
    assert column(ft.ratio_to_mean(df, "n", F.lit(False), "x")) == [2.0, 4.0, 9.0]


def test_iqr_flags(spark):
    df = one(spark, [0.1, 0.4, 0.35, 0.8], "double")
    q = exact_quantiles(df, {"a": ("x", 0.25), "b": ("x", 0.75)}).first()
    assert q["a"] == pytest.approx(0.2875) and q["b"] == pytest.approx(0.5)
    assert column(ft.iqr_outlier_flags(df, {"x": "o"}), "o") == [False] * 4
    wide = one(spark, [1.0, 1.1, 1.2, 1.3, 50.0, None], "double")
    assert column(ft.iqr_outlier_flags(wide, {"x": "o"}), "o") == [False] * 4 + [True, False]
    assert ft.outlier_name("NILAI_IDM_2024") == "is_outlier_nilai"


def test_bands_follow_the_stored_status(spark):
    rows = [(0, 0.6872, "BERKEMBANG"), (1, 0.7072, "BERKEMBANG"), (2, 0.70, "MAJU"), (3, 0.8, None)]
    df = spark.createDataFrame(rows, "id int, v double, s string")
    got = column(df.withColumn("x", ft.near_upgrade_band("v", "s")))
    assert got == ["Potensi ke MAJU", "Biasa", "Biasa", "Biasa"]


def test_classify_bounds_are_lower_inclusive(spark):
    df = one(spark, [0.1, 0.4907, 0.5989, 0.7072, 0.8155, None], "double")
    assert column(df.withColumn("x", ft.classify_by_threshold("x"))) == [*STATUS_ORDER, None]


def test_labels_are_alphabetical_and_closed(spark):
    df = one(spark, ["SANGAT TERTINGGAL", "BERKEMBANG", "TERTINGGAL"], "string")
    coded = df.withColumn("c", ft.encode_label("x", STATUS_ORDER))
    assert column(coded, "c") == [3, 0, 4]
    assert column(coded.withColumn("x", ft.decode_label(F.col("c"), STATUS_ORDER))) == [
        "SANGAT TERTINGGAL", "BERKEMBANG", "TERTINGGAL"]
    for bad in ("LAIN", None):
        with pytest.raises(PySparkException):
            one(spark, [bad], "string").select(ft.encode_label("x", STATUS_ORDER)).collect()


def test_membership_of_null_is_false(spark):
    df = one(spark, ["TERTINGGAL", "MAJU", None], "string")
    assert column(df.withColumn("x", ft.is_member("x", LAGGING))) == [True, False, False]


def test_empty_choice_filters_nothing(spark):
    df = one(spark, ["a", "b", None], "string")
    assert fl.filter_members(df, {"x": [], "absent": ["q"]}).count() == 3
    assert column(fl.filter_members(df, {"x": ["a"]})) == ["a"]


def test_sample_clamps_or_raises_and_is_repeatable(spark):
    df = one(spark, list("abcdefgh"), "string")
    assert fl.sample_n(df, 100, "id").count() == 8
    with pytest.raises(ValueError):
        fl.sample_n(df, 100, "id", clamp=False)
    first = column(fl.sample_n(df, 3, "id"), "id")
    assert len(first) == 3 and first == column(fl.sample_n(df.repartition(5), 3, "id"), "id")


@pytest.mark.parametrize("groups,asked,shown", [(0, None, 0), (1, None, 1), (5, 3, 5), (6, None, 6), (30, None, 10),
                                                (30, 50, 20), (30, 2, 5)])
def test_top_list_size(groups, asked, shown):
    assert fl.clamp_top_n(groups, asked) == shown


def test_shares_divide_by_all_rows(spark):
    df = one(spark, ["a", "a", "b", None], "string")
    got = [tuple(r) for r in ag.value_share(df, "x").collect()]
    assert got == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert ag.value_share_where(df, F.lit(False), "x").count() == 0


def test_status_summary_covers_the_domain(spark):
    df = one(spark, ["MAJU", "MAJU", "LAIN", None], "string")
    got = [tuple(r) for r in ag.status_summary(df, "x", status_table(spark)).collect()]
    assert got == [(s, 2 if s == "MAJU" else 0, 50.0 if s == "MAJU" else 0.0) for s in STATUS_ORDER]
    assert ag.status_summary(df.limit(0), "x", status_table(spark)).count() == 0
    assert ag.status_summary(df, "absent", status_table(spark)).count() == 0


def test_group_rate_orders_and_survives_missing_keys(spark):
    rows = [("p", None, "MAJU"), ("q", "1", "TERTINGGAL"), ("q", "2", "MAJU"), (None, "3", "MAJU")]
    df = spark.createDataFrame(rows, "g string, k string, s string")
    got = [tuple(r) for r in ag.group_rate(df, "g", "k", ft.is_member("s", LAGGING)).collect()]
    assert got == [("q", 2, 1, 50.0), ("p", 0, 0, None)]


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, 0.1), (2.0, None, 0.1), (3.0, 5.0, 0.1), (4.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    m = {r["feature"]: r for r in ag.correlation_matrix(df, ["a", "b", "k", "absent"]).collect()}
    assert m["a"]["b"] == m["b"]["a"] == pytest.approx(-0.0524142418, abs=1e-9)
    assert m["a"]["a"] == 1.0 and m["k"]["k"] is None and m["a"]["k"] is None
    assert ag.correlation_matrix(df, ["a"]).count() == 0


def test_correlation_keeps_digits_far_from_zero(spark):
    rows = [(1e9 + i, 1e9 - 2.0 * i) for i in range(10)]
    m = ag.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    assert m["b"] == pytest.approx(-1.0, abs=1e-12)


def test_kpis_of_nothing_are_zero(spark):
    df = spark.createDataFrame([("p", "MAJU", 0.5), (None, None, None)], "g string, s string, v double")
    assert tuple(ag.kpis(df, "g", "s", "v", LAGGING, "MANDIRI").first()) == (2, 1, 0.0, 0.0, 0.5)
    assert tuple(ag.kpis(df.limit(0), "g", "s", "v", LAGGING, "MANDIRI").first()) == (0, 0, 0.0, 0.0, 0.0)
    assert tuple(ag.kpis(df.select("g"), "g", "s", "v", LAGGING, "MANDIRI").first()) == (2, 1, 0.0, 0.0, 0.0)


def test_percentile_rank_is_strict_over_all_rows(spark):
    df = one(spark, [1.0, 2.0, 3.0, None], "double")
    assert ag.percentile_rank(df, {"x": 2.0, "absent": 1.0}).first().asDict() == {"x": 25.0, "absent": 0.0}
    assert ag.percentile_rank(df.limit(0), {"x": 2.0}).first()["x"] == 0.0


def test_default_medians(spark):
    df = spark.createDataFrame([("1", None), ("x", None), ("4", None)], "a string, b double")
    assert tuple(ag.default_medians(df, ["a", "b", "c"]).first()) == (2.5, 0.0, 0.0)


def test_describe_skips_text(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b")], "n int, t string")
    rows = ag.describe(df, ["n", "t"]).collect()
    assert len(rows) == 1 and rows[0]["std"] == pytest.approx(2 ** 0.5) and rows[0]["q50"] == 2.0


def test_quantiles_by_group_match_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 4000), rng.normal(0, 3, 4000).round(3))]
    df = spark.createDataFrame(rows + [(9, None), (None, 1.0)], "g int, x double")
    wanted = {f"p{i}": ("x", p) for i, p in enumerate((0.0, 0.1, 0.25, 0.5, 0.9, 1.0))}
    got = {r["g"]: r for r in exact_quantiles(df, wanted, ["g"]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for g in got:
        values = [v for k, v in rows if k == g]
        for name, (_, p) in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_count_below_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    have, ask = rng.normal(size=500).round(2), rng.normal(size=80).round(2)
    below = count_below(spark.createDataFrame([(float(v),) for v in have], "x double"),
                        spark.createDataFrame([(float(v),) for v in ask], "x double"), ["x"])
    got = {r["value"]: r["below"] for r in below.collect()}
    assert got == {float(v) + 0.0: int((have < v).sum()) for v in ask}


def test_left_attach_keeps_rows_and_flags(spark):
    left = spark.createDataFrame([("1",), ("2",), ("2",)], "k string")
    right = spark.createDataFrame([("2", 7)], "`KODE DESA` string, n int")
    out = jn.left_attach(left, right, "k", "KODE DESA", "hit")
    assert out.columns == ["k", "n", "hit"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1", None, False), ("2", 7, True), ("2", 7, True)]


def test_column_bundle_follows_names():
    cols = Columns(social="a", economic="b", environment="c", score="d")
    assert cols.dimension_of == {"a": "Sosial", "b": "Ekonomi", "c": "Lingkungan"}
    assert cols.measures == ["a", "b", "c", "d"]


def test_quantiles_shuffle_bins_and_few_values(spark):
    """A continuous column: no exchange carries more records than bins per task, and the plan has no join."""
    from regiometra.operators.quantiles import exact_quantiles

    df = spark.range(0, 400_000, 1, 4).select((F.rand(3) + 1).alias("x"))
    found = exact_quantiles(df, {"low": ("x", 0.25), "mid": ("x", 0.5)})
    row = found.first()
    exact = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).first()["q"]
    assert [row["low"], row["mid"]] == pytest.approx(exact, abs=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "percentile" not in plan
    bins = df.select(order_bin(F.col("x")).alias("b")).distinct().count()
    assert bins < 6000 < 400_000


def test_quantiles_of_many_groups_take_the_other_way(spark, monkeypatch):
    from regiometra.operators import quantiles

    df = spark.range(3000).select((F.col("id") % 40).alias("g"), (F.col("id") * 7919 % 1009 / 3).alias("x"))
    wanted = {"a": ("x", 0.1), "b": ("x", 0.5)}
    few = sorted(quantiles.exact_quantiles(df, wanted, ["g"]).collect())
    monkeypatch.setattr(quantiles, "_BINS_TO_BROADCAST", 0)
    assert sorted(quantiles.exact_quantiles(df, wanted, ["g"]).collect()) == few
    by_spark = df.groupBy("g").agg(F.percentile("x", 0.1).alias("a"), F.percentile("x", 0.5).alias("b")).collect()
    assert [tuple(map(float, r)) for r in few] == [pytest.approx(tuple(map(float, r))) for r in sorted(by_spark)]


def test_correlations_of_two_hundred_columns(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 200)) + rng.normal(size=(300, 1)) + 1000
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7], data[:, 8], data[:, 9] = 2.5, np.nan, 2 * data[:, 10]
    names = [f"c{i}" for i in range(200)]
    frame = pd.DataFrame(data, columns=names)
    matrix = ag.correlation_matrix(spark.createDataFrame(frame).repartition(3), names).toPandas()
    assert matrix["feature"].tolist() == names
    got, want = matrix[names].to_numpy(float), frame.corr(min_periods=2).to_numpy()
    want[7, :] = want[:, 7] = np.nan
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.nanmax(np.abs(got - want)) < 1e-9

