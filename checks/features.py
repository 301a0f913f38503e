"""PRJ operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import (
    CASE_BAND, CASE_STATUS, CASE_WEAKEST, COLS, LAGGING_SQL, U, V, check, lines_view, r, rs, table, units_view,
)
from regiometra.domain import LAGGING, STATUS_ORDER
from regiometra.functions import round_half_even, trim_all
from regiometra.operators import features as ft

KEYS = ["unit", "n_rec", "prov", "flag"]
K = ", ".join(KEYS)


@check("prj1_arg_min_column", f"""WITH {V}, w AS (SELECT {K}, iks, ikl,
  CASE WHEN unit % 4 = 0 THEN NULL ELSE ike END AS ike FROM v) SELECT {K}, {CASE_WEAKEST} AS weakest FROM w""")
def _(spark, folder):
    v = lines_view(spark, folder).withColumn("ike", F.when(F.col("unit") % 4 != 0, F.col("ike")))
    return v.select(*KEYS, ft.arg_min_column(COLS.dimension_of).alias("weakest"))


@check("prj2_difference", f"WITH {V} SELECT {K}, iks - ike AS gap_e, iks - ikl AS gap_l FROM v")
def _(spark, folder):
    return lines_view(spark, folder).select(*KEYS, ft.difference("iks", "ike").alias("gap_e"),
                                            ft.difference("iks", "ikl").alias("gap_l"))


@check("prj3_abs_difference", f"WITH {V} SELECT {K}, abs(iks - ike) AS gap_e, abs(iks - ikl) AS gap_l FROM v")
def _(spark, folder):
    return lines_view(spark, folder).select(*KEYS, ft.abs_difference("iks", "ike").alias("gap_e"),
                                            ft.abs_difference("iks", "ikl").alias("gap_l"))


@check("prj4_ratio_to_mean", f"""WITH {U} SELECT unit, {rs('intensity')} AS intensity,
  n_rec / 1.0::DOUBLE AS unmatched FROM u""")
def _(spark, folder):
    rated = ft.ratio_to_mean(units_view(spark, folder), "n_rec", F.col("matched"), "intensity")
    both = ft.ratio_to_mean(rated, "n_rec", F.col("n_rec") < 0, "unmatched")
    return r(both.select("unit", "intensity", "unmatched"), "intensity")


_FENCE = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in ("iks", "ike", "ikl", "idm")
                   for n, p in (("a", 0.25), ("b", 0.75)))
_FLAGS = ", ".join(f"({c} < {c}_a - 1.5 * ({c}_b - {c}_a) OR {c} > {c}_b + 1.5 * ({c}_b - {c}_a)) "
                   f"AS is_outlier_{c}" for c in ("iks", "ike", "ikl", "idm"))
_OUT = f"WITH {V}, q AS (SELECT {_FENCE} FROM v), f AS (SELECT {K}, {_FLAGS} FROM v, q)"


@check("prj5_iqr_outlier_flag", f"{_OUT} SELECT * FROM f")
def _(spark, folder):
    flagged = ft.iqr_outlier_flags(lines_view(spark, folder), COLS.measures)
    return flagged.select(*KEYS, *[ft.outlier_name(c) for c in COLS.measures])


@check("ag21_outlier_rate", _OUT + " " + " UNION ALL ".join(
    f"SELECT 'is_outlier_{c}' AS flag, count(*) FILTER (is_outlier_{c}) AS n_flagged, "
    + rs(f"count(*) FILTER (is_outlier_{c})::DOUBLE / count(*) * 100") + " AS pct_flagged FROM f"
    for c in ("iks", "ike", "ikl", "idm")))
def _(spark, folder):
    from regiometra.operators.aggregates import outlier_rate
    flagged = ft.iqr_outlier_flags(lines_view(spark, folder), COLS.measures)
    return r(outlier_rate(flagged, [ft.outlier_name(c) for c in COLS.measures]), "pct_flagged")


@check("prj6_is_member", f"WITH {V} SELECT {K}, {LAGGING_SQL} AS lagging FROM v")
def _(spark, folder):
    return lines_view(spark, folder).select(*KEYS, ft.is_member("status", LAGGING).alias("lagging"))


@check("prj7_near_upgrade_band", f"WITH {V} SELECT {K}, {CASE_BAND} AS potensi_naik FROM v")
def _(spark, folder):
    from regiometra.plans.explore import with_band
    return with_band(lines_view(spark, folder), COLS).select(*KEYS, "potensi_naik")


_BANDS = """b AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'MAJU' WHEN 1 THEN 'BERKEMBANG' WHEN 2 THEN 'TERTINGGAL'
  WHEN 3 THEN 'MANDIRI' ELSE 'SANGAT TERTINGGAL' END AS status, n_nationkey * 0.04::DOUBLE AS low,
  n_nationkey * 0.04::DOUBLE + 0.01::DOUBLE + n_regionkey * 0.05::DOUBLE AS high, n_name AS label FROM nation)"""


@check("prj7_bands_from_a_table", f"""WITH {V}, {_BANDS} SELECT {K}, coalesce((SELECT min_by(label, low) FROM b
  WHERE b.status = v.status AND v.idm >= low AND v.idm < high), 'Biasa') AS potensi FROM v""")
def _(spark, folder):
    from regiometra.operators.lookups import band_from_table

    names = F.array(*[F.lit(s) for s in ("MAJU", "BERKEMBANG", "TERTINGGAL", "MANDIRI", "SANGAT TERTINGGAL")])
    low = F.col("n_nationkey") * F.lit(0.04)
    bands = table(spark, folder, "nation").select(
        F.get(names, (F.col("n_nationkey") % 5).cast("int")).alias("status"), low.alias("low"),
        (low + F.lit(0.01) + F.col("n_regionkey") * F.lit(0.05)).alias("high"), F.col("n_name").alias("label"))
    return band_from_table(lines_view(spark, folder), "idm", "status", bands, "potensi").select(*KEYS, "potensi")


@check("prj8_classify_by_threshold", f"WITH {V} SELECT {K}, {CASE_STATUS} AS status FROM v")
def _(spark, folder):
    return lines_view(spark, folder).select(*KEYS, ft.classify_by_threshold("idm").alias("status"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@check("prj9_one_hot", "SELECT c_custkey, " + ", ".join(
    f"coalesce(seg = '{s}', false) AS seg_{s}" for s in _SEGMENTS)
    + " FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)")
def _(spark, folder):
    c = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))
    encoded = c.withColumns(ft.one_hot("seg", _SEGMENTS))
    return encoded.select("c_custkey", *ft.select_prefixed(encoded, "seg_"))


_CODE = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(sorted(STATUS_ORDER))) + " END"


@check("prj10_encode_decode_label", f"WITH {V} SELECT {K}, {_CODE}::INT AS code, status AS decoded FROM v")
def _(spark, folder):
    coded = lines_view(spark, folder).withColumn("code", ft.encode_label("status", STATUS_ORDER))
    return coded.select(*KEYS, "code", ft.decode_label(F.col("code"), STATUS_ORDER).alias("decoded"))


@check("prj11_derive_label", f"WITH {V} SELECT {K}, 'Klaster ' || n_rec AS cluster_label FROM v")
def _(spark, folder):
    return lines_view(spark, folder).select(
        *KEYS, ft.derive_label("Klaster ", F.col("n_rec")).alias("cluster_label"))


@check("prj12_rename_columns", f"WITH {V} SELECT unit AS KODE, prov AS NAMA, idm AS NILAI FROM v")
def _(spark, folder):
    return ft.rename_columns(lines_view(spark, folder), {"unit": "KODE", "prov": "NAMA", "idm": "NILAI"})


@check("prj13_balanced_flag", f"""WITH {V} SELECT {K},
  greatest(iks, ike, ikl) - least(iks, ike, ikl) < 0.1::DOUBLE AS balanced FROM v""")
def _(spark, folder):
    return lines_view(spark, folder).select(*KEYS, ft.balanced_flag(["iks", "ike", "ikl"]).alias("balanced"))


@check("fn_scalar_functions", f"""SELECT s_suppkey, trim(upper('  ' || s_name || ' ')) AS shown,
  lower(split_part('IKS_' || s_suppkey, '_', 1)) AS head, s_name LIKE 'Supplier%' AS prefixed,
  {rs('s_acctbal / 7', 1)} AS r1, {rs('s_acctbal / 7', 2)} AS r2, {rs('s_acctbal / 7', 4)} AS r4
  FROM supplier""")
def _(spark, folder):
    s, seventh = table(spark, folder, "supplier"), F.col("s_acctbal") / 7
    return s.select(
        "s_suppkey", trim_all(F.upper(F.concat(F.lit(" \t"), F.col("s_name"), F.lit(" ")))).alias("shown"),
        F.lower(F.split_part(F.concat(F.lit("IKS_"), F.col("s_suppkey")), F.lit("_"), F.lit(1))).alias("head"),
        F.col("s_name").startswith("Supplier").alias("prefixed"),
        *[round_half_even(seventh, d).alias(f"r{d}") for d in (1, 2, 4)])
