"""CLN and FLT operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import COLS, LAGGING_SQL, V, check, lines_view, r, rs, table
from regiometra.operators import cleaning as cl
from regiometra.operators import filters as fl

# Reads the same in Spark and in DuckDB.
DIRTY = ("CASE WHEN o_orderkey % 97 = 0 THEN 'closed' WHEN o_orderkey % 89 = 0 THEN ' 7.25 ' "
         "WHEN o_orderkey % 83 = 0 THEN '1.0d' WHEN o_orderkey % 79 = 0 THEN 'nan' "
         "WHEN o_orderkey % 73 = 0 THEN '1,5' WHEN o_orderkey % 71 = 0 THEN '' "
         "WHEN o_orderkey % 67 = 0 THEN NULL WHEN o_orderkey % 61 = 0 THEN '1e3' "
         "ELSE CAST(o_totalprice AS VARCHAR(40)) END")
_DIRTY = (f"d AS (SELECT *, CASE WHEN isnan(x) THEN NULL ELSE x END AS v FROM "
          f"(SELECT *, TRY_CAST(trim(txt) AS DOUBLE) AS x FROM "
          f"(SELECT *, {DIRTY} AS txt FROM orders)))")


def dirty(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.withColumn("txt", F.expr(DIRTY.replace("VARCHAR(40)", "STRING")))


@check("cln1_coerce_numeric", f"WITH {_DIRTY} SELECT o_orderkey, v AS txt FROM d")
def _(spark, folder):
    return cl.coerce_columns(dirty(spark, folder), ["txt", "absent"]).select("o_orderkey", "txt")


@check("cln2_invalid_rows", f"WITH {_DIRTY} SELECT o_orderkey, txt AS reason FROM d WHERE v IS NULL")
def _(spark, folder):
    return cl.invalid_rows(dirty(spark, folder), "txt", ["o_orderkey"])


@check("cln3_drop_invalid", f"WITH {_DIRTY} SELECT o_orderkey, o_orderstatus FROM d WHERE v IS NOT NULL")
def _(spark, folder):
    return cl.drop_invalid(dirty(spark, folder), "txt").select("o_orderkey", "o_orderstatus")


@check("cln4_patch_cell", """SELECT o_orderkey, CASE o_orderkey WHEN 5 THEN 'PATCHED'
  WHEN 77 THEN 'SECOND' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, folder):
    keyed = table(spark, folder, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    patched = cl.patch_cells(keyed, "o_orderkey", "o_orderpriority", {5: "PATCHED", 77: "SECOND"})
    return patched.select(F.col("o_orderkey").cast("bigint"), "o_orderpriority")


@check("cln4_patches_from_a_table", """WITH p AS (SELECT * FROM orders WHERE o_orderkey IN
  (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000))
  SELECT o.o_orderkey, CASE WHEN p.o_orderkey IS NULL OR p.o_orderkey % 3 = 1 THEN o.o_orderpriority
  ELSE 'P' || p.o_custkey END AS o_orderpriority, CASE WHEN p.o_orderkey % 3 = 0 THEN NULL
  WHEN p.o_orderkey % 3 = 1 THEN p.o_custkey / 2.0::DOUBLE ELSE o.o_totalprice END AS o_totalprice
  FROM orders o LEFT JOIN p USING (o_orderkey)""")
def _(spark, folder):
    from regiometra.operators.lookups import patch_from_table

    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").cast("double"))
    first, k = orders.orderBy("o_orderkey").limit(1000), F.col("o_orderkey")
    text = first.where(k % 3 != 1).select(k.alias("key"), F.lit("o_orderpriority").alias("column"), F.concat(F.lit("P"), "o_custkey").alias("value"))
    price = first.where(k % 3 != 2).select(k.alias("key"), F.lit("o_totalprice").alias("column"),
                                           F.when(k % 3 == 1, (F.col("o_custkey") / 2).cast("string")).alias("value"))
    keyed = orders.withColumn("o_orderkey", k.cast("string"))
    patched = patch_from_table(keyed, "o_orderkey", text.unionByName(price), ["o_orderpriority", "o_totalprice"])
    return patched.select(F.col("o_orderkey").cast("bigint"), "o_orderpriority", "o_totalprice")


@check("cln5_normalize_code", """SELECT o_orderkey, o_orderkey::VARCHAR AS strict_code,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS lenient_code FROM orders""")
def _(spark, folder):
    codes = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit(" 00"), F.col("o_orderkey"), F.lit(" ")).alias("strict_code"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE CONCAT(o_orderkey, '.0') END")
        .alias("lenient_code"))
    return cl.normalize_codes(cl.normalize_codes(codes, "strict_code"), "lenient_code", strict=False)


_HOLES = ("h AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, "
          "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 END AS rest, "
          "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg, "
          "c_mktsegment FROM customer)")


def holes(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 END AS rest",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg", "c_mktsegment")


@check("cln6_impute_median", f"""WITH {_HOLES} SELECT c_custkey,
  {rs('coalesce(bal, (SELECT median(bal) FROM h))')} AS bal,
  coalesce(rest, (SELECT median(rest) FROM h))::DOUBLE AS rest FROM h""")
def _(spark, folder):
    filled = cl.impute_median(holes(spark, folder), ["bal", "rest"])
    return r(filled, "bal").select("c_custkey", "bal", "rest")


@check("cln7_impute_mode", f"""WITH {_HOLES} SELECT c_custkey, coalesce(seg, (SELECT seg FROM h
  WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM h""")
def _(spark, folder):
    return cl.impute_mode(holes(spark, folder), "seg").select("c_custkey", "seg")


@check("cln8_drop_if_present", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, folder):
    return cl.drop_if_present(table(spark, folder, "customer"),
                              ["c_nationkey", "c_mktsegment", "Unnamed: 14"])


@check("cln9_null_count", f"""WITH {_HOLES}, n AS (SELECT count(*) - count(bal) AS bal,
  count(*) - count(rest) AS rest, count(*) - count(seg) AS seg FROM h)
  SELECT *, bal + rest + seg AS n_missing FROM n""")
def _(spark, folder):
    return cl.null_count(holes(spark, folder), ["bal", "rest", "seg"])


@check("cln10_forward_fill", """WITH e AS (SELECT event_id, user_id,
  CASE WHEN event_id % 5 = 0 THEN value END AS value,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS event_type FROM events)
  SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER w AS value,
  last_value(event_type IGNORE NULLS) OVER w AS event_type FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, folder):
    sparse = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "CASE WHEN event_id % 5 = 0 THEN value END AS value",
        "CASE WHEN event_id % 3 = 0 THEN event_type END AS event_type")
    # Runs of 512 ids, so that values also cross runs on small tables.
    return cl.forward_fill(sparse, ["value", "event_type", "absent"], "user_id", "event_id", chunk=512)


@check("cln11_fill_constant", f"""WITH {_HOLES} SELECT c_custkey, coalesce(bal, 0.0) AS bal,
  coalesce(rest, 0) AS rest, coalesce(seg, 'Tidak ada data rekomendasi') AS seg FROM h""")
def _(spark, folder):
    filled = cl.fill_constant(holes(spark, folder),
                              {"bal": 0.0, "rest": 0, "seg": "Tidak ada data rekomendasi"})
    return filled.drop("c_mktsegment")


@check("cln12_fill_from", f"WITH {_HOLES} SELECT c_custkey, coalesce(seg, c_mktsegment) AS seg FROM h")
def _(spark, folder):
    return cl.fill_from(holes(spark, folder), "seg", "c_mktsegment").select("c_custkey", "seg")


@check("flt1_filter_members", f"""WITH {V} SELECT unit, prov, status, n_rec FROM v
  WHERE prov IN ('NATION_1', 'NATION_2', 'NATION_3') AND {LAGGING_SQL}""")
def _(spark, folder):
    kept = fl.filter_members(lines_view(spark, folder), {
        "prov": ["NATION_1", "NATION_2", "NATION_3"], "status": ["TERTINGGAL", "SANGAT TERTINGGAL"],
        "flag": [], "absent": ["x"]})
    return kept.select("unit", "prov", "status", "n_rec")


@check("flt2_where_equal", f"WITH {V} SELECT unit, prov, n_rec FROM v WHERE status = 'MANDIRI'")
def _(spark, folder):
    return fl.where_equal(lines_view(spark, folder), "status", "MANDIRI").select("unit", "prov", "n_rec")


@check("flt3_distinct_options", f"WITH {V} SELECT DISTINCT prov FROM v ORDER BY prov LIMIT 5")
def _(spark, folder):
    return fl.distinct_options(lines_view(spark, folder), "prov", 5)


@check("srt1_sort_by", f"""WITH {V} SELECT prov, count(*) AS n FROM v GROUP BY prov
  ORDER BY n DESC, prov""")
def _(spark, folder):
    counts = lines_view(spark, folder).groupBy("prov").agg(F.count("*").alias("n"))
    return fl.sort_by(counts, "n", "prov", ascending=False)


_RATE = f"""WITH {V}, g AS (SELECT prov, count(unit) AS total_desa,
  count(*) FILTER ({LAGGING_SQL}) AS desa_tertinggal FROM v GROUP BY prov)
  SELECT *, {rs('desa_tertinggal::DOUBLE / total_desa * 100', 2)} AS persentase_tertinggal FROM g"""


@check("srt2_top_n", f"{_RATE} ORDER BY persentase_tertinggal DESC, prov LIMIT 10")
def _(spark, folder):
    from regiometra.plans.explore import lagging_rate
    return fl.dashboard_top(lagging_rate(lines_view(spark, folder), COLS), "persentase_tertinggal", "prov")


@check("srt3_select_top", """WITH %s SELECT prov, unit, idm, weakest, n_rec, flag, linestatus FROM v
  WHERE status = 'BERKEMBANG' AND idm >= 0.6872::DOUBLE AND idm < 0.7072::DOUBLE
  ORDER BY idm DESC, unit, n_rec, prov, flag, linestatus, weakest LIMIT 5""" % V)
def _(spark, folder):
    from regiometra.plans.explore import BAND_COLUMN, with_band
    banded = with_band(lines_view(spark, folder), COLS)
    return fl.select_top(banded, F.col(BAND_COLUMN) == "Potensi ke MAJU", "idm",
                         ["unit", "n_rec", "prov", "flag", "linestatus", "weakest"],
                         ["prov", "flag", "linestatus", "unit", "idm", "weakest", "n_rec"])


@check("srt4_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3")
def _(spark, folder):
    return fl.preview(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@check("smp1_sample_n", """SELECT o_orderkey, o_orderstatus FROM orders
  ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 5000""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return fl.sample_n(orders, 5000, "o_orderkey")
