"""AG, JN and SET operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import CASE_STATUS, COLS, LAGGING_SQL, U, V, check, lines_view, mode_sql, modeling_view, r, rs, table
from regiometra.domain import LAGGING, STATUS_ORDER, TOP_STATUS, status_table
from regiometra.operators import aggregates as ag
from regiometra.operators import joins as jn
from regiometra.operators.features import is_member
from regiometra.plans import explore as ex

# Child rows of an order; lines of one order may repeat, so the order has tie-breakers.
_TEXT = ("CASE WHEN l_linenumber % 5 = 0 THEN '-' WHEN l_linenumber % 4 = 0 THEN concat(' ', l_returnflag) "
         "WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END")
_TARGET = "CASE WHEN l_linenumber % 6 <> 0 THEN l_linestatus END"
_KEY = "CASE WHEN l_orderkey % 101 <> 0 THEN l_orderkey END"
_CHILD = f"""c AS (SELECT {_KEY} AS k, {_TEXT} AS txt, {_TARGET} AS target,
  CASE WHEN l_orderkey % 50 <> 1 THEN l_quantity END AS amount, l_linenumber AS pos FROM lineitem)"""


def children(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        f"{_KEY} AS k", f"{_TEXT} AS txt", f"{_TARGET} AS target",
        "CASE WHEN l_orderkey % 50 <> 1 THEN l_quantity END AS amount", "l_linenumber AS pos")


_JOINED = """j AS (SELECT k, coalesce(string_agg(shown, '; ' ORDER BY first, txt)
  FILTER (WHERE shown NOT IN ('', '-')), 'Tidak ada rekomendasi spesifik') AS joined
  FROM (SELECT k, txt, trim(txt) AS shown, min(pos) AS first FROM c WHERE k IS NOT NULL GROUP BY k, txt)
  GROUP BY k)"""
_COLLAPSED = f"""{_CHILD}, {_JOINED}, f AS (SELECT k, count(txt) AS n, coalesce(sum(amount), 0.0) AS total
  FROM c WHERE k IS NOT NULL GROUP BY k), g AS (SELECT f.k, n, total, joined, m AS target FROM f
  JOIN j ON f.k = j.k LEFT JOIN {mode_sql('c', 'k', 'target')} t ON f.k = t.k)"""


def collapsed(spark, folder):
    return ag.collapse_children(children(spark, folder), "k", "txt", "amount", "target", ["pos"],
                                {"count": "n", "total": "total", "joined": "joined", "target": "target"})


@check("ag1_collapse_children", f"WITH {_COLLAPSED} SELECT k, n, total, joined, target FROM g")
def _(spark, folder):
    return collapsed(spark, folder)


@check("ag2_group_count", f"WITH {_CHILD} SELECT k, count(txt) AS n FROM c WHERE k IS NOT NULL GROUP BY k")
def _(spark, folder):
    return ag.group_count(children(spark, folder), "k", "txt", "n")


@check("ag3_group_sum", f"""WITH {_CHILD} SELECT k, coalesce(sum(amount), 0.0) AS total FROM c
  WHERE k IS NOT NULL GROUP BY k""")
def _(spark, folder):
    return ag.group_sum(children(spark, folder), "k", "amount", "total")


@check("ag4_join_distinct_text", f"WITH {_CHILD}, {_JOINED} SELECT k, joined FROM j")
def _(spark, folder):
    return ag.join_distinct_text(children(spark, folder), "k", "txt", ["pos"], "joined")


@check("ag5_group_mode", f"""WITH {_CHILD} SELECT g.k, m FROM (SELECT DISTINCT k FROM c WHERE k IS NOT NULL) g
  LEFT JOIN {mode_sql('c', 'k', 'target')} t ON g.k = t.k""")
def _(spark, folder):
    return ag.group_mode(children(spark, folder), "k", "target", "m")


@check("ag6_global_mode", f"""WITH {V} SELECT status FROM v GROUP BY status
  ORDER BY count(*) DESC, status LIMIT 1""")
def _(spark, folder):
    return ag.mode_of(lines_view(spark, folder), "status", "status")


def _describe_sql(source: str, columns: list[str], digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, {rs(f'avg({c})', digits)} AS mean, "
        f"{rs(f'stddev_samp({c})', digits)} AS std, min({c})::DOUBLE AS min, "
        + ", ".join(f"{rs(f'quantile_cont({c}, {p})', digits)} AS {q}"
                    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
        + f", max({c})::DOUBLE AS max FROM {source}" for c in columns)


_NUMERIC = ["iks", "ike", "ikl", "idm", "n_rec", "gap_e", "gap_l"]


@check("ag7_describe", f"WITH {V} {_describe_sql('v', _NUMERIC)}")
def _(spark, folder):
    described = ag.describe(lines_view(spark, folder), [*_NUMERIC, "weakest", "absent"])
    return r(described, "mean", "std", "q25", "q50", "q75")


@check("ag8_value_counts", f"WITH {V} SELECT status, count(*) AS JUMLAH FROM v GROUP BY status ORDER BY 2 DESC, 1")
def _(spark, folder):
    return ag.value_counts(lines_view(spark, folder), "status")


def _share_sql(source: str) -> str:
    return (f"SELECT weakest AS DIMENSI, count(*) AS JUMLAH, "
            f"{rs(f'count(*)::DOUBLE / (SELECT count(*) FROM {source}) * 100', 2)} AS PERSENTASE "
            f"FROM {source} WHERE weakest IS NOT NULL GROUP BY weakest ORDER BY 2 DESC, 1")


_HOLED = "h AS (SELECT status, CASE WHEN unit % 10 <> 0 THEN weakest END AS weakest FROM v)"


@check("ag9_value_share", f"WITH {V}, {_HOLED} {_share_sql('h')}")
def _(spark, folder):
    v = lines_view(spark, folder).withColumn("weakest", F.when(F.col("unit") % 10 != 0, F.col("weakest")))
    return ag.value_share(v, "weakest", "DIMENSI")


@check("ag10_value_share_where", f"WITH {V}, s AS (SELECT * FROM v WHERE {LAGGING_SQL}) {_share_sql('s')}")
def _(spark, folder):
    return ag.value_share_where(lines_view(spark, folder), is_member("status", LAGGING), "weakest",
                                value_name="DIMENSI")


_DOMAIN = "(VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(STATUS_ORDER)) + ") AS d(status, o)"


@check("ag11_status_summary", f"""WITH {V}, s AS (SELECT CASE WHEN status = 'MAJU' THEN 'LAIN'
  WHEN status <> 'MANDIRI' THEN status END AS status FROM v) SELECT d.status, coalesce(n, 0) AS JUMLAH,
  {rs('coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM v) * 100', 2)} AS PERSENTASE
  FROM {_DOMAIN} LEFT JOIN (SELECT status, count(*) AS n FROM s GROUP BY status) c ON d.status = c.status
  ORDER BY o""")
def _(spark, folder):
    odd = F.when(F.col("status") == "MAJU", F.lit("LAIN")).when(F.col("status") != "MANDIRI", F.col("status"))
    return ag.status_summary(lines_view(spark, folder).withColumn("status", odd), "status", status_table(spark))


@check("ag12_group_rate", f"""WITH {V}, g AS (SELECT prov, count(unit) AS total_desa,
  count(*) FILTER ({LAGGING_SQL}) AS desa_tertinggal FROM v GROUP BY prov) SELECT *,
  {rs('desa_tertinggal::DOUBLE / total_desa * 100', 2)} AS persentase_tertinggal FROM g""")
def _(spark, folder):
    return ex.lagging_rate(lines_view(spark, folder), COLS)


_MEDIANS = ", ".join(f"{rs(f'median({c})')} AS {o}_median" for o, c in
                     (("IKS", "iks"), ("IKE", "ike"), ("IKL", "ikl"), ("NILAI_IDM", "idm")))
_PROFILE = f"""p AS (SELECT g.*, m AS STATUS_IDM_modus FROM (SELECT prov, {_MEDIANS},
  count(unit) AS jumlah_desa FROM v GROUP BY prov) g JOIN {mode_sql('v', 'prov', 'status')} t ON g.prov = t.prov)"""


@check("ag13_group_profile_median", f"WITH {V}, {_PROFILE} SELECT * FROM p")
def _(spark, folder):
    return r(ex.region_profile(lines_view(spark, folder), COLS),
             "IKS_median", "IKE_median", "IKL_median", "NILAI_IDM_median")


_MEANS = ["iks", "ike", "ikl", "idm", "n_rec", "total_rec"]


@check("ag14_group_profile_mean", f"""WITH {V} SELECT flag,
  {', '.join(f"{rs(f'avg({c})', 4)} AS {c}" for c in _MEANS)} FROM v GROUP BY flag""")
def _(spark, folder):
    return r(ag.group_profile_mean(lines_view(spark, folder), "flag", _MEANS), *_MEANS, digits=4)


@check("ag15_cluster_summary", f"""WITH {V}, c AS (SELECT *, 'Klaster ' || n_rec AS cluster_label FROM v)
  SELECT g.*, m AS status FROM (SELECT cluster_label, {', '.join(f"{rs(f'avg({c})')} AS {c}" for c in _MEANS[:4])}
  FROM c GROUP BY cluster_label) g JOIN {mode_sql('c', 'cluster_label', 'status')} t
  ON g.cluster_label = t.cluster_label""")
def _(spark, folder):
    v = lines_view(spark, folder)
    clustered = v.withColumn("cluster_id", F.col("n_rec")).withColumn(
        "cluster_label", F.concat(F.lit("Klaster "), F.col("n_rec").cast("string")))
    summary = ag.cluster_summary(clustered, "cluster_label", "cluster_id", [*COLS.measures, "absent"], "status")
    return r(summary, *COLS.measures)


_ODD_STATUS = f"CASE WHEN n_rec = 3 THEN 'OUTSIDE' ELSE {CASE_STATUS} END"


@check("ag16_crosstab_row_percent", f"WITH {V.replace(CASE_STATUS, _ODD_STATUS)} SELECT flag, " + ", ".join(
    rs(f"count(*) FILTER (status = '{s}')::DOUBLE / count(*) * 100") + f' AS "{s}"' for s in STATUS_ORDER)
    + " FROM v GROUP BY flag")
def _(spark, folder):
    odd = lines_view(spark, folder).withColumn("status", F.when(F.col("n_rec") == 3, "OUTSIDE").otherwise(F.col("status")))
    return r(ag.crosstab_row_percent(odd, "flag", "status", STATUS_ORDER), *STATUS_ORDER)


_CORR = ["iks", "ike", "ikl", "idm", "n_rec", "gap_e", "gap_l", "const"]


def _corr_sql(a: str, b: str) -> str:
    if "const" in (a, b):
        return f'max(NULL::DOUBLE) AS "{b}"'
    return f'{rs(f"corr({a}, {b})")} AS "{b}"'


@check("ag17_correlation_matrix", f"""WITH {V}, c AS (SELECT * REPLACE
  (CASE WHEN unit % 3 <> 0 THEN ike END AS ike) FROM v) """ + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, {', '.join(_corr_sql(a, b) for b in _CORR)} FROM c" for a in _CORR))
def _(spark, folder):
    v = lines_view(spark, folder).withColumn("ike", F.when(F.col("unit") % 3 != 0, F.col("ike")))
    matrix = ag.correlation_matrix(v.withColumn("const", F.lit(2.5)), [*_CORR, "absent"])
    return r(matrix, *_CORR)


_LAGS = range(30)


def _lag_sql(k: int) -> str:
    """Thirty columns from line figures, some with holes."""
    value = f"((l_partkey * {k + 3} + l_suppkey * {7 * k + 1}) % {101 + k})::DOUBLE + {'l_quantity' if k % 2 else '0'}"
    return f"CASE WHEN l_orderkey % {5 + k} <> 0 THEN {value} END" if k % 3 == 0 else value


@check("ag17_wide_correlations", f"WITH w AS (SELECT {', '.join(f'{_lag_sql(k)} AS w{k}' for k in _LAGS)} FROM lineitem) "
       + " UNION ALL ".join(f"SELECT 'w{a}' AS feature, " + ", ".join(rs(f"corr(w{a}, w{b})") + f" AS w{b}" for b in _LAGS) + " FROM w" for a in _LAGS))
def _(spark, folder):
    columns = [F.expr(_lag_sql(k)).alias(f"w{k}") for k in _LAGS]
    wide = table(spark, folder, "lineitem").select(*columns)
    names = [f"w{k}" for k in _LAGS]
    return r(ag.correlation_matrix(wide, names), *names)


def _kpi_sql(source: str) -> str:
    return f"""SELECT count(*) AS total_units, count(DISTINCT prov) AS total_regions,
  {rs(f"avg(CASE WHEN {LAGGING_SQL} THEN 1.0::DOUBLE ELSE 0 END) * 100")} AS pct_lagging,
  {rs("avg(CASE WHEN status = 'MANDIRI' THEN 1.0::DOUBLE ELSE 0 END) * 100")} AS pct_top,
  {rs("avg(idm)")} AS mean_score FROM {source}"""


@check("ag18_kpis", f"WITH {V} {_kpi_sql('v')}")
def _(spark, folder):
    return r(ag.kpis(lines_view(spark, folder), "prov", "status", "idm", LAGGING, TOP_STATUS),
             "pct_lagging", "pct_top", "mean_score")


@check("ag18_cluster_kpis", f"""WITH {V} SELECT count(*) AS clustered_rows,
  count(DISTINCT n_rec) AS n_clusters FROM v""")
def _(spark, folder):
    return ag.cluster_kpis(lines_view(spark, folder), "n_rec")


@check("ag19_percentile_rank", f"WITH {V} SELECT " + ", ".join(
    rs(f"avg(CASE WHEN {c} < {p}::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) * 100", 1) + f" AS {c}"
    for c, p in (("iks", 0.5), ("ike", 0.31), ("ikl", 0.875))) + ", 0.0::DOUBLE AS absent FROM v")
def _(spark, folder):
    return ag.percentile_rank(lines_view(spark, folder), {"iks": 0.5, "ike": 0.31, "ikl": 0.875, "absent": 1.0})


@check("ag20_default_medians", f"""SELECT {rs('median(c_acctbal)')} AS c_acctbal,
  median(TRY_CAST(c_mktsegment AS DOUBLE)) IS NOT NULL AS any_text, 0.0::DOUBLE AS absent FROM customer""")
def _(spark, folder):
    found = ag.default_medians(table(spark, folder, "customer"), ["c_acctbal", "c_mktsegment", "absent"])
    return r(found, "c_acctbal").select("c_acctbal", (F.col("c_mktsegment") != 0.0).alias("any_text"), "absent")


_ATTACHED = f"""WITH {_COLLAPSED}, a AS (SELECT o_orderkey, o_orderstatus, g.n IS NOT NULL AS matched,
  coalesce(n, 0) AS n, coalesce(total, 0.0) AS total, joined, coalesce(target, o_orderstatus) AS target
  FROM orders LEFT JOIN g ON o_orderkey = g.k)"""


def attached(spark, folder):
    joined = jn.left_attach(table(spark, folder, "orders"), collapsed(spark, folder), "o_orderkey", "k", "matched")
    return joined.withColumns({
        "n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0)),
        "target": F.coalesce("target", "o_orderstatus")})


@check("jn1_left_attach", f"{_ATTACHED} SELECT o_orderkey, n, total, joined, target FROM a")
def _(spark, folder):
    return attached(spark, folder).select("o_orderkey", "n", "total", "joined", "target")


@check("jn2_with_match_flag", f"{_ATTACHED} SELECT o_orderkey, matched FROM a")
def _(spark, folder):
    return attached(spark, folder).select("o_orderkey", "matched")


@check("jn3_match_coverage", f"{_ATTACHED} SELECT count(*) FILTER (matched) AS matched, count(*) AS total FROM a")
def _(spark, folder):
    return jn.match_coverage(attached(spark, folder), "matched")


@check("jn4_reindex_to_domain", f"""WITH {V} SELECT d.status, coalesce(n, 0) AS n FROM {_DOMAIN}
  LEFT JOIN (SELECT status, count(*) AS n FROM v WHERE status <> 'MAJU' GROUP BY status) c ON d.status = c.status
  ORDER BY o""")
def _(spark, folder):
    counts = (lines_view(spark, folder).filter(F.col("status") != "MAJU").groupBy("status")
              .agg(F.count("*").alias("n")))
    return jn.reindex_to_domain(counts, "status", "n", status_table(spark))


@check("jn6_with_scalars", f"""WITH {V} SELECT unit, n_rec, (SELECT max(idm) FROM v) AS top_idm,
  (SELECT count(*) FROM v) AS n_all FROM v""")
def _(spark, folder):
    v = lines_view(spark, folder)
    stats = v.agg(F.max("idm").alias("top_idm"), F.count("*").alias("n_all"))
    return jn.with_scalars(v.select("unit", "n_rec"), stats)


@check("set1_union_by_name", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment,
  NULL::VARCHAR AS supplier_name FROM customer UNION ALL
  SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def _(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(
        F.col("s_name").alias("supplier_name"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return jn.union_by_name(c, s)


# Tables of the exploration and of the filtered report, on units with unique keys.

@check("pl2_region_profile_by_score", f"WITH {U.replace('u AS', 'v AS')}, {_PROFILE} SELECT * FROM p")
def _(spark, folder):
    tables = ex.explore(modeling_view(spark, folder), COLS)
    return r(tables["region_profile_by_score"], "IKS_median", "IKE_median", "IKL_median", "NILAI_IDM_median")


@check("pl2_closest_to_upgrade", f"""WITH {U} SELECT prov, flag, linestatus, unit, idm, weakest, n_rec FROM u
  WHERE status = 'BERKEMBANG' AND idm >= 0.6872::DOUBLE AND idm < 0.7072::DOUBLE
  ORDER BY idm DESC, unit LIMIT 5""")
def _(spark, folder):
    return ex.explore(modeling_view(spark, folder), COLS)["closest_to_upgrade"]


@check("ext1_scatter_points", f"WITH {U} SELECT ike, iks, status FROM u ORDER BY md5('42|' || unit), unit LIMIT 5000")
def _(spark, folder):
    return ex.explore(modeling_view(spark, folder), COLS)["scatter"]


_REGIONS = ["NATION_1", "NATION_3", "NATION_7"]
_CHOSEN = "f AS (SELECT * FROM u WHERE prov IN ('NATION_1', 'NATION_3', 'NATION_7') AND status <> 'MANDIRI')"


def _report(spark, folder):
    from regiometra.plans.report import report
    return report(modeling_view(spark, folder), _REGIONS, STATUS_ORDER[:4], cols=COLS)


@check("pl5_report_kpis", f"WITH {U}, {_CHOSEN} {_kpi_sql('f')}")
def _(spark, folder):
    return r(_report(spark, folder)["kpis"], "pct_lagging", "pct_top", "mean_score")


@check("pl5_report_status_summary", f"""WITH {U}, {_CHOSEN} SELECT d.status, coalesce(n, 0) AS JUMLAH,
  {rs('coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM f) * 100', 2)} AS PERSENTASE FROM {_DOMAIN}
  LEFT JOIN (SELECT status, count(*) AS n FROM f GROUP BY status) c ON d.status = c.status ORDER BY o""")
def _(spark, folder):
    return _report(spark, folder)["status_summary"]


@check("pl5_report_lagging_top", f"""WITH {U}, {_CHOSEN}, g AS (SELECT prov, count(unit) AS total_desa,
  count(*) FILTER ({LAGGING_SQL}) AS desa_tertinggal FROM f GROUP BY prov) SELECT *,
  {rs('desa_tertinggal::DOUBLE / total_desa * 100', 2)} AS persentase_tertinggal FROM g
  ORDER BY persentase_tertinggal DESC, prov LIMIT 10""")
def _(spark, folder):
    return _report(spark, folder)["lagging_top"]


@check("pl5_report_weakest_share", f"WITH {U}, {_CHOSEN} {_share_sql('f')}")
def _(spark, folder):
    return _report(spark, folder)["weakest_share"]


@check("pl5_two_choices_of_one_build", f"""WITH {U}, {_CHOSEN}, g AS (SELECT * FROM u WHERE status IN ('MAJU', 'MANDIRI'))
  SELECT 'f' AS choice, * FROM ({_kpi_sql('f')}) UNION ALL SELECT 'g', * FROM ({_kpi_sql('g')})""")
def _(spark, folder):
    from regiometra.operators.cells import Cells
    from regiometra.plans.report import report

    units = modeling_view(spark, folder)
    cells = Cells.build(units, COLS)
    choices = {"f": (_REGIONS, STATUS_ORDER[:4]), "g": ((), ("MAJU", "MANDIRI"))}
    both = [report(units, *chosen, cols=COLS, cells=cells)["kpis"].select(F.lit(name).alias("choice"), "*")
            for name, chosen in choices.items()]
    return r(both[0].unionByName(both[1]), "pct_lagging", "pct_top", "mean_score")


@check("pl5_report_weakest_share_lagging", f"WITH {U}, {_CHOSEN}, l AS (SELECT * FROM f WHERE {LAGGING_SQL}) {_share_sql('l')}")
def _(spark, folder):
    return _report(spark, folder)["weakest_share_lagging"]
