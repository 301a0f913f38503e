"""SRC, SNK and the flows through files. Files are written from the given tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import CASE_WEAKEST, COLS, LAGGING_SQL, U, check, mode_sql, modeling_view, r, rs, table
from regiometra.domain import IDENTITY_COLUMNS, STATUS_ORDER, Columns
from regiometra.plans import report as rp
from regiometra.plans.scrub import scrub
from regiometra.session import new_folder
from regiometra.sources import models as sm
from regiometra.sources import sheets as sh
from regiometra.sources import tables as st


def _customers(spark, folder):
    return table(spark, folder, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("KODE_DESA"),
        F.col("c_mktsegment").alias("SEGMENT"),
        F.expr("CASE WHEN c_custkey % 9 = 0 THEN 'closed' WHEN c_custkey % 8 = 0 THEN NULL "
               "ELSE CAST(c_custkey AS STRING) END").alias("IKS_2024"))


_CUSTOMERS = """SELECT lpad(c_custkey::VARCHAR, 10, '0') AS "KODE_DESA", c_mktsegment AS "SEGMENT",
  CASE WHEN c_custkey % 9 = 0 THEN 'closed' WHEN c_custkey % 8 <> 0 THEN c_custkey::VARCHAR END AS "IKS_2024"
  FROM customer"""
_TYPED = f"""SELECT * REPLACE (TRY_CAST("IKS_2024" AS DOUBLE) AS "IKS_2024") FROM ({_CUSTOMERS})"""


def _written(spark, folder, bom=False):
    path = new_folder(spark, "customers")
    st.write_csv(_customers(spark, folder), path, bom=bom)
    return path


@check("src1_read_raw_csv", _CUSTOMERS)
def _(spark, folder):
    return st.read_raw_csv(spark, _written(spark, folder))


@check("src2_read_typed_csv", _TYPED)
def _(spark, folder):
    return st.read_typed_csv(spark, _written(spark, folder), ["IKS_2024", "IKE_2024"])


@check("src3_read_or_empty", f"""SELECT 'found' AS source, count(*) AS n FROM ({_CUSTOMERS})
  UNION ALL SELECT 'absent', 0""")
def _(spark, folder):
    schema = "KODE_DESA string, SEGMENT string, IKS_2024 string"
    found = st.read_or_empty(spark, _written(spark, folder), schema, st.read_raw_csv)
    absent = st.read_or_empty(spark, new_folder(spark, "absent"), schema, st.read_raw_csv)
    return (found.agg(F.lit("found").alias("source"), F.count("*").alias("n"))
            .unionByName(absent.agg(F.lit("absent").alias("source"), F.count("*").alias("n"))))


@check("snk1_write_csv_bom", _CUSTOMERS)
def _(spark, folder):
    return st.read_raw_csv(spark, _written(spark, folder, bom=True))


@check("snk1_snk2_text_round_trip", """SELECT doc_id::VARCHAR AS doc_id, '  ' || text || chr(10) || '"end" ' AS text,
  lang FROM documents""")
def _(spark, folder):
    path = new_folder(spark, "texts")
    texts = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit('\n"end" ')).alias("text"), "lang")
    st.write_csv(texts, path)
    return st.read_raw_csv(spark, path)


@check("snk2_snk3_overwrite_extract", f"WITH {U} SELECT unit::VARCHAR AS unit, prov, status FROM u "
       "WHERE prov IN ('NATION_1', 'NATION_3') AND status IN ('MAJU', 'MANDIRI')")
def _(spark, folder):
    path = new_folder(spark, "extract")
    units = modeling_view(spark, folder)
    rp.filtered_extract(units, path, ["NATION_2"], cols=COLS)
    rp.filtered_extract(units, path, ["NATION_1", "NATION_3"], ["MAJU", "MANDIRI"], cols=COLS)
    return st.read_raw_csv(spark, path).select("unit", "prov", "status")


_PROFILE = f"""WITH {U.replace('u AS', 'v AS')} SELECT g.*, m AS "STATUS_IDM_modus" FROM (SELECT prov,
  {', '.join(f"{rs(f'median({c})')} AS {o}_median" for o, c in
             (("IKS", "iks"), ("IKE", "ike"), ("IKL", "ikl"), ("NILAI_IDM", "idm")))},
  count(unit) AS jumlah_desa FROM v GROUP BY prov) g JOIN {mode_sql('v', 'prov', 'status')} t ON g.prov = t.prov"""


@check("snk4_materialize_if_absent", _PROFILE)
def _(spark, folder):
    path = new_folder(spark, "regions")
    units = modeling_view(spark, folder)
    rp.region_summary(spark, path, units, COLS)
    # The second call must find the stored table: its own input is empty.
    stored = rp.region_summary(spark, path, units.limit(0), COLS)
    return r(stored, "IKS_median", "IKE_median", "IKL_median", "NILAI_IDM_median")


@check("snk5_src9_stored_model", f"""WITH {U} SELECT count(*) AS n_scored, 0::BIGINT AS n_changed,
  true AS absent_is_none FROM u""")
def _(spark, folder):
    from regiometra.operators.classification import decision_tree
    from regiometra.plans.classify import model_inputs, training_table

    units = training_table(modeling_view(spark, folder), COLS)
    model = decision_tree(units, model_inputs(COLS), STATUS_ORDER)
    path = new_folder(spark, "model")
    absent = sm.load_model(spark, path) is None
    sm.save_model(model, path)
    again = sm.load_model(spark, path).transform(units).select("unit", F.col("predicted_status").alias("again"))
    both = model.transform(units).join(again, "unit")
    return both.agg(F.count("*").alias("n_scored"),
                    F.count_if(F.col("again") != F.col("predicted_status")).alias("n_changed"),
                    F.lit(absent).alias("absent_is_none"))


# Recommendation sheets: one file per residue of the order key, three title lines, a padded
# header in lower case, identity cells only on the first row of a unit.
_SHEETS = 32
_SHEET_TEXT = ("CASE WHEN l_linenumber % 5 = 0 THEN '-' WHEN l_linenumber % 3 = 0 THEN NULL "
               "ELSE concat('Perbaiki ', l_returnflag, ', segera') END")
_SHEET_TARGET = "CASE WHEN l_linenumber % 6 <> 0 THEN concat('T', l_linestatus) END"
_ORDER = "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice"


def write_sheets(spark, folder, bad: bool = False, txt: str = _SHEET_TEXT, compression: str = "none") -> str:
    """With ``bad``, every eighth sheet lacks the header line below its titles. ``txt`` is the free text, quotes doubled."""
    path = new_folder(spark, "sheets")
    lines = table(spark, folder, "lineitem").selectExpr(
        f"l_orderkey % {_SHEETS} AS sheet", f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS pos",
        f"{txt} AS txt", f"{_SHEET_TARGET} AS target", "l_quantity AS amount", "l_orderkey")
    cell = "if(pos = 1, {}, '')".format
    text = F.concat_ws(",", *[F.expr(e) for e in (
        cell("concat('P', l_orderkey % 7)"), cell("concat('Prov, ', l_orderkey % 7)").replace(
            "concat('Prov, ', l_orderkey % 7)", "concat('\"Prov, ', l_orderkey % 7, '\"')"),
        cell("cast(l_orderkey as string)"), "coalesce(concat('\"', txt, '\"'), '')",
        "cast(cast(amount as int) as string)", "coalesce(target, '')")])
    body = lines.select("sheet", F.col("l_orderkey").alias("a"), F.col("pos").cast("bigint").alias("b"),
                        text.alias("value"))
    header = " kode prov ,Nama Provinsi,Kode Desa,keterangan,NILAI , Target IDM 2025"
    tops = body.select("sheet").distinct().select("sheet", F.inline(F.array(*[
        F.struct(F.lit(-1).cast("bigint").alias("a"), F.lit(i).cast("bigint").alias("b"), F.lit(t).alias("value"))
        for i, t in enumerate(["Rekomendasi", "", "Tahun,2024", header])])))
    if bad:
        tops = tops.filter("sheet % 8 <> 3 OR b < 3")
        body = body.filter("sheet % 8 <> 3")
    (tops.unionByName(body).repartition("sheet").sortWithinPartitions("sheet", "a", "b")
     .select("sheet", "value").write.partitionBy("sheet").text(path, compression=compression))
    return path


def _cut_short(spark, path: str, sheets: range) -> None:
    """Leaves the first half of the files of some sheets, on whichever file system they are."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    for sheet in sheets:
        for found in hadoop.fs.Path(path).getFileSystem(conf).globStatus(hadoop.fs.Path(f"{path}/sheet={sheet}/*.gz")):
            whole = found.getPath()
            half = hadoop.fs.Path(whole.getParent(), f"half-{whole.getName()}")
            files = whole.getFileSystem(conf)
            source, target = files.open(whole), files.create(half)
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, found.getLen() // 2)
            source.close()
            target.close()
            files.delete(whole, False)


_ROWS = f"""x AS (SELECT l_orderkey AS k, l_orderkey % {_SHEETS} AS sheet, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS pos, {_SHEET_TEXT} AS txt, {_SHEET_TARGET} AS target,
  l_quantity AS amount FROM lineitem),
  y AS (SELECT *, 3 + row_number() OVER (PARTITION BY sheet ORDER BY k, pos) AS row_no FROM x)"""


@check("src4_to_src8_read_directory", f"""WITH {_ROWS} SELECT row_no,
  CASE WHEN pos = 1 THEN 'P' || (k % 7) END AS "KODE PROV", CASE WHEN pos = 1 THEN 'Prov, ' || (k % 7) END
  AS "NAMA PROVINSI", CASE WHEN pos = 1 THEN k::VARCHAR END AS "KODE DESA", txt AS "KETERANGAN",
  amount::INT::VARCHAR AS "NILAI", target AS "TARGET IDM 2025" FROM y WHERE k % 8 <> 3""")
def _(spark, folder):
    rows = sh.read_directory(spark, write_sheets(spark, folder, bad=True), header_row=3, required=["KODE DESA"])
    return rows.select("row_no", "KODE PROV", "NAMA PROVINSI", "KODE DESA", "KETERANGAN", "NILAI", "TARGET IDM 2025")


_BROKEN_TEXT = ("CASE WHEN l_linenumber % 4 = 0 THEN concat('baris {q}satu{q},', chr(10), chr(10), l_orderkey, ',x') "
                "WHEN l_linenumber % 4 = 1 THEN concat(l_returnflag, chr(10)) ELSE l_returnflag END")


@check("src4_line_breaks_in_cells", f"""WITH {_ROWS.replace(_SHEET_TEXT, _BROKEN_TEXT.format(q='"'))} SELECT row_no,
  CASE WHEN pos = 1 THEN k::VARCHAR END AS "KODE DESA", txt AS "KETERANGAN", amount::INT::VARCHAR AS "NILAI",
  target AS "TARGET IDM 2025" FROM y""")
def _(spark, folder):
    path = write_sheets(spark, folder, txt=_BROKEN_TEXT.format(q='""'))
    rows = sh.read_directory(spark, path, header_row=3, required=["KODE DESA"])
    return rows.select("row_no", "KODE DESA", "KETERANGAN", "NILAI", "TARGET IDM 2025")


@check("src5_rejected_files", f"""SELECT 'no header row' AS error, count(DISTINCT l_orderkey % {_SHEETS}) AS n
  FROM lineitem WHERE l_orderkey % 8 = 3""")
def _(spark, folder):
    folder_ = sh.SheetFolder(spark, write_sheets(spark, folder, bad=True), 3, ["KODE DESA"])
    return folder_.rejects.groupBy("error").agg(F.count("*").alias("n"))


_TRUNCATED = range(10)


def _truncated(spark, folder):
    path = write_sheets(spark, folder, compression="gzip")
    _cut_short(spark, path, _TRUNCATED)
    return sh.SheetFolder(spark, path, 3, ["KODE DESA"])


@check("src5_truncated_files", f"""WITH {_ROWS} SELECT row_no, CASE WHEN pos = 1 THEN k::VARCHAR END AS "KODE DESA",
  txt AS "KETERANGAN", amount::INT::VARCHAR AS "NILAI" FROM y WHERE sheet >= {len(_TRUNCATED)}""")
def _(spark, folder):
    return _truncated(spark, folder).rows().select("row_no", "KODE DESA", "KETERANGAN", "NILAI")


@check("src5_truncated_rejects", f"""SELECT 'empty or unreadable' AS error, count(DISTINCT l_orderkey % {_SHEETS}) AS n
  FROM lineitem WHERE l_orderkey % {_SHEETS} < {len(_TRUNCATED)}""")
def _(spark, folder):
    return _truncated(spark, folder).rejects.groupBy("error").agg(F.count("*").alias("n"))


def _unclosed(spark, folder):
    """One sheet a nation; in every fifth the last cell opens a quote and never closes it."""
    path = new_folder(spark, "open-sheets")
    body = table(spark, folder, "customer").select("c_nationkey", F.lit(1).alias("a"), F.col("c_custkey").alias("b"),
                                                   F.format_string('%d,"%s, x"', "c_custkey", "c_mktsegment").alias("value"))
    sheets = body.select("c_nationkey").distinct()
    heads = sheets.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("KODE,SEGMENT").alias("value"))
    tails = sheets.where("c_nationkey % 5 = 1").select("*", F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit('9,"open').alias("value"))
    (heads.unionByName(body).unionByName(tails).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "a", "b")
     .select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path))
    return sh.SheetFolder(spark, path, 0, ["KODE"])


@check("src4_unclosed_quote", """SELECT 'quoted cell without an end' AS error, count(DISTINCT c_nationkey) AS n
  FROM customer WHERE c_nationkey % 5 = 1""")
def _(spark, folder):
    return _unclosed(spark, folder).rejects.groupBy("error").agg(F.count("*").alias("n"))


@check("src4_beside_unclosed_quotes", """SELECT c_custkey::VARCHAR AS "KODE", c_mktsegment || ', x' AS "SEGMENT"
  FROM customer WHERE c_nationkey % 5 <> 1""")
def _(spark, folder):
    return _unclosed(spark, folder).rows().select("KODE", "SEGMENT")


@check("src1_one_large_file", """SELECT l_orderkey::VARCHAR AS "ORDER", l_linenumber::VARCHAR AS "LINE",
  concat('a ', chr(10), '"', l_returnflag, '",', l_linestatus, chr(13), chr(10), ' ') AS "TEXT" FROM lineitem""")
def _(spark, folder):
    path = new_folder(spark, "large")
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS `ORDER`", "l_linenumber AS LINE",
        "concat('a ', chr(10), '\"', l_returnflag, '\",', l_linestatus, chr(13), chr(10), ' ') AS TEXT")
    st.write_csv(lines, path, files=1)
    return st.read_raw_csv(spark, path)


@check("cln10_fill_identity", f"""WITH {_ROWS} SELECT row_no, k::VARCHAR AS "KODE DESA",
  'P' || (k % 7) AS "KODE PROV", txt AS "KETERANGAN" FROM y""")
def _(spark, folder):
    rows = sh.read_directory(spark, write_sheets(spark, folder), header_row=3)
    return sh.fill_identity(rows, IDENTITY_COLUMNS).select("row_no", "KODE DESA", "KODE PROV", "KETERANGAN")


# The whole cleaning flow, from files: orders are the units, sheets as above.
_RAW = {"IKS_2024": "CASE WHEN o_orderkey % 97 = 0 THEN 'non-aktif' ELSE cast((o_orderkey * 7) % 101 as {t}) END",
        "IKE_2024": "CASE WHEN o_orderkey % 13 <> 0 THEN cast((o_orderkey * 11) % 89 as {t}) END",
        "IKL_2024": "CASE WHEN o_orderkey % 17 <> 0 THEN cast((o_orderkey * 3) % 97 as {t}) ELSE 'x' END",
        "NILAI_IDM_2024": "cast((o_orderkey * o_orderkey) % 997 as {t})",
        "STATUS_IDM_2024": "CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END"}


def scrubbed(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(
        "concat('000', o_orderkey) AS KODE_DESA", "o_orderpriority AS NAMA_DESA",
        *[f"{e.format(t='string')} AS {c}" for c, e in _RAW.items()], "'junk' AS Keterangan")
    path = new_folder(spark, "units")
    st.write_csv(raw, path, bom=True)
    return scrub(spark, path, write_sheets(spark, folder), Columns(), patches={12: "UJONG PADANG"})


_NUM = ["IKS_2024", "IKE_2024", "IKL_2024", "NILAI_IDM_2024"]
_RAW_SQL = ", ".join(f"{e.format(t='VARCHAR')} AS {c}" for c, e in _RAW.items())
_MED = ", ".join(f"coalesce(try_cast({c} AS DOUBLE), (SELECT median(try_cast({c} AS DOUBLE)) FROM b)) AS {c}"
                 for c in _NUM)
_IQ = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in _NUM for n, p in (("a", 0.25), ("b", 0.75)))
_IF = ", ".join(f"({c} < {c}_a - 1.5 * ({c}_b - {c}_a) OR {c} > {c}_b + 1.5 * ({c}_b - {c}_a)) "
                f"AS is_outlier_{c.split('_')[0].lower()}" for c in _NUM)
_LOW = CASE_WEAKEST.replace("iks", "IKS_2024").replace("ike", "IKE_2024").replace("ikl", "IKL_2024")
_SCRUB = f"""WITH {_ROWS}, a AS (SELECT o_orderkey, o_orderpriority, {_RAW_SQL} FROM orders),
  b AS (SELECT * FROM a WHERE try_cast(IKS_2024 AS DOUBLE) IS NOT NULL),
  c AS (SELECT o_orderkey::VARCHAR AS KODE_DESA, CASE WHEN o_orderkey = 12 THEN 'UJONG PADANG'
    ELSE o_orderpriority END AS NAMA_DESA, {_MED}, coalesce(STATUS_IDM_2024, (SELECT STATUS_IDM_2024 FROM b
    WHERE STATUS_IDM_2024 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS STATUS_IDM_2024 FROM b),
  g AS (SELECT k::VARCHAR AS k, count(txt) AS n, sum(amount) AS total FROM y GROUP BY k),
  j AS (SELECT k::VARCHAR AS k, coalesce(string_agg(txt, '; ' ORDER BY first) FILTER (WHERE txt <> '-'),
    'Tidak ada rekomendasi spesifik') AS joined FROM (SELECT k, txt, min(row_no) AS first FROM y GROUP BY k, txt) GROUP BY k),
  m AS (SELECT k::VARCHAR AS k, m FROM {mode_sql('y', 'k', 'target')}),
  e AS (SELECT c.*, coalesce(n, 0) AS jumlah_rekomendasi, coalesce(total, 0.0) AS total_nilai_rekomendasi,
    coalesce(joined, 'Tidak ada data rekomendasi') AS keterangan_gabungan,
    coalesce(m, STATUS_IDM_2024) AS target_idm_2025, n IS NOT NULL AS has_rekomendasi FROM c
    LEFT JOIN g ON KODE_DESA = g.k LEFT JOIN j ON KODE_DESA = j.k LEFT JOIN m ON KODE_DESA = m.k),
  q AS (SELECT {_IQ} FROM e)
  SELECT e.*, {_LOW} AS dimensi_terendah, IKS_2024 - IKE_2024 AS gap_iks_ike, IKS_2024 - IKL_2024 AS gap_iks_ikl,
  {rs('jumlah_rekomendasi / (SELECT avg(jumlah_rekomendasi) FROM e WHERE has_rekomendasi)')}
  AS intensitas_rekomendasi, {_IF} FROM e, q"""


@check("pl1_scrub_modeling", _SCRUB)
def _(spark, folder):
    return r(scrubbed(spark, folder).modeling, "intensitas_rekomendasi")


@check("pl1_scrub_invalid_units", """SELECT o_orderpriority AS "NAMA_DESA", '000' || o_orderkey AS "KODE_DESA",
  'non-aktif' AS reason FROM orders WHERE o_orderkey % 97 = 0""")
def _(spark, folder):
    return scrubbed(spark, folder).invalid
