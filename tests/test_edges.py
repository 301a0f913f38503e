"""Contracts at the edges: lossless text files, broken folders, absent columns."""

import shutil

import pytest
from pyspark.sql import functions as F

from regiometra.operators import aggregates as agg
from regiometra.plans.report import report
from regiometra.sources import models as sm
from regiometra.sources import tables as st

TEXTS = ["  x ", "two\nlines", 'say ""it""', 'a "b", c', "tab\t", "plain", "é\n\n ", ","]


def test_csv_keeps_every_text(spark, tmp_path):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "k string, t string")
    st.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, st.read_raw_csv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))


def test_a_broken_write_is_computed_again(spark, tmp_path):
    path = tmp_path / "summary"
    path.mkdir()
    (path / "part-0.csv").write_text("reg")
    fresh = spark.createDataFrame([("a", 1)], "region string, n int")
    found = st.materialize_if_absent(spark, str(path), "region", lambda: fresh, {"n": "int"})
    assert found.collect() == fresh.collect() and (path / "_SUCCESS").exists()
    assert st.materialize_if_absent(spark, str(tmp_path / "none"), "region", lambda: fresh.limit(0)).count() == 0


def test_a_model_without_one_of_its_stages_is_absent(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    path = tmp_path / "m"
    stages = [SQLTransformer(statement=f"SELECT *, {i} AS c{i} FROM __THIS__") for i in range(3)]
    sm.save_model(Pipeline(stages=stages).fit(spark.range(1)), str(path))
    assert sm.load_model(spark, str(path)) is not None
    shutil.rmtree(next((path / "stages").glob("1_*")))
    assert sm.load_model(spark, str(path)) is None


def test_crosstab_divides_by_all_present_values(spark):
    df = spark.createDataFrame([("g", "MAJU"), ("g", "?"), ("g", None)], "g string, s string")
    assert agg.crosstab_row_percent(df, "g", "s", ["MAJU"]).first()["MAJU"] == pytest.approx(50)


def test_reports_without_columns_are_empty(spark):
    bare = spark.range(3).select(F.col("id").alias("anything"))
    tables = report(bare, clustered=bare)
    for name in ("lagging_rate", "lagging_top", "weakest_share", "weakest_share_lagging"):
        assert tables[name].count() == 0
    assert tuple(tables["cluster_kpis"].first()) == (0, 0)


def test_a_truncated_sheet_is_rejected_as_a_whole(spark, tmp_path):
    import gzip

    from regiometra.sources.sheets import SheetFolder

    good = "K,N\n" + "".join(f"{i},x�\n" for i in range(50))
    (tmp_path / "a.csv").write_text(good)
    (tmp_path / "c.csv").write_text(good)
    whole = gzip.compress(("K,N\n" + "".join(f"{i},{i * i % 977}\n" for i in range(200_000))).encode())
    (tmp_path / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "d.csv").write_bytes(b"K,N\n1,\xff\xfe\n")
    sheets = SheetFolder(spark, str(tmp_path), header_row=0)
    rows = sheets.rows().collect()
    assert {r.error for r in sheets.rejects.collect()} == {"empty or unreadable", "not valid text"}
    assert len(rows) == 100 and {r.N for r in rows} == {"x�"} and len({r.position for r in rows}) == 100
