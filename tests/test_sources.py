"""Readers, writers and the flow through files, on small hand-made files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from regiometra.domain import IDENTITY_COLUMNS, Columns
from regiometra.plans.explore import region_profile
from regiometra.plans.report import region_summary
from regiometra.plans.scrub import scrub
from regiometra.sources import models as sm
from regiometra.sources import sheets as sh
from regiometra.sources import tables as st


def sheet(folder, name, body, titles=("Judul", "", "Tahun 2024"),
          header=" kode desa ,Nama Desa,KETERANGAN,Nilai,Target IDM 2025"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([*titles, header, *body]) + "\n", encoding="utf-8")


def test_leading_zeros_survive_and_numbers_are_coerced(spark, tmp_path):
    (tmp_path / "a.csv").write_text("KODE_DESA,IKS_2024,NAMA\n0011,0.5,\"A, B\"\n0012,x,C\n")
    df = st.read_typed_csv(spark, str(tmp_path / "a.csv"), ["IKS_2024", "KODE_DESA", "absent"])
    assert [tuple(r) for r in df.orderBy("KODE_DESA").collect()] == [("0011", 0.5, "A, B"), ("0012", None, "C")]
    assert dict(st.read_raw_csv(spark, str(tmp_path / "a.csv")).dtypes)["IKS_2024"] == "string"


def test_absent_table_is_empty(spark, tmp_path):
    df = st.read_or_empty(spark, str(tmp_path / "none"), "a string, b int")
    assert df.columns == ["a", "b"] and df.isEmpty()


@pytest.mark.parametrize("bom", [True, False])
def test_csv_round_trip(spark, tmp_path, bom):
    df = spark.createDataFrame([("0011", 'say "hi", now'), ("2", None)], "KODE_DESA string, t string")
    path = str(tmp_path / "out" / "deep")
    for _ in range(2):
        st.write_csv(df, path, bom=bom, files=1)
    raw = next((tmp_path / "out" / "deep").glob("part*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") == bom
    back = st.read_raw_csv(spark, path)
    assert back.columns == df.columns
    assert sorted(back.collect()) == sorted(df.collect())


def test_sheets_are_united_filled_and_rejected(spark, tmp_path):
    folder = tmp_path / "s"
    sheet(folder, "a.csv", ['0011,"Ujong, A",x,1,MAJU', ',,"say ""hi""",2,', "12,B,,3,MAJU"])
    sheet(folder, "b.csv", [",,first row has no code,4,", "13,C,y,5,MANDIRI"],
          header="Kode Desa,Nama Desa,Keterangan,NILAI,target idm 2025, Lain ")
    sheet(folder, "short.csv", [], titles=("only",), header="two")
    sheet(folder, "other.csv", ["1,2"], header="a,b")
    (folder / "binary.csv").write_bytes(b"a\nb\nc\nKode Desa\n\xff\xfe\x00\n")
    (folder / "empty.csv").write_text("")
    (folder / "fake.csv.gz").write_bytes(b"this is no gzip stream")
    sheets = sh.SheetFolder(spark, str(folder), 3, required=["KODE DESA"])
    errors = {r["file_path"].rsplit("/", 1)[1]: r["error"] for r in sheets.rejects.collect()}
    assert errors == {"short.csv": "no header row", "other.csv": "missing columns: KODE DESA",
                      "binary.csv": "not valid text", "empty.csv": "empty or unreadable",
                      "fake.csv.gz": "empty or unreadable"}
    rows = sh.fill_identity(sheets.rows(), IDENTITY_COLUMNS)
    got = [(r["KODE DESA"], r["NAMA DESA"], r["KETERANGAN"], r["NILAI"], r["LAIN"], r["row_no"])
           for r in rows.orderBy("file_path", "row_no").collect()]
    assert got == [("0011", "Ujong, A", "x", "1", None, 4), ("0011", "Ujong, A", 'say "hi"', "2", None, 5),
                   ("12", "B", None, "3", None, 6), (None, None, "first row has no code", "4", None, 4),
                   ("13", "C", "y", "5", None, 5)]


def test_positions_are_dense_across_splits(spark, tmp_path):
    lines = [f"line {i:06d} " + "x" * 50 for i in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_text("\na\n\nb\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        read = sh.read_lines(spark, str(tmp_path))[0].persist()
        big = read.filter(F.col("file_path").endswith("big.txt"))
        assert big.count() == 20_000
        wrong = big.filter(F.col("row_no") != F.substring("line", 6, 6).cast("bigint"))
        assert wrong.count() == 0
        small = read.filter(F.col("file_path").endswith("small.txt")).orderBy("row_no").collect()
        assert [(r["row_no"], r["line"]) for r in small] == [(0, ""), (1, "a"), (2, ""), (3, "b")]
        read.unpersist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_line_breaks_in_cells_across_splits(spark, tmp_path, split):
    rng = random.Random(3)
    texts = ["plain", "a, b", "line one\nline two", '5" pipe', 'say "hi",\n\n"ho"\n', "\n", '"', 'x\n",y', "", 'end"\n']
    rows = [[str(i), rng.choice(texts), rng.choice(texts)] for i in range(400)]
    folder = tmp_path / "s"
    folder.mkdir()
    for name, part in (("a.csv", rows[:350]), ("b.csv", rows[350:])):
        with open(folder / name, "w", newline="", encoding="utf-8") as out:
            out.write('"Judul\nbaris dua"\n')
            csv.writer(out, lineterminator="\n").writerows([["key", "One", "two\nlines"], *part])
    (folder / "open.csv").write_text('t\nkey,one\n1,"never closed\n2,x\n')
    (folder / "stray.csv").write_text('t\nkey,one\nk1,5" pipe\nk2,"6"" pipe"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        sheets = sh.SheetFolder(spark, str(folder), 1, required=["KEY"])
        assert [(r["file_path"].rsplit("/", 1)[1], r["error"]) for r in sheets.rejects.collect()] == [
            ("open.csv", "quoted cell without an end")]
        got = sheets.rows().orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    have = [(r["KEY"], r["ONE"], r["TWO\nLINES"]) for r in got]
    assert have == [(k, a or None, b or None) for k, a, b in rows] + [("k1", '5" pipe', None), ("k2", '6" pipe', None)]
    assert [r["row_no"] for r in got] == [*range(2, 352), *range(2, 52), 2, 3]


def test_header_names(spark):
    assert sh.normalize_header(spark.createDataFrame([(1, 2)], "` a ` int, b int")).columns == ["A", "B"]


def test_summary_is_stored_once_and_not_when_empty(spark, tmp_path):
    cols = Columns()
    rows = [("1", "P", 0.1, 0.2, 0.3, 0.2, "MAJU"), ("2", "P", 0.3, 0.4, 0.5, 0.4, "BERKEMBANG")]
    schema = ("KODE_DESA string, NAMA_PROVINSI string, IKS_2024 double, IKE_2024 double, IKL_2024 double, "
              "NILAI_IDM_2024 double, STATUS_IDM_2024 string")
    units, path = spark.createDataFrame(rows, schema), str(tmp_path / "regions")
    assert region_summary(spark, path, units.limit(0), cols).isEmpty() and not st.path_exists(spark, path)
    first = region_summary(spark, path, units, cols).collect()
    again = region_summary(spark, path, units.limit(0), cols).collect()
    assert first == again and again[0]["STATUS_IDM_modus"] == "BERKEMBANG" and again[0]["jumlah_desa"] == 2
    other = str(tmp_path / "foreign")
    st.write_csv(spark.createDataFrame([(1,)], "x int"), other)
    assert region_summary(spark, other, units, cols).count() == 1


def test_region_profile_schema(spark):
    ours = region_profile(spark.createDataFrame([], (
        "KODE_DESA string, NAMA_PROVINSI string, IKS_2024 double, IKE_2024 double, IKL_2024 double, "
        "NILAI_IDM_2024 double, STATUS_IDM_2024 string")))
    assert ours.dtypes == [
        ("NAMA_PROVINSI", "string"), ("IKS_median", "double"), ("IKE_median", "double"),
        ("IKL_median", "double"), ("NILAI_IDM_median", "double"), ("STATUS_IDM_modus", "string"),
        ("jumlah_desa", "bigint")]


def test_absent_model_is_none(spark, tmp_path):
    assert sm.load_model(spark, str(tmp_path / "m")) is None


def test_scrub_flow(spark, tmp_path):
    (tmp_path / "units.csv").write_text(
        "KODE_DESA,NAMA_DESA,NAMA_PROVINSI,IKS_2024,IKE_2024,IKL_2024,NILAI_IDM_2024,STATUS_IDM_2024,Keterangan\n"
        "1101012003,,P,0.5,0.4,0.6,0.5,TERTINGGAL,a\n"
        "12,B,P,0.7,,0.7,0.7,,b\n"
        "13,C,Q,0.9,0.8,0.9,0.9,TERTINGGAL,c\n"
        "14,D,Q,tidak aktif,0.1,0.1,0.1,MAJU,d\n")
    sheet(tmp_path / "sheets", "p.csv", ["12,B,perbaiki jalan,1.5,MAJU", ",,-,2,MAJU", ",,perbaiki jalan,,MANDIRI",
                                         "1101012003,A,-,,", "99,X,lain,1,MAJU"])
    result = scrub(spark, str(tmp_path / "units.csv"), str(tmp_path / "sheets"))
    got = {r["KODE_DESA"]: r.asDict() for r in result.modeling.collect()}
    assert set(got) == {"1101012003", "12", "13"} and result.invalid.count() == 1 and result.rejects.isEmpty()
    a, b, c = got["1101012003"], got["12"], got["13"]
    assert a["NAMA_DESA"] == "UJONG PADANG" and a["keterangan_gabungan"] == "Tidak ada rekomendasi spesifik"
    assert a["target_idm_2025"] == "TERTINGGAL" and a["has_rekomendasi"] and a["jumlah_rekomendasi"] == 1
    assert b["IKE_2024"] == pytest.approx(0.6) and b["STATUS_IDM_2024"] == "TERTINGGAL"
    assert (b["jumlah_rekomendasi"], b["total_nilai_rekomendasi"], b["keterangan_gabungan"]) == (3, 3.5, "perbaiki jalan")
    assert b["target_idm_2025"] == "MAJU" and b["intensitas_rekomendasi"] == pytest.approx(1.5)
    assert (c["has_rekomendasi"], c["jumlah_rekomendasi"], c["total_nilai_rekomendasi"]) == (False, 0, 0.0)
    assert c["keterangan_gabungan"] == "Tidak ada data rekomendasi" and c["target_idm_2025"] == "TERTINGGAL"
    assert c["intensitas_rekomendasi"] == 0.0 and c["dimensi_terendah"] == "Ekonomi"
    assert "Keterangan" not in result.modeling.columns


def test_bad_files_are_found_in_one_pass(spark, tmp_path, monkeypatch):
    import bz2
    import gzip

    from regiometra.sources import lines

    folder = tmp_path / "packed"
    folder.mkdir()
    text = "K,N\n" + "".join(f"{i},{i * i % 977}\n" for i in range(3000))
    for i in range(16):
        data = bz2.compress(text.encode()) if i % 4 == 3 else gzip.compress(text.encode())
        data = data if i >= 6 else data[:len(data) // 2] if i != 4 else data + b"junk"
        (folder / f"s {i}.csv.{'bz2' if i % 4 == 3 else 'gz'}").write_bytes(data)
    (folder / "two.csv.gz").write_bytes(gzip.compress(text.encode()) + gzip.compress(b"9,9\n"))
    (folder / "none.csv.gz").write_bytes(b"")
    (folder / "plain.csv").write_text(text)
    written, own = [], lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name: written.append(name) or own(df, name))
    sheets = sh.SheetFolder(spark, str(folder), 0, ["K"])
    assert written.count("lines") == 1  # one probe and one read
    assert sheets.rejects.count() == 7
    assert sheets.rows().count() == 12 * 3000 + 1


def test_a_large_csv_is_read_by_several_tasks(spark, tmp_path):
    rows = [(i, f"text {i}\nnext \"line\", {i}" if i % 3 else f"plain {i}") for i in range(20_000)]
    path = str(tmp_path / "large")
    st.write_csv(spark.createDataFrame(rows, "k int, t string"), path, files=1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = st.read_raw_csv(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    staged = found.inputFiles()
    assert len(staged) > 4
    assert sorted((int(r.k), r.t) for r in found.collect()) == rows


def test_two_writers_and_a_reader_meet_whole_tables_only(spark, tmp_path):
    import threading

    path, barrier, results, seen = str(tmp_path / "summary"), threading.Barrier(3), {}, []

    def compute(name):
        barrier.wait(timeout=60)
        return spark.range(40).select(F.col("id").alias("k"), F.lit(name).alias("who"))

    def write(name):
        found = st.materialize_if_absent(spark, path, "k", lambda: compute(name))
        results[name] = {r["who"] for r in found.collect()}

    writers = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for w in writers:
        w.start()
    barrier.wait(timeout=60)
    while any(w.is_alive() for w in writers):
        folder = st.published(spark, path)
        if folder:
            seen.append([(r["k"], r["who"]) for r in spark.read.option("header", True).csv(folder).collect()])
    assert results["a"] == results["b"] and len(results["a"]) == 1
    assert all(len(rows) == 40 and len({w for _, w in rows}) == 1 for rows in seen)
    again = st.materialize_if_absent(spark, path, "k", lambda: compute("late"))
    assert {r["who"] for r in again.collect()} == results["a"]


def test_a_publication_replaces_the_former_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    assert st.published(spark, path) is None
    first = st.publish(spark, path, lambda f: st.write_parquet(spark.range(3).toDF("a"), f))
    held = spark.read.parquet(first)
    second = st.publish(spark, path, lambda f: st.write_parquet(spark.range(5).toDF("a"), f))
    assert st.published(spark, path) == second != first
    assert held.count() == 3 and spark.read.parquet(second).count() == 5
    with pytest.raises(ZeroDivisionError):
        st.publish(spark, path, lambda f: 1 / 0)
    assert st.published(spark, path) == second


def _batches(rows, names, cuts):
    import pyarrow as pa

    whole = pa.Table.from_pylist([dict(zip(names, r)) for r in rows]).combine_chunks().to_batches()[0]
    ends = [*cuts, len(rows)]
    return [whole.slice(low, high - low) for low, high in zip([0, *cuts], ends)]


def test_quotes_and_records_are_carried_over_the_batches_of_a_task():
    from regiometra.sources.lines import _merged, _tagged

    draw = random.Random(7)
    for _ in range(50):
        # Two splits, and a hole in the first one: three runs.
        places = [(5, n) for n in range(5, 25)] + [(5, n) for n in range(40, 50)] + [(90, n) for n in range(90, 110)]
        rows = [(*p, f"l{p[1]}", *draw.choice([(True, True), (False, False), (True, False), (False, True)])) for p in places]
        cuts = sorted(draw.sample(range(1, len(rows)), 4))
        tagged = [r for b in _tagged(iter(_batches(rows, ["_first", "_at", "line", "_out", "_in"], cuts))) for r in b.to_pylist()]
        assert [(r["_at"], r["line"]) for r in tagged] == [(r[1], r[2]) for r in rows]
        for start, kind in ((False, "out"), (True, "in")):
            state, n, run = start, 0, None
            for r in tagged:
                if r["_at"] in (5, 40, 90):
                    state, n, run = start, 0, r["_at"]
                n += not state
                assert (r["_run"], r[f"_from_{kind}"], r[f"_n_from_{kind}"]) == (run, state, n)
                state = r["_in"] if state else r["_out"]
        begins = [draw.random() < 0.3 for _ in rows]
        lines = [("f", sum(begins[:i + 1]), 0, r[0], r[1], r[2], begins[i], i + 1 == len(rows) or begins[i + 1]) for i, r in enumerate(rows)]
        names = ["file_path", "row_no", "_split", "_first", "_at", "line", "_begins", "_ends"]
        merged = [r for b in _merged(iter(_batches(lines, names, cuts))) for r in b.to_pylist()]
        wanted, last = [], None
        for i, (_, number, _, _, at, line, begin, _) in enumerate(lines):
            if begin or at in (5, 40, 90):
                wanted.append([number, at, [], begin])
            wanted[-1][2].append(line)
            last = lines[i][-1]
            wanted[-1][4:] = [last]
        assert [(r["row_no"], r["_at"], r["line"], r["_whole"]) for r in merged] == [
            (n, at, "\n".join(parts), begin and end) for n, at, parts, begin, end in wanted]


def test_cells_are_not_shuffled_to_find_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,x\n2,y\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = st.read_raw_csv(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan


def test_filled_rows_are_not_shuffled_to_meet_what_is_carried(spark):
    from regiometra.operators.cleaning import forward_fill

    rows = spark.createDataFrame([(None, 1, "a"), (None, 9, None), ("f", 2, None), ("f", 5, "b"), ("f", 30, None)], "file string, at int, cell string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = forward_fill(rows, ["cell"], "file", "at", chunk=10)
        assert "SortMergeJoin" not in filled._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["file"] or "", r["at"], r["cell"]) for r in filled.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [("", 1, "a"), ("", 9, "a"), ("f", 2, None), ("f", 5, "b"), ("f", 30, "b")]
