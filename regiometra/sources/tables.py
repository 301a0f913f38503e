"""Delimited and Parquet tables: reading with explicit types, writing, reuse of stored results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regiometra.functions import coerce_numeric
from regiometra.session import stage
from regiometra.sources.lines import read_lines

BOM = "﻿"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob exists, on whichever file system the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(jvm_path)
    return found is not None and len(found) > 0


_FILES_TO_BROADCAST = 20_000
_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of small files, each read by one task."""
    return spark.read.options(header=True, **_CSV).csv(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text; types are the business of the cleaning step.

    Nothing is inferred and leading zeros survive. Quoted cells may hold line breaks. A file is split over many
    tasks: its lines are staged, joined to records where a quote is left open, and only then cut into cells. The
    first record of a file that is not blank is its header, and the columns are those of the first file. In a file that
    never closes a quote every line is a record.
    """
    columns = _whole_files(spark, path).columns
    lines, broken = read_lines(spark, path, recursive=False, line_sep="\n")
    if broken:
        raise ValueError(f"cannot be read to the end: {', '.join(broken[:5])}")
    records = lines.where(F.rtrim(F.regexp_replace("line", "^\ufeff", "")) != "")
    heads = stage(records.groupBy("file_path").agg(F.min("row_no").alias("_head")), "csv-heads")  # one row per file
    if heads.count() <= _FILES_TO_BROADCAST:
        heads = F.broadcast(heads)
    body = records.join(heads, "file_path").where(F.col("row_no") > F.col("_head"))
    names = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    return body.select(F.from_csv("line", names, _CSV).alias("_cells")).select("_cells.*")


def read_typed_csv(spark: SparkSession, path: str, numeric: Sequence[str],
                   string_prefix: str = "KODE_", strings: Sequence[str] = (),
                   flags: Sequence[str] = ()) -> DataFrame:
    """Header CSV with codes as text and the listed numeric and flag columns, if present, coerced.

    A column that is a code by name or by list stays text even when listed as numeric.
    """
    raw = read_raw_csv(spark, path)

    def typed(name: str):
        column = F.col(f"`{name}`")
        if name in strings or name.startswith(string_prefix):
            return column
        if name in numeric:
            return coerce_numeric(column).alias(name)
        if name in flags:
            return column.try_cast("boolean").alias(name)
        return column

    return raw.select(*[typed(c) for c in raw.columns])


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str,
                  reader: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """The table at ``path``, or an empty one of the given schema if nothing is there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader(spark, path) if reader else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False, files: int | None = None) -> None:
    """Header CSV without row index, overwriting; the folder is made if absent.

    Text is written as it is, blanks at its ends and line breaks included.

    ``bom`` starts every file with the UTF-8 byte order mark some spreadsheets need. ``files``
    bounds the number of files and is meant for small summaries.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    if files is not None:
        df = df.coalesce(files)
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Default sink; the folder is made if absent and overwritten."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


_POINTER = "_CURRENT"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def published(spark: SparkSession, path: str) -> str | None:
    """The folder with the table in force at ``path``: the one its pointer names, or a plain, completed folder."""
    files, pointer = _file_system(spark, f"{path}/{_POINTER}")
    if files.exists(pointer):
        stream = files.open(pointer)
        try:
            return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()
    return path if path_exists(spark, f"{path}/_SUCCESS") else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None], replace: bool = True) -> str:
    """Write a table to a fresh folder below ``path`` and then point to it; returns the folder in force.

    The pointer is one small file and comes into force by a rename, so a reader finds the former table or the whole
    new one. Without ``replace`` the first of several writers wins, and the others get its folder. Folders no longer
    in force stay, as readers may still be at them.
    """
    version = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    files, draft = _file_system(spark, f"{path}/_{version}")
    stream = files.create(draft)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    how = spark.sparkContext._gateway.new_array(options.Rename, 1)
    how[0] = options.Rename.OVERWRITE if replace else options.Rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}"), how)
    except Py4JJavaError as error:
        if replace or "FileAlreadyExists" not in str(error.java_exception):
            raise
        files.delete(draft, False)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")).close()  # for those who wait for the usual mark
    return published(spark, path) or f"{path}/{version}"


def materialize_if_absent(spark: SparkSession, path: str, required: str,
                          compute: Callable[[], DataFrame],
                          types: Mapping[str, str] | None = None) -> DataFrame:
    """Reuse the summary CSV published at ``path`` if it has the ``required`` column, else compute and publish it.

    An empty result is returned and not stored. ``types`` casts the columns of the stored text. A folder that a
    broken write has left without its success mark counts as absent. Of two sessions that find nothing both compute,
    one publishes, and both read what it has published.
    """
    def stored(folder: str) -> DataFrame:
        raw = _whole_files(spark, folder)
        return raw.select(*[F.col(f"`{c}`").try_cast((types or {}).get(c, "string")).alias(c)
                            for c in raw.columns])

    folder = published(spark, path)
    if folder:
        found = stored(folder)
        if required in found.columns:
            return found
    fresh = compute().persist()  # a summary: small, and needed for the test and the write
    try:
        if fresh.isEmpty():
            return spark.createDataFrame([], fresh.schema)
        return stored(publish(spark, path, lambda target: write_csv(fresh, target), replace=folder is not None))
    finally:
        fresh.unpersist()
