"""A folder of delimited sheets whose header stands below some title rows; lines come from ``lines``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regiometra.functions import trim_all
from regiometra.operators.cleaning import forward_fill
from regiometra.session import stage
from regiometra.sources.lines import plain_path, read_lines
from regiometra.sources.tables import BOM

_FILES_TO_BROADCAST = 20_000


def _cells(line: Column, separator: str) -> Column:
    """Raw cells of one CSV line, quotes still on; any number of them, in one pass."""
    sep = re.escape(separator)
    cell = rf"{sep}(\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^{sep}]*+)"
    return F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(cell), F.lit(1))


def _unquoted(cell: Column) -> Column:
    """Cell text without its quotes; an empty cell is null."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    quoted = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1)
    return F.nullif(F.when(quoted, inner).otherwise(cell), F.lit(""))


def _normal_names(cells: Column) -> Column:
    """Header names stripped and upper-cased, a byte order mark removed; blank ones are null."""
    bare = F.transform(cells, lambda c: F.upper(trim_all(_unquoted(F.replace(c, F.lit(BOM))))))
    return F.transform(bare, lambda c: F.nullif(c, F.lit("")))


def normalize_header(df: DataFrame) -> DataFrame:
    """Strip and upper-case every column name."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


class SheetFolder:
    """The sheets below ``path``; ``rows`` are the accepted ones, ``rejects`` the others.

    A sheet is rejected as a whole if nothing can be read from it, if it has no header row, if
    its header lacks a ``required`` column, if a line is not valid UTF-8 text, or if a quoted cell
    has no end; the rest goes on. Quoted cells may hold the separator and line breaks, which are
    read as line feeds; ``header_row`` and ``row_no`` count rows, not their lines.
    """

    def __init__(self, spark: SparkSession, path: str, header_row: int = 3,
                 required: Sequence[str] = (), separator: str = ","):
        self.spark = spark
        self.header_row = header_row
        self.separator = separator
        self._lines, unreadable = read_lines(spark, path, separator)
        broken = ~F.is_valid_utf8("line") | F.col("line").contains("\x00")
        header_line = F.max(F.when(F.col("row_no") == header_row, F.col("line")))
        # One header line and one flag per file, combined before the shuffle.
        found = (self._lines.groupBy("file_path")
                 .agg(header_line.alias("_line"), F.bool_or(broken).alias("_broken"), F.count("*").alias("_rows"),
                      F.bool_or("unclosed").alias("_unclosed")))
        # The reader's listing brings in files that gave no line at all.
        reader = spark.read.option("recursiveFileLookup", True).text(path)
        names = [(plain_path(name),) for name in reader.inputFiles()]
        failed = set(unreadable)
        listed = spark.createDataFrame([(name, name in failed) for name, in names], "_listed string, _failed boolean")
        local = F.regexp_replace("file_path", "^file:/+", "file:/")
        files = (listed.join(found, F.col("_listed") == local, "left")
                 .withColumn("file_path", F.coalesce("file_path", "_listed"))
                 .withColumn("header", _normal_names(_cells(F.col("_line"), separator))))
        named = F.array_compact("header")
        wanted = F.array(*[F.lit(c) for c in required]).cast("array<string>")
        lacking = F.array_except(wanted, named)
        error = (F.when(F.col("_failed") | F.col("_broken").isNull(), F.lit("empty or unreadable"))
                 .when(F.col("_broken"), F.lit("not valid text"))
                 .when(F.col("_unclosed"), F.lit("quoted cell without an end"))
                 .when(F.coalesce(F.size(named), F.lit(0)) <= 0, F.lit("no header row"))
                 .when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "),
                                                     F.array_join(lacking, ", "))))
        # One row per file, so a running sum over them in one window is cheap.
        earlier = F.sum("_rows").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
        self._files = stage(files.select("file_path", F.coalesce(earlier, F.lit(0)).alias("_sooner"), "header",
                                         error.alias("error")), "sheet-headers")

    @property
    def rejects(self) -> DataFrame:
        """(file_path, error), one row per sheet left out."""
        return self._files.filter(F.col("error").isNotNull()).select("file_path", "error")

    def layouts(self) -> list[tuple[list[str | None], int]]:
        """Distinct headers with the number of sheets that have them.

        The output schema must be known before the query runs, as with merged Parquet schemas;
        only distinct layouts reach the driver, never rows.
        """
        found = (self._files.filter(F.col("error").isNull())
                 .groupBy("header").agg(F.count("*").alias("files")).collect())
        return [(list(r["header"]), r["files"]) for r in found]

    def rows(self) -> DataFrame:
        """Union of the accepted sheets by column name; absent columns are null, all are text.

        (file_path, row_no) say where a row came from; ``position`` is the same order as one
        number over all sheets.
        """
        layouts = self.layouts()
        names = sorted({n for header, _ in layouts for n in header if n})
        headers = (self._files.filter(F.col("error").isNull()).select("file_path", "_sooner", "header"))
        if sum(files for _, files in layouts) <= _FILES_TO_BROADCAST:
            headers = F.broadcast(headers)
        body = (self._lines.filter((F.col("row_no") > self.header_row)
                                   & (F.trim(F.col("line")) != ""))
                .join(headers, "file_path")
                .select("file_path", "row_no", "_sooner", "header",
                        _cells(F.col("line"), self.separator).alias("_cells")))
        position = F.col("_sooner") + F.col("row_no")
        return body.select("file_path", "row_no", position.alias("position"), *[
            _unquoted(F.get("_cells", F.array_position("header", F.lit(n)).cast("int") - 1)).alias(n)
            for n in names])


def read_directory(spark: SparkSession, path: str, header_row: int = 0,
                   required: Sequence[str] = (), separator: str = ",") -> DataFrame:
    """All sheets below ``path`` as one table; see ``SheetFolder`` for what is left out."""
    return SheetFolder(spark, path, header_row, required, separator).rows()


def fill_identity(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Carry merged identity cells down within each sheet, before the sheets meet."""
    return forward_fill(rows, columns, "file_path", "row_no")


