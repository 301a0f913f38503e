"""Lines and records of text files with their positions, from splittable reads.

Files are read as splittable lines, so one huge file is spread over many tasks. The position
of a line within its file comes from the split it is in and its place in that split. Lines that
break inside a quoted cell are joined again; whether a quote is open at a line is carried over
the lines that a task reads one after the other, and from there on through one row per such run.
"""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regiometra.session import stage

_SPLITS_TO_BROADCAST = 200_000
#: Compressed files of more bytes are not looked into before they are read.
_PROBE_BYTES = 1 << 29
_CHUNK = 1 << 20


def plain_path(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def _stream_error(name: str, content: bytes) -> str | None:
    """Why a compressed file cannot be read to its end, or null; nothing is kept of what it holds."""
    make = bz2.BZ2Decompressor if name.endswith(".bz2") else lambda: zlib.decompressobj(31 if name.endswith(".gz") else 15)
    rest = content
    try:
        while True:
            stream, at = make(), 0
            while not stream.eof:
                if at >= len(rest):
                    return "the stream ends early"
                part = rest[at:at + _CHUNK]
                if isinstance(stream, bz2.BZ2Decompressor):
                    stream.decompress(part)
                else:
                    stream.decompress(part, _CHUNK)
                    while stream.unconsumed_tail:  # at most a chunk of text at once, however well it was packed
                        stream.decompress(stream.unconsumed_tail, _CHUNK)
                at += _CHUNK
            rest = stream.unused_data + rest[at:]
            if not rest:
                return None
    except (zlib.error, OSError, EOFError, ValueError) as error:
        return str(error)


def unreadable_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file_path, error) of every compressed file below ``path`` that ends early or is damaged.

    All are opened to their end in one pass, each within one task and apart from the others. Files without one of the
    suffixes, or larger than the bound, are not read here.
    """
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, e) for f, content in zip(batch["file_path"], batch["content"]) if (e := _stream_error(f, content)) is not None]
            yield pd.DataFrame(rows, columns=["file_path", "error"])

    packed = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
              .option("pathGlobFilter", "*.{gz,bz2,deflate}").load(path).where(F.col("length") <= _PROBE_BYTES))
    return packed.select(F.col("_metadata.file_path").alias("file_path"), "content").mapInPandas(probe, "file_path string, error string")


def _staged_lines(spark: SparkSession, path: str, recursive: bool, line_sep: str | None) -> tuple[DataFrame, list[str]]:
    """Tagged lines of all files that can be read to their end, and the paths of the others.

    Compressed files are probed first, all in one pass, and those found bad are pruned by their path. Reading is then
    strict; what a probe cannot foresee, such as a store that fails, leaves out the file and reads the rest again.
    """
    bad = [r["file_path"] for r in unreadable_files(spark, path, recursive).collect()]  # bad files only
    broken = [plain_path(f) for f in bad]
    while True:
        reader = spark.read.option("ignoreCorruptFiles", False).option("recursiveFileLookup", recursive)
        if line_sep:
            reader = reader.option("lineSep", line_sep)
        read = reader.text(path)
        name = F.col("_metadata.file_path")
        text = (read.where(~name.isin(bad)) if bad else read).select(
            name.alias("file_path"), F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
        try:
            return stage(text, "lines"), broken
        except Exception as error:
            named = re.search(r"FAILED_READ_FILE.*? reading file (\S+?)\.?\s", str(error), re.DOTALL)
            if not named or plain_path(named.group(1)) in broken:
                raise
            failed = plain_path(named.group(1))
            broken.append(failed)
            bad += [failed, failed.replace("file:/", "file:///", 1)]


def _opens(line: Column, separator: str) -> Column:
    """Whether a quoted cell is still open at the end of a line that starts outside of one."""
    sep = re.escape(separator)
    whole = rf"\G{sep}(?:\"[^\"]*+(?:\"\"[^\"]*+)*+\"[^{sep}]*+|(?!\")[^{sep}]*+)"
    return F.regexp_replace(F.concat(F.lit(separator), line), F.lit(whole), F.lit("")) != ""


def _states(out: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The state before each line and after the last, from the states after a line that starts outside or inside a quote.

    A line that gives both the same settles the state; from there on only lines that turn it round count.
    """
    at = np.maximum.accumulate(np.where(out == inside, np.arange(1, len(out) + 1), 0))
    turns = np.concatenate([[0], np.cumsum(out & ~inside)])
    settled = np.concatenate([[start], out])[at]
    return np.concatenate([[start], settled ^ ((turns[1:] - turns[at]) % 2 == 1)])


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their run, and the state before and the records up to each if the run starts outside or inside a quote.

    A run is a stretch of lines of one split that a task reads one after the other; its number is the place of the first.
    """
    last, run, states, counts = None, 0, (False, True), (0, 0)
    for batch in batches:
        first, at = (batch.column(c).to_numpy() for c in ("_first", "_at"))
        out, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_out", "_in"))
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(first) != 0)) + 1
        ends = [*breaks.tolist(), batch.num_rows]
        for low, high in zip([0, *ends], ends):
            if low == high:
                continue
            if (first[low], at[low] - 1) != last:
                run, states, counts = at[low], (False, True), (0, 0)
            last = (first[low], at[high - 1])
            before = [_states(out[low:high], inside[low:high], s) for s in states]
            places = [n + np.cumsum(~b[:-1]) for n, b in zip(counts, before)]
            states, counts = [b[-1] for b in before], [n[-1] for n in places]
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(high - low, run)), *[pa.array(b[:-1]) for b in before], *map(pa.array, places)],
                [*part.schema.names, "_run", "_from_out", "_from_in", "_n_from_out", "_n_from_in"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one record that follow each other as one row; ``_whole`` if they are all of the record."""
    def rows(parts: list[pa.RecordBatch], starts: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ends = np.append(starts[1:], table.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows), pa.int32()), table["line"].chunk(0))
        whole = pc.and_(table["_begins"].take(pa.array(starts)), table["_ends"].take(pa.array(ends - 1)))
        kept = table.select(["file_path", "row_no", "_split", "_at"]).take(pa.array(starts))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in kept.columns], pc.binary_join(lists, "\n"), whole.combine_chunks()],
                                          ["file_path", "row_no", "_split", "_at", "line", "_whole"])

    held, last = [], None  # the lines of the record that is still open
    for batch in batches:
        if not batch.num_rows:
            continue
        first, at = (batch.column(c).to_numpy() for c in ("_first", "_at"))
        starts = batch.column("_begins").to_numpy(zero_copy_only=False).copy()
        starts[1:] |= (np.diff(at) != 1) | (np.diff(first) != 0)
        starts[0] |= (first[0], at[0] - 1) != last
        last, cuts = (first[-1], at[-1]), np.flatnonzero(starts)
        if not len(cuts):
            held.append(batch)
            continue
        before = sum(b.num_rows for b in held)
        done = np.concatenate([[0] if before else [], before + cuts[:-1]]).astype("int64")
        if len(done):
            yield rows([*held, batch.slice(0, cuts[-1])], done)
        held = [batch.slice(cuts[-1])]
    if held:
        yield rows(held, np.zeros(1, "int64"))


def _with_start(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Adds ``_from_out``: the state before each row if the first one starts outside of a quote.

    ``_out`` and ``_in`` are the states after a row by the one before it. A row that gives both the same settles the
    state; from there on only rows that turn it round count.
    """
    earlier = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("_out") & ~F.col("_in")).cast("int")).over(earlier), F.lit(0))
    settled = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), F.col("_turns").alias("turns")))
    df = df.withColumn("_turns", turns).withColumn("_settled", F.last(settled, ignorenulls=True).over(earlier))
    since = F.col("_turns") - F.coalesce(F.col("_settled.turns"), F.lit(0))
    state = F.coalesce(F.col("_settled.state"), F.lit(False)) != (since % 2 == 1)
    return df.withColumn("_from_out", state).drop("_turns", "_settled")


def _beside(lines: DataFrame, table: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Lines with what a table of one row per split or run says of them, those of a split still one after the other.

    Beyond the bound the join shuffles, evenly, as splits are of one size.
    """
    if rows <= _SPLITS_TO_BROADCAST:
        return lines.join(F.broadcast(table), keys)
    return lines.join(table, keys).sortWithinPartitions("_first", "_at")


def _joined(lines: DataFrame, splits: DataFrame, separator: str) -> DataFrame:
    """Records of sheets with line breaks in cells, from their lines with split and place.

    A task carries the state and joins lines as it reads them; only states of runs, and records that a run or a task
    cuts, meet in a shuffle.
    """
    quoted = F.col("line").contains('"')
    flagged = lines.select("_first", "_at", "line", (quoted & _opens(F.col("line"), separator)).alias("_out"),
                           (~quoted | _opens(F.concat(F.lit('"'), F.col("line")), separator)).alias("_in"))
    tagged = stage(flagged.mapInArrow(_tagged, "_first bigint, _at bigint, line string, _out boolean, _in boolean, _run bigint, "
                                      "_from_out boolean, _from_in boolean, _n_from_out bigint, _n_from_in bigint"), "line-quotes")
    after = {c: F.when(F.col(c), F.col("_in")).otherwise(F.col("_out")) for c in ("_from_out", "_from_in")}
    runs = tagged.groupBy("_first", "_run").agg(
        F.max_by(after["_from_out"], "_at").alias("_out"), F.max_by(after["_from_in"], "_at").alias("_in"),
        F.max("_n_from_out").alias("_records_out"), F.max("_n_from_in").alias("_records_in"))
    order = ["_split", "_run"]
    runs = _with_start(runs.join(splits.select("_first", "file_path", "_split"), "_first"), ["file_path"], order)
    earlier = Window.partitionBy("file_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    records = F.when(F.col("_from_out"), F.col("_records_in")).otherwise(F.col("_records_out"))
    runs = (runs.withColumn("_records", records)
            .select("file_path", *order, "_in", "_out", F.col("_from_out").alias("_inside"),
                    F.coalesce(F.sum("_records").over(earlier), F.lit(0)).alias("_sooner")))
    # A quote that the file never closes swallows the rest of it; its lines are marked and stay as they are.
    after = F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out"))
    ends = runs.groupBy("file_path").agg(F.max_by(after, F.struct(*order)).alias("_endless"))
    runs = stage(runs.join(ends, "file_path").drop("_in", "_out"), "line-runs")
    started = F.when(F.col("_inside"), F.col("_n_from_in")).otherwise(F.col("_n_from_out"))
    inside = F.when(F.col("_inside"), F.col("_from_in")).otherwise(F.col("_from_out"))
    placed = (_beside(tagged, runs, ["_run"], runs.count())
              .withColumns({"row_no": F.col("_sooner") + started - 1, "_before": inside})
              .withColumn("_after", F.when(F.col("_before"), F.col("_in")).otherwise(F.col("_out"))))
    wraps = (F.col("_before") | F.col("_after")) & ~F.col("_endless")
    broken = (placed.filter(wraps)
              .select("file_path", "row_no", "_split", "_first", "_at", "line", (~F.col("_before")).alias("_begins"), (~F.col("_after")).alias("_ends"))
              .mapInArrow(_merged, "file_path string, row_no bigint, _split bigint, _at bigint, line string, _whole boolean"))
    found = placed.filter(~wraps).select("file_path", "row_no", "_split", "_at", "line", F.col("_endless").alias("unclosed"), F.lit(True).alias("_whole"))
    found = stage(found.unionByName(broken.withColumn("unclosed", F.lit(False))), "records")
    parts = F.sort_array(F.collect_list(F.struct("_split", "_at", "line")))
    cut = found.filter(~F.col("_whole")).groupBy("file_path", "row_no").agg(
        F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line"), F.lit(False).alias("unclosed"))
    return found.filter("_whole").select("file_path", "row_no", "line", "unclosed").unionByName(cut)


def read_lines(spark: SparkSession, path: str, separator: str = ",", recursive: bool = True,
               line_sep: str | None = None) -> tuple[DataFrame, list[str]]:
    """(file_path, row_no, line, unclosed): every line of every readable file with its 0-based position; and unreadable files.

    Lines that break inside a quoted cell are one, with a line feed at each break and one position;
    the lines of a file that never closes a quote are all ``unclosed``, and not joined.
    Positions are dense within a file: lines before the split (a running sum over one row
    per split) plus the place within the split. The tagged lines are staged, because how
    files are cut into splits may change from one job to the next, and as columns the tags
    can be read without the text. Only files in which a line leaves a quote open are looked at
    once more, split by split.
    """
    lines, broken = _staged_lines(spark, path, recursive, line_sep)
    opens = F.col("line").contains('"') & _opens(F.col("line"), separator)
    splits = lines.groupBy("file_path", "_split").agg(F.min("_at").alias("_first"),
                                                       F.count("*").alias("_lines"),
                                                       F.bool_or(opens).alias("_opens"))
    file = Window.partitionBy("file_path")
    earlier = file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(splits.select(
        "file_path", "_split", "_first", F.bool_or("_opens").over(file).alias("_wraps"),
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")), "line-splits")
    count, wraps = offsets.agg(F.count("*"), F.bool_or("_wraps")).first()
    placed = _beside(lines, offsets, ["file_path", "_split"], count)
    plain = (placed.filter(~F.col("_wraps"))
             .select("file_path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("row_no"),
                     "line", F.lit(False).alias("unclosed")))
    if not wraps:
        return plain, broken
    return plain.unionByName(_joined(placed.filter("_wraps"), offsets, separator)), broken
