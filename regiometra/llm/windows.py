"""Packing documents into windows by non-negative least squares over shallow combinations, with free cuts.

A document longer than a window gives whole windows, each a sequence of its own, and a tail. Tails are counted by
length. Combinations ``i * a + j * b`` of at most ``depth`` tails of one or two lengths that fill a window exactly are
enumerated, repeat counts are solved against the histogram by accelerated projected gradients, rounded and bounded by
what is left; a second fit sees the rest. No tail in a combination is cut. What remains is packed greedily, longest
first: a tail that crosses the end of a window is cut there. The end of that line goes to sequences of powers of two,
which need no padding, so no sequence is padded where the window is such a power (else only the last one is).

The driver sees one count per length, at most ``window`` of them. The place of a tail among those of its length comes
from its task and the count within it, so equal documents, null ids or one hot key never meet in a task.

A null text is empty and holds the end id alone. Repeated rows are packed each. An empty table gives none. Columns of
the input other than ``key`` and ``text`` are not read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiometra.session import stage

#: Ids in an Arrow batch that leaves a task.
BATCH_IDS = 1 << 20
#: Whole windows of one task have numbers below this.
TASK_WINDOWS = 1 << 36


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """Rows ``i, a, j, b`` with ``i * a + j * b == window``, ``a < b`` and ``i + j <= depth`` (or ``j == b == 0``)."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found = [np.zeros((0, 4), np.int64)]
    for i in range(1, depth + 1):
        if window % i == 0 and present[window // i]:
            found.append(np.array([[i, window // i, 0, 0]]))
        for j in range(1, depth + 1 - i):
            a = lengths[i * lengths < window]
            b, rest = np.divmod(window - i * a, j)
            fits = (rest == 0) & (a < b) & present[b]
            found.append(np.stack([np.full(fits.sum(), i), a[fits], np.full(fits.sum(), j), b[fits]], axis=1))
    return np.concatenate(found)


def solve_repeats(parts: np.ndarray, counts: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative repeats of the combinations whose lengths come nearest the counts in least squares."""
    if not len(parts):
        return np.zeros(0)
    times, length = parts[:, [0, 2]].astype(float), parts[:, [1, 3]]

    def used(repeats: np.ndarray) -> np.ndarray:
        return np.bincount(length.ravel(), (times * repeats[:, None]).ravel(), len(counts))

    def gathered(per_length: np.ndarray) -> np.ndarray:
        return (times * per_length[length]).sum(axis=1)

    steepest = np.ones(len(parts))
    for _ in range(30):  # the largest curvature, by power iteration
        steepest = gathered(used(steepest))
        curvature = np.linalg.norm(steepest)
        steepest /= curvature
    repeats = ahead = np.zeros(len(parts))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - gathered(used(ahead) - counts) / curvature)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / grown * (new - repeats)
        repeats, momentum = new, grown
    return repeats


@dataclass(frozen=True)
class Plan:
    """Where the tail of a length and rank goes.

    In combinations run ``i`` starts at ``first[i]`` on the line of (length, rank) and fills a window after another.
    ``fitted`` is how many tails of each length they take; the others lie end to end from ``line_start`` of their
    length, over whole windows and then over ``last`` windows of powers of two.
    """

    window: int
    base: np.ndarray
    fitted: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    line_start: np.ndarray
    line_sequence: int
    last: tuple[tuple[int, int, int], ...]
    sequences: int

    def fragments(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of the pieces of one tail."""
        if rank < self.fitted[length]:
            at = int(self.base[length]) + rank
            run = int(np.searchsorted(self.first, at, "right")) - 1
            return [(0, length, int(self.sequence[run]) + at - int(self.first[run]), int(self.offset[run]))]
        start = int(self.line_start[length]) + (rank - int(self.fitted[length])) * length
        found, at, end = [], start, start + length
        whole = self.last[0][0] if self.last else end
        while at < end:
            if at < whole:
                number = at // self.window
                low, high, sequence = number * self.window, (number + 1) * self.window, self.line_sequence + number
            else:
                low, high, sequence = next(w for w in self.last if w[0] <= at < w[1])
            stop = min(high, end)
            found.append((at - start, stop - at, sequence, at - low))
            at = stop
        return found


def plan(histogram: Mapping[int, int], window: int, depth: int = 12, fits: int = 2) -> Plan:
    """Combinations with repeats for a histogram of tails shorter than the window, and the line of the rest."""
    counts = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left, fitted, runs, sequence = counts.copy(), np.zeros(window + 1, np.int64), [], 0
    for _ in range(fits):
        parts = combinations(np.flatnonzero(left), window, depth)
        repeats = solve_repeats(parts, left.astype(float))
        before = sequence
        for k in np.argsort(-repeats, kind="stable"):
            wanted = int(np.rint(repeats[k])) or int(repeats[k] > 0.05)  # rare lengths have shares of a window
            if not wanted:
                break
            i, a, j, b = parts[k].tolist()
            most = min(wanted, int(left[a]) // i, *([int(left[b]) // j] if j else []))
            offset = 0
            for length in [a] * i + [b] * j if most else []:
                runs.append((base[length] + fitted[length], sequence, offset))
                fitted[length] += most
                left[length] -= most
                offset += length
            sequence += most
        if sequence == before:
            break
    sizes = left * np.arange(window + 1)
    line_start = sizes.sum() - np.cumsum(sizes)  # longest first
    whole, rest = divmod(int(sizes.sum()), window)
    last, at, number = [], whole * window, sequence + whole
    while rest:
        size = 1 << rest.bit_length() - 1
        last.append((at, at + size, number))
        at, number, rest = at + size, number + 1, rest - size
    first, start, offset = np.array(sorted(runs), np.int64).reshape(-1, 3).T
    return Plan(window, base, fitted, first, start, offset, line_start, sequence, tuple(last), number)


_COLUMNS = "doc_tokens bigint, start bigint, length bigint, ids binary"


def cut_windows(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], window: int, end_id: int,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole windows and tails of all documents: ``key, doc_tokens, start, length, ids, task, place``.

    ``place`` counts pieces of the same length within a task. ``encoder`` is called in the task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows, held = ([], [], [], [], [], []), 0
            for i, whole in enumerate(batch.column(1)):
                ids = np.append(encode(whole.as_py() or ""), end_id).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    for column, value in zip(rows, (i, len(ids), start, len(piece), piece.tobytes(), seen[len(piece)])):
                        column.append(value)
                    seen[len(piece)] += 1
                    held += len(piece)
                    if held > BATCH_IDS:
                        yield made(batch.column(0), rows, task)
                        rows, held = ([], [], [], [], [], []), 0
            if rows[0]:
                yield made(batch.column(0), rows, task)

    def made(keys: pa.Array, rows: tuple, task: int) -> pa.RecordBatch:
        at, total, start, length, ids, place = rows
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in (total, start, length)],
             pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int64()), pa.array(place, pa.int64())],
            names=["key", "doc_tokens", "start", "length", "ids", "task", "place"])

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(cut, f"key {kind}, {_COLUMNS}, task bigint, place bigint")


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], window: int, end_id: int,
         key: str = "doc_id", text: str = "text", depth: int = 12) -> DataFrame:
    """``key, doc_tokens, start, length, ids, sequence_id, offset`` of every piece; ids are little-endian unsigned 32-bit.

    Sequences of whole windows have numbers below zero. Rerun tasks give the same pieces, since cut documents are stored.
    """
    cut = stage(cut_windows(docs, encoder, window, end_id, key, text), "windows")
    tails = cut.where(F.col("length") < window)
    cells = tails.groupBy("length", "task").agg(F.count("*").alias("n"))
    counted = cells.groupBy("length").agg(F.sum("n").alias("n")).collect()
    shared = cut.sparkSession.sparkContext.broadcast(plan({r["length"]: r.n for r in counted}, window, depth))
    kind = cut.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fragments = shared.value.fragments
            rows = ([], [], [], [], [], [])
            for i, (length, rank, start, ids) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("length", "rank", "start", "ids")])):
                for inside, size, sequence, offset in fragments(length, rank):
                    for column, value in zip(rows, (i, start + inside, size, ids[4 * inside:4 * (inside + size)], sequence, offset)):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            start, length, sequence, offset = (pa.array(rows[c], pa.int64()) for c in (1, 2, 4, 5))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("doc_tokens").take(at), start, length,
                 pa.array(rows[3], pa.binary()), sequence, offset],
                names=["key", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = tails.join(offsets, ["length", "task"]).select(
        "key", "doc_tokens", "start", "length", "ids", (F.col("before") + F.col("place")).alias("rank"))
    placed = ranked.mapInArrow(place, f"key {kind}, {_COLUMNS}, sequence_id bigint, offset bigint")
    whole = cut.where(F.col("length") == window).select(
        "key", "doc_tokens", "start", "length", "ids",
        (F.lit(-1) - F.col("task") * TASK_WINDOWS - F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(whole).withColumnRenamed("key", key)
