"""Alignment of two tokenizations of the same texts, with corpus-wide counts of linked ids.

Both tokenizations of a document cover the same bytes. Their cumulative ends are held in hash sets; the sorted common
ends slice both id lists into groups. Inside a slice every pair of tokens whose byte ranges
overlap is a link: no end is common there, so each part between neighbouring ends of either side is one link.

The documents of a task are cut into blocks of bounded bytes. A block sends its different id pairs once, with the
number of its documents that hold each; these are summed over blocks, and the sums return to the blocks, where each
document adds up its links. So a pair that every document holds costs one row per block, and a document is tokenized
and aligned once. Blocks are stored, so a lost task is read again and not numbered anew.

A text that is null, empty, or whose bytes differ from what either tokenization spells, has no tokens. Every row is a
document, repeated rows too. An empty table gives none. Columns other than ``key`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiometra.session import stage

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes that a document counts for besides its text.
DOCUMENT_BYTES = 64


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of a text, and the bytes that each id stands for."""

    encode: Callable[[str], np.ndarray]
    pieces: list[bytes]

    def sizes(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces], np.int64)


class Spelling:
    """The bytes of the ids of one tokenizer, one after another, to spell many ids at once."""

    def __init__(self, side: Side):
        self.sizes = side.sizes()
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(side.pieces), np.uint8)

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if len(data) != (ends[-1] if len(ids) else 0):
            return False
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(len(data))
        return self.data[at].tobytes() == data


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side end at or before each common end."""
    both = set(ends_a.tolist()).intersection(ends_b.tolist())
    common = np.sort(np.fromiter(both, np.int64, len(both)))
    return np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of both tokens of every link, in order of their bytes."""
    is_end = np.zeros(max((int(e[-1]) for e in (ends_a, ends_b) if len(e)), default=0) + 1, bool)
    is_end[ends_a] = is_end[ends_b] = True
    ends = np.flatnonzero(is_end)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Notation:
    """``a1,a2|b1;a3|b2,b3`` of the groups of a document, in decimal ids."""

    def __init__(self, size_a: int, size_b: int):
        kinds = [(size_a, b","), (size_a, b"|"), (size_b, b","), (size_b, b";")]
        self.table = np.array([b"%d%s" % (i, mark) for size, mark in kinds for i in range(size)], object)
        self.first = np.cumsum([0] + [size for size, _ in kinds])

    def write(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.concatenate([[0], cut_b])[group_a]] = self.first[last_a] + a
        row[np.arange(len(b)) + cut_a[group_b]] = self.first[2 + last_b] + b
        return b"".join(self.table[row].tolist())[:-1]


def align(docs: DataFrame, sides: Callable[[], tuple[Side, Side]], key: str = "doc_id", text: str = "text",
          groups: bool = False) -> DataFrame:
    """One row per document: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair of ids counts the documents that hold it linked. ``n_best`` are the links whose count is the highest of
    their first id, ties included; ``count_sum`` adds the counts of all links. With ``groups`` the id lists and the
    sizes of their groups (``a_ids, b_ids, a_sizes, b_sizes``) come along. ``sides`` is called in the task.
    """
    lists = ("a_ids", "b_ids", "a_sizes", "b_sizes") if groups else ()
    kind = docs.schema[key].dataType.simpleString()
    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    tail = "groups_sha256 string" + "".join(f", {c} array<int>" for c in lists)

    def tokens_of(whole: str | None, a_side: Side, b_side: Side, spelling: tuple[Spelling, Spelling]) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not whole:
            return none, none
        data = b" " + whole.encode()
        a, b = a_side.encode(" " + whole), b_side.encode(whole)
        same = all(side.spells(ids, data) for side, ids in zip(spelling, (a, b)))
        return (a.astype(np.int64), b.astype(np.int64)) if same else (none, none)

    def align_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = sides()
        spelling = Spelling(a_side), Spelling(b_side)
        size_a, size_b = (s.sizes for s in spelling)
        notation, task, number = Notation(len(size_a), len(size_b)), TaskContext.get().partitionId(), 0
        keys, rows, codes, held = [], [], [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal number, keys, rows, codes, held
            pairs, place = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
            documents = np.bincount(place, minlength=len(pairs))
            ends = np.cumsum([len(c) for c, _ in codes])
            local = [p.astype("<u4").tobytes() for p in np.split(place, ends[:-1])]
            times = [n.astype("<u4").tobytes() for _, n in codes]
            block, empty = task << 32 | number, [None]
            columns = {
                "key": pa.chunked_array([*keys, pa.nulls(1, keys[0].type)]).combine_chunks(),
                "block": pa.array([block] * (len(rows) + 1), pa.int64()),
                "pairs": pa.array([None] * len(rows) + [pairs], pa.list_(pa.int64())),
                "documents": pa.array([None] * len(rows) + [documents], pa.list_(pa.int64())),
                "local": pa.array(local + empty, pa.binary()), "times": pa.array(times + empty, pa.binary())}
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * len(lists)
            names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *lists]
            for i, (name, one) in enumerate(zip(names, kinds)):
                columns[name] = pa.array([r[i] for r in rows] + empty, one)
            yield pa.RecordBatch.from_pydict(columns)
            number, keys, rows, codes, held = number + 1, [], [], [], 0

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1)):
                whole = value.as_py()
                a, b = tokens_of(whole, a_side, b_side, spelling)
                ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
                cut_a, cut_b = slices(ends_a, ends_b)
                at_a, at_b = links(ends_a, ends_b)
                codes.append(np.unique(a[at_a] << 32 | b[at_b], return_counts=True))
                digest = hashlib.sha256(notation.write(a, b, cut_a, cut_b)).hexdigest() if len(a) else ""
                row = [len(a), len(b), len(cut_a), len(at_a), digest]
                rows.append(row + [a, b, np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)] if groups else row)
                held += len(whole or "") + DOCUMENT_BYTES
                if held >= BLOCK_BYTES:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    start = i + 1
                    yield from finish()
            if start < batch.num_rows:
                keys.append(batch.column(0).slice(start))
        if rows:
            yield from finish()

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    aligned = stage(narrow.mapInArrow(
        align_blocks, f"key {kind}, block bigint, pairs array<bigint>, documents array<bigint>, local binary, times binary, "
                      f"{counts}, {tail}"), "alignment")
    sent = aligned.where("pairs IS NOT NULL").select(
        "block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "held"))
    sent = sent.select("block", "place", F.col("held.pairs").alias("pair"), F.col("held.documents").alias("documents"))
    first_id = F.shiftright("pair", 32)
    summed = sent.groupBy("pair").agg(F.sum("documents").alias("n"))  # a first id has at most as many pairs as the other vocabulary
    summed = summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(first_id)))
    back = (sent.select("block", "place", "pair").join(summed, "pair")
            .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("held"))
            .select(F.col("block").alias("home"), F.col("held.n").alias("n"), F.col("held.best").alias("best")))

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *lists]
        n = best = np.zeros(0, np.int64)
        if found.num_rows:
            n, best = (found.column(c)[0].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "best"))
        sums = ([], [])
        for local, times in zip(rows.column("local").to_pylist(), rows.column("times").to_pylist()):
            at, by = np.frombuffer(local, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            for total, values in zip(sums, (best, n)):
                total.append(int(values[at] @ by))
        made = rows.select(out)
        for name, total in zip(("n_best", "count_sum"), sums):
            made = made.append_column(name, pa.array(total, pa.int64()))
        return made.select(order)

    order = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *lists]
    done = (aligned.where("pairs IS NULL").groupBy("block").cogroup(back.groupBy("home"))
            .applyInArrow(add_up, f"key {kind}, {counts}, n_best bigint, count_sum bigint, {tail}"))
    return done.withColumnRenamed("key", key)
