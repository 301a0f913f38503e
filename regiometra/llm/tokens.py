"""Token ids of texts by a byte-level BPE vocabulary file, which is given by its path and never copied."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.llm.memory import batches_giving_back

# Fixed values of the byte-level BPE format: how texts are cut before merging, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OWN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = {b for span in OWN_BYTES for b in span}
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@functools.lru_cache(maxsize=2)
def coding(path: str):
    """The merges of a byte-level vocabulary file in tiktoken: several times as fast, with the same ids as the
    tokenizers library gives; the tests compare the two."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = byte_characters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text, as the tokenizers library gives them for this file without adding special tokens."""
    return functools.partial(coding(path).encode, allowed_special="all", disallowed_special=())


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per piece: ``key``, ``piece`` from 0, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit).

    A document is the ids of its whole text (null: empty) and ``end_id``. One longer than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter. The input is read row by row in Arrow batches.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys, rows, held = batch.column(0), ([], [], [], [], []), 0
            for i, whole in enumerate(batch.column(1)):
                ids = np.array([*encode(whole.as_py() or ""), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(rows, (i, piece, a, b - a, ids[a:b].tobytes())):
                        column.append(value)
                held += len(ids)
                if held > 1 << 20:
                    yield made(keys, rows)
                    rows, held = ([], [], [], [], []), 0
            if rows[0]:
                yield made(keys, rows)

    def made(keys: pa.Array, rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
             pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())],
            names=["key", "piece", "start", "length", "ids"])

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    pieces = narrow.mapInArrow(batches_giving_back(cut), f"key {kind}, piece int, start bigint, length bigint, ids binary")
    return pieces.withColumnRenamed("key", key)
