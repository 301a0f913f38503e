"""Packing pieces into sequences by patterns fitted with non-negative least squares.

Pieces are counted by length. Patterns of one to three lengths that fill a sequence exactly are enumerated, repeat
counts are fitted to the histogram by non-negative least squares, rounded, and bounded by the counts that are left.
What remains is packed best fit, longest first, count by count. All of that sees at most ``capacity`` counts,
whatever the size of the data. Ranks of equal lengths then give each piece its sequence and place.

Pieces have a length from 1 to ``capacity``. Equal pieces take different places. An empty table gives none.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.llm.ranks import gapless_rank


@dataclass(frozen=True)
class Plan:
    """Places in order of (length, rank): run ``i`` starts at ``first[i]`` and fills one sequence after another."""

    base: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        run = np.searchsorted(self.first, at, "right") - 1
        return self.sequence[run] + at - self.first[run], self.offset[run]


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Ascending triples of present lengths (0 pads) that sum to the capacity."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    usable = np.flatnonzero(present)
    found = [np.array([[0, 0, capacity]])] if present[capacity] else []
    present[0] = True
    for a in [0, *usable]:
        b = usable[(usable >= max(a, 1)) & (2 * usable <= capacity - a)]
        c = capacity - a - b
        b, c = b[present[c]], c[present[c]]
        found.append(np.stack([np.full_like(b, a), b, c], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeats whose lengths come near the counts in least squares, by multiplicative updates."""
    def gather(per_length: np.ndarray) -> np.ndarray:
        return np.where(patterns > 0, per_length[patterns], 0).sum(axis=1)

    wanted = gather(counts.astype(float))
    repeats = wanted / max(1.0, float(len(patterns)))
    for _ in range(rounds):
        used = np.bincount(patterns.ravel(), np.repeat(repeats, 3), len(counts))
        repeats = repeats * wanted / np.maximum(gather(used), 1e-12)
    return repeats


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: patterns with their repeats."""
    done: list[tuple[tuple[int, ...], int]] = []
    spaces: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(parts: tuple[int, ...], repeats: int) -> None:
        space = capacity - sum(parts)
        if not repeats:
            return
        if not space:
            done.append((parts, repeats))
            return
        if space not in open_:
            bisect.insort(spaces, space)
        open_.setdefault(space, []).append((parts, repeats))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                parts, repeats = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                space, parts, repeats = capacity, (), left
            fits = space // length
            full = min(repeats, left // fits)
            put(parts + (length,) * fits, full)
            left -= full * fits
            repeats -= full
            if repeats and left:  # fewer than fits are left
                put(parts + (length,) * left, 1)
                left, repeats = 0, repeats - 1
            if parts:
                put(parts, repeats)
    return done + [item for items in open_.values() for item in items]


def plan(histogram: Mapping[int, int], capacity: int) -> Plan:
    """Patterns with repeats for a histogram of lengths, laid out as runs."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    patterns = exact_patterns(np.flatnonzero(counts), capacity)
    repeats = np.rint(fit_repeats(patterns, counts)).astype(np.int64)
    left, chosen = counts.copy(), []
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        parts = tuple(int(x) for x in patterns[i] if x)
        most = min([int(repeats[i]), *(int(left[x]) // parts.count(x) for x in parts)])
        if most:
            chosen.append((parts, most))
            for x in parts:
                left[x] -= most
    chosen += best_fit(left, capacity)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    used, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for parts, n in chosen:
        offset = 0
        for x in parts:
            runs.append((base[x] + used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    assert (used == counts).all()
    first, start, offset = np.array(sorted(runs), np.int64).reshape(-1, 3).T
    return Plan(base, first, start, offset, sequence)


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; other columns, such as the ids themselves, ride along.

    ``pieces`` is read several times and should be stored. At most ``capacity`` counts go to the driver.
    """
    counted = pieces.groupBy(F.col(f"`{length}`").alias("l")).agg(F.count("*").alias("n")).collect()
    shared = pieces.sparkSession.sparkContext.broadcast(plan({r.l: r.n for r in counted}, capacity))  # O(capacity^2) at most

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.places(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = gapless_rank(pieces, [length], list(order), "__rank")
    placed = ranked.withColumn("__place", place(F.col(f"`{length}`"), "__rank"))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], "__place.sequence_id", "__place.offset")
