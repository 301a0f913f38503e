"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is taken as whole passes over its documents plus a remaining budget below one pass. For the
budget, documents are counted by exact length, a proportional share of every length is taken, rounded by seeded
points so that rare lengths get theirs too, and a bounded-knapsack dynamic programme over the leftover counts fits
the last words. It yields a count per length; seeded hash ranks then choose that many documents of each length.

Null sources are one source, last in order. Documents of size 0 are in every pass and never in a budget. A source
of size 0 has target 0. Equal documents are chosen independently. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.llm.ranks import gapless_rank

#: Words left to the dynamic programme; its bit sets have as many bits.
FITTED_WORDS = 16_384


def fill(sizes: Mapping, weights: Mapping, share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by weight that sum to ``share`` of all sizes, none above ``most`` times its source's size."""
    targets, open_ = {}, list(sizes)
    rest = share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        shares = {s: rest * weights[s] / total for s in open_}
        over = [s for s in open_ if shares[s] > most * sizes[s]]
        if not over:
            return targets | shares
        for s in over:
            targets[s] = float(most * sizes[s])
            rest -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


def _in_proportion(sizes: np.ndarray, counts: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """How many documents of each length to take for a sum just below the budget, the same share of every length.

    Lengths are walked from the longest down, each with its share of what is still missing. Shares add up along the
    walk, and one seeded point in every unit of their sum takes a document, so rare lengths get their turn.
    """
    taken = np.zeros_like(counts)
    left, missing = int((sizes * counts).sum()), budget
    total, passed, point = 0.0, 0, rng.random()
    for i in np.argsort(-sizes, kind="stable"):
        size, count = int(sizes[i]), int(counts[i])
        if missing <= 0 or size <= 0:
            break
        before, total = int(total), total + count * min(1.0, missing / left)
        left -= size * count
        if int(total) > before:
            point = rng.random()
        points = int(total) + (total - int(total) >= point)
        least = -((left - missing) // size)  # what the shorter ones cannot make up for
        most = min(count, missing // size)
        taken[i] = min(most, max(least, points - passed, 0))
        passed += int(taken[i])
        missing -= int(taken[i]) * size
    return taken


def _completed(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, rest: int, rng: np.random.Generator) -> np.ndarray:
    """``taken`` and, by bounded knapsack, of the other documents those that bring it nearest to ``rest`` words more."""
    taken = taken.copy()
    limit = 2 * rest  # a sum beyond is farther from the budget than none
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in rng.permutation(len(sizes)):
        left = min(int(counts[i] - taken[i]), limit // int(sizes[i])) if sizes[i] > 0 else 0
        piece = 1
        while left and not reach >> rest & 1:
            piece = min(piece, left)
            wider = reach | (reach << (piece * int(sizes[i]))) & mask
            if wider != reach:
                steps.append((i, piece, reach))
            reach = wider
            left -= piece
            piece *= 2
    at, over = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1, reach >> (rest + 1)
    if over and (over & -over).bit_length() < rest - at:
        at = rest + (over & -over).bit_length()
    for i, piece, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += piece
            at -= piece * int(sizes[i])
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, fitted: int = FITTED_WORDS, seed: int = 17) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as near the budget as can be.

    On ties the smaller sum is taken. All but the last words are taken in proportion, the same share of every length;
    the rest is exact subset sum, over few words first and, where those do not meet the budget, over up to about ``fitted``.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    whole = int((sizes * counts).sum())
    budget = max(0, min(int(budget), whole))
    if budget == whole:
        return np.where(sizes > 0, counts, 0)
    best, nearest = np.zeros_like(counts), (budget, 0)
    for last in sorted({fitted >> 8, fitted >> 4, fitted}):
        rng = np.random.default_rng(seed)
        taken = _in_proportion(sizes, counts, budget - last, rng)
        taken = _completed(sizes, counts, taken, budget - int((sizes * taken).sum()), rng)
        total = int((sizes * taken).sum())
        if (abs(total - budget), total) < nearest:
            best, nearest = taken, (abs(total - budget), total)
        if total == budget:
            break
    return best


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), size: str = "size", source: str = "source",
        key: tuple[str, ...] = ("doc_id",), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies``, how often the mix takes each document.

    Sources in order of code points, null last, take the weights in turn. One row per source goes to the driver,
    as the weights are a list over sources; documents and length counts stay on Spark. A task sees the length
    counts of one source. ``docs`` is read several times and should be stored. Reruns agree.
    """
    spark = docs.sparkSession
    named = docs.withColumn("__s", F.when(F.col(f"`{source}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{source}`"))))
    named = named.withColumn("__l", F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint"))
    lengths = named.groupBy("__s", "__l").agg(F.count("*").alias("__c"))
    totals = {r[0]: int(r[1] or 0) for r in lengths.groupBy("__s").agg(F.sum(F.col("__l") * F.col("__c"))).collect()}
    ordered = sorted(totals, key=lambda s: (s == "n", s))
    targets = fill(totals, {s: weights[i % len(weights)] for i, s in enumerate(ordered)}, share, most)
    plan = [(s, totals[s], float(targets[s]), min(int(targets[s] // totals[s]), int(most)) if totals[s] else 0) for s in ordered]
    plans = spark.createDataFrame(plan, "__s string, source_size bigint, target double, __passes int")
    budgets = {s: round(t) - p * n for s, n, t, p in plan}

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__l", kind="stable")
        counts = fit_counts(group["__l"].to_numpy(), group["__c"].to_numpy(), budgets[group["__s"].iloc[0]], seed=seed)
        return group[["__s", "__l"]].assign(__take=counts)

    chosen = lengths.groupBy("__s").applyInPandas(fitted, "__s string, __l bigint, __take bigint")
    chosen = chosen.join(F.broadcast(plans), "__s")  # one row per source, made on the driver
    ranked = gapless_rank(named, ["__s", "__l"], list(key), "__rank", chosen, seed)
    copies = F.col("__passes") + (F.col("__rank") < F.col("__take")).cast("int")
    return ranked.withColumn("copies", copies).drop("__s", "__l", "__take", "__passes", "__rank")
