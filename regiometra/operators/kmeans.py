"""Many K-Means models fitted together: each round is one scan of the points for all of them.

All (k, restart) models are rows of one table of centres. A round sends the centres to the tasks and gets back, per
centre, the weight, the sum and the cost of its points; models that have come to rest drop out. Seeding is k-means++
with trials: a point is drawn with a chance in proportion to its weight times its squared distance to the nearest
centre so far, as the first of exponential arrivals of that rate, so that draws need no running totals; of several
draws the one that lowers the cost most stays. What the driver holds is one row per centre (for few blocks, per block
and centre), whatever the table's size.

Points lie in blocks by a hash of their values; partial sums are added in order of blocks, or as decimals, which are
exact in any order: a fit does not depend on the layout or the machine. Features should be standardised (sums below 1e20).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.session import stage

_BLOCKS = 8
_POINTS_PER_BLOCK = 20_000
_POINTS_AT_ONCE = 2_048
_DIRECT_BLOCKS = 64
#: Bound on the summed squared shift of a model's centres, in units of the feature variance.
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Centers:
    """Centres of one model in ascending order, so that numbers repeat, and the cost of all points."""

    points: tuple[tuple[float, ...], ...]
    cost: float

    def distances(self, columns: Sequence[str]) -> str:
        """SQL array of squared distances of a row to each centre."""
        terms = [" + ".join(f"(`{c}` - ({x!r}D)) * (`{c}` - ({x!r}D))" for c, x in zip(columns, point)) for point in self.points]
        return f"array({', '.join(terms)})"

    def assign(self, columns: Sequence[str]) -> Column:
        """1-based number of the nearest centre, the smaller one on ties; null where a value is."""
        distances = F.expr(self.distances(columns))
        return F.array_position(distances, F.array_min(distances)).cast("int")


@dataclass(frozen=True)
class Blocks:
    """Weighted points as one row per block, kept in memory for the scans."""

    rows: DataFrame
    dims: int
    count: int

    def totals(self, parts: DataFrame, keys: list[str], values: list[str]) -> pd.DataFrame:
        """Sums of the blocks' parts per key. Parts of few blocks are added on the driver, in order, which saves a shuffle."""
        if self.count > _DIRECT_BLOCKS:
            return parts.groupBy(*keys).agg(*[_exact_sum(c) for c in values]).toPandas()
        return parts.toArrow().to_pandas().groupby(keys, as_index=False)[values].sum()

    def scan(self, work: Callable[[int, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """``work`` (block number, points, weights) on every block."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, points, weights in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield pa.RecordBatch.from_pydict(work(block, np.frombuffer(points).reshape(-1, dims), np.frombuffer(weights)))

        return self.rows.mapInArrow(run, schema)


@contextmanager
def point_blocks(points: DataFrame, columns: Sequence[str], weight: str = "weight") -> Iterator[Blocks]:
    """``points`` dealt to blocks by a hash of their values, staged and cached. Rows with a null or NaN take no part."""
    dims = len(columns)
    kept = points.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                         F.col(f"`{weight}`").cast("double").alias("w"))
    kept = stage(kept.where(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(dims))), "points")
    count = max(_BLOCKS, -(-kept.count() // _POINTS_PER_BLOCK))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64(*[f"x{i}" for i in range(dims)]), F.lit(count)).cast("int"))

    def gather(group):
        group = group.sort_values([*(f"x{i}" for i in range(dims)), "w"])
        values = np.ascontiguousarray(group[[f"x{i}" for i in range(dims)]].to_numpy(float))
        return pd.DataFrame({"block": group["block"].iloc[:1], "points": [values.tobytes()], "weights": [group["w"].to_numpy(float).tobytes()]})

    gathered = stage(dealt.groupBy("block").applyInPandas(gather, "block int, points binary, weights binary"), "point-blocks")
    rows = gathered.repartitionByRange(count, "block").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Blocks(rows, dims, count)
    finally:
        rows.unpersist()


@dataclass
class _Fit:
    """One model while it is fitted."""

    k: int
    seed: int
    centers: np.ndarray


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, dimension by dimension: no cancellation."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - centers[None, :, j]
        out += gap * gap
    return out


def _parts(x: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(x), _POINTS_AT_ONCE):
        yield x[at:at + _POINTS_AT_ONCE], w[at:at + _POINTS_AT_ONCE]


def _exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,18)")).cast("double").alias(column)


def _add_centers(blocks: Blocks, fits: list[_Fit], trials: list[int], step: int) -> None:
    """One k-means++ step for all ``fits``: the best of several draws becomes the next centre of each."""
    dims = blocks.dims
    seeds, held = [(f.seed, f.k) for f in fits], [f.centers for f in fits]

    def draw(block: int, x: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        fit, trial, arrival, place = [], [], [], []
        for i, (seed, centers) in enumerate(zip(seeds, held)):
            rng = np.random.default_rng([*seeds[i], block, step])
            rate = w * (_squares(x, centers).min(axis=1) if len(centers) else 1.0)
            with np.errstate(divide="ignore"):
                times = rng.exponential(size=(trials[i], len(x))) / rate
            first = times.argmin(axis=1)
            fit += [i] * trials[i]
            trial += range(trials[i])
            arrival += times[np.arange(trials[i]), first].tolist()
            place += first.tolist()
        out = {"fit": np.array(fit, np.int32), "trial": np.array(trial, np.int32), "arrival": np.array(arrival)}
        return out | {f"x{j}": x[place, j] for j in range(dims)}

    coordinates = [f"x{j}" for j in range(dims)]
    schema = "fit int, trial int, arrival double, " + ", ".join(f"{c} double" for c in coordinates)
    drawn = blocks.scan(draw, schema)
    if blocks.count > _DIRECT_BLOCKS:
        drawn = drawn.groupBy("fit", "trial").agg(F.min(F.struct("arrival", *coordinates)).alias("d")).select("fit", "trial", "d.*")
    first = drawn.toArrow().to_pandas().sort_values(["fit", "trial", "arrival", *coordinates]).drop_duplicates(["fit", "trial"])
    tried = {i: group[coordinates].to_numpy() for i, group in first.groupby("fit")}
    if step == 0:
        for i, fit in enumerate(fits):
            fit.centers = tried[i][:1]
        return
    candidates = [tried[i] for i in range(len(fits))]

    def cost(block: int, x: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        fit, trial, total = [], [], []
        for i, centers in enumerate(held):
            sums = sum(wp @ np.minimum(_squares(xp, candidates[i]), _squares(xp, centers).min(axis=1)[:, None]) for xp, wp in _parts(x, w))
            fit += [i] * len(sums)
            trial += range(len(sums))
            total += sums.tolist()
        return {"fit": np.array(fit, np.int32), "trial": np.array(trial, np.int32), "total": np.array(total, float)}

    costs = blocks.totals(blocks.scan(cost, "fit int, trial int, total double"), ["fit", "trial"], ["total"])
    best = costs.sort_values(["fit", "total", "trial"]).drop_duplicates("fit").set_index("fit")["trial"]
    for i, fit in enumerate(fits):
        fit.centers = np.vstack([fit.centers, candidates[i][best[i]]])


def _seed(blocks: Blocks, fits: list[_Fit]) -> None:
    for step in range(max(f.k for f in fits)):
        left = [f for f in fits if f.k > step]
        _add_centers(blocks, left, [2 + int(math.log(f.k)) if step else 1 for f in left], step)


def _sums(blocks: Blocks, fits: list[_Fit]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(weight per centre, sum per centre, cost) of each model, with every point at its nearest centre."""
    dims, ks = blocks.dims, [f.k for f in fits]
    first = np.concatenate([[0], np.cumsum(ks)])
    table = np.concatenate([f.centers for f in fits])
    by_k = {k: np.flatnonzero(np.array(ks) == k) for k in sorted(set(ks))}

    def add(block: int, x: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        out = np.zeros((2 + dims, len(table)))
        for xp, wp in _parts(x, w):
            for k, which in by_k.items():
                slots = first[which][:, None] + np.arange(k)
                gaps = _squares(xp, table[slots.ravel()]).reshape(len(xp), len(which), k)
                nearest = gaps.argmin(axis=2)
                least = np.take_along_axis(gaps, nearest[:, :, None], 2)[:, :, 0]
                at = (first[which] + nearest).ravel()
                for row, values in enumerate([np.ones_like(least), least, *[np.repeat(xp[:, j, None], len(which), 1) for j in range(dims)]]):
                    out[row] += np.bincount(at, (values * wp[:, None]).ravel(), len(table))
        used = np.flatnonzero(out[0] > 0)
        return {"slot": used.astype(np.int32), "w": out[0, used], "cost": out[1, used]} | {f"x{j}": out[2 + j, used] for j in range(dims)}

    columns = ["w", "cost", *[f"x{j}" for j in range(dims)]]
    rows = blocks.totals(blocks.scan(add, "slot int, " + ", ".join(f"{c} double" for c in columns)), ["slot"], columns)
    sums = np.zeros((len(table), len(columns)))
    sums[rows["slot"].to_numpy()] = rows[columns].to_numpy()
    return [(sums[a:b, 0], sums[a:b, 2:], math.fsum(sums[a:b, 1])) for a, b in zip(first, first[1:])]


def _settle(blocks: Blocks, fits: list[_Fit], rounds: int, tolerance: float) -> None:
    """Lloyd rounds; a centre without points stays where it is."""
    left = fits
    for _ in range(rounds):
        if not left:
            break
        moving = []
        for fit, (weight, total, _) in zip(left, _sums(blocks, left)):
            moved = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], fit.centers)
            if np.square(moved - fit.centers).sum() > tolerance:
                moving.append(fit)
            fit.centers = moved
        left = moving


def fit_all(blocks: Blocks, ks: Sequence[int], restarts: int = 20, max_iter: int = 500, seed: int = 42) -> dict[int, Centers]:
    """The cheapest of ``restarts`` models for every k; ties go to the smaller seed.

    All are fitted to the tolerance, and the cheapest of each k then until its centres are the means of their points.
    Without points every centre is zero.
    """
    if blocks.rows.isEmpty():
        return {k: Centers(tuple((0.0,) * blocks.dims for _ in range(k)), 0.0) for k in ks}
    fits = [_Fit(k, seed + i, np.zeros((0, blocks.dims))) for k in ks for i in range(restarts)]
    _seed(blocks, fits)
    _settle(blocks, fits, max_iter, TOLERANCE)
    best: dict[int, tuple[float, int, _Fit]] = {}
    for fit, (_, _, cost) in zip(fits, _sums(blocks, fits)):
        if fit.k not in best or (cost, fit.seed) < best[fit.k][:2]:
            best[fit.k] = (cost, fit.seed, fit)
    winners = [fit for _, _, fit in best.values()]
    _settle(blocks, winners, max_iter, 0.0)
    return {fit.k: Centers(tuple(sorted(tuple(map(float, c)) for c in fit.centers)), cost)
            for fit, (_, _, cost) in zip(winners, _sums(blocks, winners))}
