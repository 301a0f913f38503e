"""Hard negatives by a cover tree over norm-augmented candidates.

Candidates are lifted by one coordinate to equal norm, so that a distance tells an inner product. A tree has a node per
centre and level; a node covers all its members within the radius of its level, and centres of a level under one node
lie further apart than that radius. For an anchor, a node's centre and its true covering radius bound the inner product
with every member from both sides. An anchor descends best bound first: a node wholly outside the wanted scores is
skipped, as is one whose upper bound falls below the last place already taken, or that holds no wanted label. Leaves
are verified in exact integers.

Candidates are dealt to trees of bounded rows by region (nearest of a bounded sample of pivots) and by hash within a
region, so near vectors share a tree and a hot region many trees. Of equal vectors of one label only the smallest ids that an
answer can need travel: no answer holds others. A task holds one block of anchors and walks a run of trees with it.
Two walks are made: the first finds positives, the second the negatives between both bounds of every positive.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Rows equal in id, label and
vector count once; the rows of an anchor's id are no partners of it. Partners have the anchor's dimension. Ties go to the
smaller id. Components become ``floor(scale * x)``; scores must stay below 2**53. An empty table, or one without anchors, gives none. Other columns are
not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiometra.session import stage

TREE_ROWS, LEAF_ROWS, BASE = 8_192, 256, 1.25
#: Rows of the sample that pivots come from, and the most pivots.
PIVOT_SAMPLE, PIVOTS = 8_192, 256
#: Anchors in a block, and trees in a run.
BLOCK_ROWS, RUN_TREES = 8_192, 32


@dataclass(frozen=True)
class Mine:
    """How many positives and negatives an anchor gets, and the bounds on ``100 * negative`` per ``positive``."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def build_tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS,
               base: float = BASE) -> dict[str, np.ndarray]:
    """Arrays of a cover tree. Node rows: start, end of members, first child, children, centre, radius, single label.

    Members stand in tree order, so a node's members are a range; ``centre`` is a place in that order.
    """
    points = vectors.astype(np.float64)
    squares = np.square(points).sum(axis=1)
    top = float(squares.max())
    lifted = np.column_stack([points, np.sqrt(np.maximum(top - squares, 0))])
    order = np.arange(len(ids))
    _, names = np.unique(labels, return_inverse=True)
    nodes: list[list[float]] = []

    def gaps(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (top - lifted[rows] @ lifted[centre]), 0))

    def add(start: int, end: int, centre: int) -> int:
        own = names[order[start:end]]
        # Rounding may shorten a distance by the root of the error in its square.
        radius = float(gaps(order[start:end], centre).max()) + 1e-6 * np.sqrt(top)
        nodes.append([start, end, -1, 0, centre, radius, own[0] if (own == own[0]).all() else -1])
        return len(nodes) - 1

    waiting = [(add(0, len(ids), 0), None)]
    while waiting:
        me, radius = waiting.pop()
        start, end, centre = int(nodes[me][0]), int(nodes[me][1]), int(nodes[me][4])
        members = order[start:end]
        if end - start <= leaf_rows:
            continue
        away = gaps(members, centre)
        radius = away.max() / base if radius is None else radius / base
        while away.max() <= radius:  # levels at which the node has itself as the only child
            if away.max() <= 1e-6 * np.sqrt(top):
                break
            radius /= base
        if away.max() <= 1e-6 * np.sqrt(top):
            continue
        nearest, least, centres = np.zeros(len(members), np.int64), away, [centre]
        few = max(2, 4 * len(members) // leaf_rows)
        while least.max() > radius and len(centres) <= few:  # the furthest member becomes a centre until the level covers all
            new = int(members[least.argmax()])
            away = gaps(members, new)
            closer = away < least
            nearest[closer], least = len(centres), np.where(closer, away, least)
            centres.append(new)
        if len(centres) > few:
            continue  # centres would have few members each, and one product verifies them all
        by_child = np.argsort(nearest, kind="stable")
        order[start:end] = members[by_child]
        cuts = start + np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centres)))])
        nodes[me][2], nodes[me][3] = len(nodes), len(centres)
        for child, (low, high) in zip(centres, zip(cuts, cuts[1:])):
            waiting.append((add(int(low), int(high), child), radius))
    table = np.array(nodes)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    table[:, 4] = place[table[:, 4].astype(int)]
    kinds = np.unique(labels)
    return {"nodes": table, "ids": ids[order], "labels": labels[order], "vectors": vectors[order], "top": np.array([top]),
            "kinds": kinds}


class Tree:
    """A tree ready to be walked; ``compared`` counts candidates whose score was taken."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.nodes, self.ids, self.labels, self.kinds = (arrays[n] for n in ("nodes", "ids", "labels", "kinds"))
        self.vectors = arrays["vectors"].astype(np.float64)
        self.norm = float(np.sqrt(arrays["top"][0]))
        self.start, self.end, self.child, self.children, centre = self.nodes[:, :5].T.astype(np.int64)
        self.centres = self.vectors[centre]
        # Half the chord over the norm is the sine of half the angle that a node spans.
        self.angle = 2 * np.arcsin(np.minimum(self.nodes[:, 5] / max(2 * self.norm, 1e-300), 1))
        single = self.nodes[:, 6].astype(np.int64)
        self.single, self.has_single = self.kinds[np.maximum(single, 0)], single >= 0
        self.compared = 0

    def bounds(self, query: np.ndarray, length: float, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that members of the nodes can have, a little wider for rounding."""
        whole = length * self.norm
        if not whole:
            zero = np.zeros(len(self.angle[nodes]))
            return zero, zero
        angle = np.arccos(np.clip(self.centres[nodes] @ query / whole, -1, 1))
        slack = 1e-6 * whole + 1
        return (whole * np.cos(np.minimum(angle + self.angle[nodes], np.pi)) - slack,
                whole * np.cos(np.maximum(angle - self.angle[nodes], 0)) + slack)

    def best(self, query: np.ndarray, own: int, label: int, same: bool, k: int, spans: list[tuple[int, int]],
             held: list[list[tuple[int, int]]]) -> None:
        """Merges into ``held[i]`` the k first (-score, id) of the label (or of other labels) with a score within ``spans[i]``."""
        length = float(np.sqrt(query @ query))
        least, most = np.array([[max(a, -h[-1][0]) if len(h) >= k else a, b] for (a, b), h in zip(spans, held)], float).T

        def wanted(low, high):
            """Whether scores between the bounds could enter any span's first k; ``least`` rises as these fill."""
            return ((high >= least) & (low <= most)).any(axis=-1)

        def push(first: int, count: int) -> None:
            part = slice(first, first + count)
            low, high = self.bounds(query, length, part)
            fits = ~self.has_single[part] | ((self.single[part] == label) == same)
            for i in np.flatnonzero(fits & wanted(low[:, None], high[:, None])).tolist():
                heappush(heap, (-high[i], first + i, low[i]))

        heap: list[tuple[float, int, float]] = []
        push(0, 1)
        while heap:
            high, node, low = heappop(heap)
            if not wanted(low, -high):
                continue
            if self.children[node]:
                push(int(self.child[node]), int(self.children[node]))
                continue
            part = slice(int(self.start[node]), int(self.end[node]))
            self.compared += part.stop - part.start
            fits = np.flatnonzero(((self.labels[part] == label) == same) & (self.ids[part] != own)) + part.start
            scores = (self.vectors[fits] @ query).astype(np.int64)  # exact: integers below 2**53
            for i in range(len(spans)):
                inside = np.flatnonzero((scores >= least[i]) & (scores <= most[i]))
                if not len(inside):
                    continue
                if len(inside) > k:  # all that tie with the k-th stay until ids decide
                    last = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= last]
                found = zip((-scores[inside]).tolist(), self.ids[fits[inside]].tolist())
                held[i] = sorted([*held[i], *found])[:k]
                if len(held[i]) >= k:
                    least[i] = max(least[i], -held[i][-1][0])


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def usable_rows(df: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """``id, label, v, dim`` with integer components of every row that takes part."""
    v = F.col(f"`{vector}`")
    kept = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return kept.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
                       F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"), F.size(v).alias("dim"))


def _pivots(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Up to ``count`` pivots per dimension, from a sample of at most ``PIVOT_SAMPLE`` rows."""
    sample = rows.orderBy(F.xxhash64(F.lit(5), "id", "v")).limit(PIVOT_SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.v)
    return {dim: np.unique(np.array(vs, np.float64), axis=0)[:: max(1, len(vs) // count)][:count] for dim, vs in by_dim.items()}


def index(df: DataFrame, mine: Mine = Mine(), key: str = "vec_id", label: str = "label", vector: str = "embedding",
          scale: int = 256, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One stored tree per (dim, tree); every usable row is in one of them, or stands behind smaller ids of its vector."""
    rows = usable_rows(df, key, label, vector, scale)
    # An anchor's own row may be one of them, so one more than an answer holds; Spark limits groups before it shuffles.
    first = Window.partitionBy("dim", "v", "label").orderBy("id")
    kept = stage(rows.distinct().withColumn("seen", F.row_number().over(first))
                 .where(F.col("seen") <= max(mine.positives, mine.negatives) + 1).drop("seen"), "candidates")
    spark, total = df.sparkSession, kept.count()
    pivots = spark.sparkContext.broadcast(_pivots(kept, min(PIVOTS, max(1, total // tree_rows))))

    @F.pandas_udf("int")
    def region(dim: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), np.int32)
        for d in dim.unique():
            rows = np.flatnonzero((dim == d).to_numpy())
            centres = pivots.value.get(d)
            if centres is not None and len(centres) > 1:
                points = np.stack(v.iloc[rows].to_numpy()).astype(np.float64)
                out[rows] = (np.square(centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        return pd.Series(out)

    dealt = stage(kept.withColumn("region", region("dim", "v")), "regions")
    sizes = dealt.groupBy("dim", "region").agg(F.count("*").alias("n"))  # at most PIVOTS rows a dimension
    before = Window.partitionBy("dim").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("trees", F.ceil(F.col("n") / F.lit(tree_rows)).cast("int"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("trees").over(before), F.lit(0)))
    # Broadcast: one row per dimension and pivot.
    joined = dealt.join(F.broadcast(sizes.drop("n")), ["dim", "region"]).withColumn(
        "tree", (F.col("base") + F.pmod(F.xxhash64(F.lit(7), "id", "v", "label"), F.col("trees"))).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        arrays = build_tree(group["id"].to_numpy(np.int64), group["label"].to_numpy(np.int64),
                            np.stack(group["v"].to_numpy()).astype(np.int64), leaf_rows)
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "tree": group["tree"].iloc[:1], "arrays": [_packed(arrays)]})

    trees = joined.select("dim", "tree", "id", "label", "v").groupBy("dim", "tree").applyInPandas(
        build, "dim int, tree int, arrays binary")
    return stage(trees, "cover-trees")


def _walk(trees: DataFrame, anchors: DataFrame, runs: int, k: int, same: bool) -> DataFrame:
    """``row, low, high, partner_id, score``: of every span of every anchor, the k first over all trees.

    ``anchors``: ``row, dim, block, id, label, v, spans``, spans being an array of (low, high). A tree goes once to every block.
    """
    left = trees.join(anchors.select("dim", "block").distinct(), "dim").withColumn("run", F.col("tree") % F.lit(runs))
    right = anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("dim", "block", "row", "id", "label", "v", "spans")],
                           F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("a_run"))

    def walk(group: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(group) and len(anchors):
            vectors = np.stack(anchors["a_v"].to_numpy()).astype(np.float64)
            own, labels = anchors["a_id"].tolist(), anchors["a_label"].tolist()
            wanted = [[(s["low"], s["high"]) for s in spans] for spans in anchors["a_spans"]]
            held: list[list[list[tuple[int, int]]]] = [[[] for _ in spans] for spans in wanted]
            for arrays in group.sort_values("tree")["arrays"]:
                tree = Tree(_unpacked(arrays))
                for i in range(len(own)):
                    tree.best(vectors[i], own[i], labels[i], same, k, wanted[i], held[i])
            rows = [(row, low, high, partner, -score) for row, spans, lists in zip(anchors["a_row"].tolist(), wanted, held)
                    for (low, high), found in zip(spans, lists) for score, partner in found]
        return pd.DataFrame(rows, columns=["row", "low", "high", "partner_id", "score"])

    found = left.groupBy("dim", "block", "run").cogroup(right.groupBy("a_dim", "a_block", "a_run")).applyInPandas(
        walk, "row bigint, low bigint, high bigint, partner_id bigint, score bigint")
    place = Window.partitionBy("row", "low", "high").orderBy(F.desc("score"), "partner_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine_negatives(trees: DataFrame, anchors: DataFrame, mine: Mine = Mine(), key: str = "vec_id", label: str = "label",
                   vector: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS,
                   run_trees: int = RUN_TREES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, for every row of ``anchors``.

    Positives are the first other rows of the label; each gets the first rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of its own.
    """
    rows = usable_rows(anchors, key, label, vector, scale).distinct()
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "anchors")
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(blocks)).cast("int"))
    runs = max(1, -(-trees.count() // run_trees))
    whole = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    near = _walk(trees, rows.withColumn("spans", whole), runs, mine.positives, same=True)
    floor = f"(({mine.high} * score) - pmod({mine.high} * score, 100)) div 100"
    ceiling = f"(({mine.low} * score) + pmod(-{mine.low} * score, 100)) div 100"
    positives = stage(near.select("row", F.col("partner_id").alias("positive_id"), F.col("score").alias("positive_score"),
                                  F.expr(ceiling).alias("low"), F.expr(floor).alias("high")).where("low <= high"), "positives")
    spans = positives.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    found = _walk(trees, rows.join(spans, "row"), runs, mine.negatives, same=False)
    return (positives.join(found.withColumnsRenamed({"partner_id": "negative_id", "score": "negative_score"}), ["row", "low", "high"])
            .join(rows.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
