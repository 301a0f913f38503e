"""Nearest neighbours by largest inner product with vantage-point trees per shard.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance, for which the
triangle inequality holds. Each shard's distinct vectors form a vantage-point tree; a block of queries walks it
together, near child first, and skips a child whose distance bound, times ``factor``, exceeds the query's k-th
distance so far. ``factor`` 1 is exact search; larger factors skip more.

Rows without an id, and vectors that are null, zero, or hold null or non-finite components take no part. Only
vectors of the query's dimension are its candidates, and rows with the query's id are its own. Repeated rows are
candidates each; repeated queries count once. Ties go to the smaller id. An empty table, or no query, gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.session import stage

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 1_024, 512
#: Scores of matrix products that are this close may be equal.
TIE = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector can be compared at all."""
    name = f"`{vector}`"
    return F.expr(f"{name} IS NOT NULL AND exists({name}, x -> x <> 0) AND "
                  f"forall({name}, x -> x IS NOT NULL AND abs(x) < double('infinity') AND NOT isnan(x))")


def build_tree(ids: np.ndarray, vectors: np.ndarray, k: int, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Tree arrays over distinct vectors; of equal vectors the smallest ids that any query can need are kept."""
    vectors = vectors.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    distinct, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
    members = np.argsort(inverse.ravel(), kind="stable")
    sizes = np.bincount(inverse.ravel(), minlength=len(distinct))
    repeats = int(np.unique(ids, return_counts=True)[1].max())
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = place < k + repeats  # at most k others and the query's own rows can be among the k nearest
    owner, row_ids = np.repeat(np.arange(len(distinct)), sizes)[held], ids[order][members][held]

    lift = np.square(distinct).sum(axis=1)
    top = lift.max()
    lifted = np.column_stack([distinct, np.sqrt(np.maximum(top - lift, 0))])
    rng = np.random.default_rng(len(distinct))
    perm, nodes = np.arange(len(distinct)), []

    def split(start: int, end: int) -> int:
        me = len(nodes)
        nodes.append(None)
        own = perm[start:end]
        vantage = int(own[rng.integers(len(own))])
        gaps = np.sqrt(np.square(lifted[own] - lifted[vantage]).sum(axis=1))
        if len(own) <= leaf_rows or gaps.max() == gaps.min():
            nodes[me] = (start, end, -1, -1, -1, 0, 0, 0, 0)
            return me
        middle = len(own) // 2
        cut = np.argpartition(gaps, middle)
        perm[start:end], gaps = own[cut], gaps[cut]
        bounds = (gaps[:middle].min(), gaps[:middle].max(), gaps[middle:].min(), gaps[middle:].max())
        inner, outer = split(start, start + middle), split(start + middle, end)
        nodes[me] = (start, end, vantage, inner, outer, *bounds)
        return me

    split(0, len(distinct))
    position = np.empty_like(perm)
    position[perm] = np.arange(len(perm))
    table = np.array(nodes, np.float64)
    table[table[:, 2] >= 0, 2] = position[table[table[:, 2] >= 0, 2].astype(int)]
    by_owner = np.lexsort((row_ids, position[owner]))
    return {"nodes": table, "vectors": distinct[perm], "top": np.array([top]),
            "owner": position[owner][by_owner], "ids": row_ids[by_owner]}


def search_tree(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int,
                factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of up to k nearest candidates of every query."""
    nodes, vectors, top = tree["nodes"], tree["vectors"], tree["top"][0]
    queries = queries.astype(np.float64)
    norms = np.square(queries).sum(axis=1)
    pairs = np.unique(np.stack([tree["ids"], tree["owner"]]), axis=1)
    own = np.unique(pairs[0], return_counts=True)[1].max(initial=1)
    keep = min(k + int(own), len(vectors))  # distinct vectors: as many as one id has, the query's own, and k others
    best = np.full((len(queries), keep), -np.inf)
    found = np.full((len(queries), keep), -1)
    least_id = tree["ids"][np.searchsorted(tree["owner"], np.arange(len(vectors)))]

    def gap(rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms[rows] + top - 2 * scores, 0))

    def visit(node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        start, end, vantage, inner, outer = nodes[node, :5].astype(int)
        if vantage < 0:
            scores = queries[rows] @ vectors[start:end].T
            better = scores.max(axis=1) >= best[rows].min(axis=1) - TIE
            rows, scores = rows[better], scores[better]
            both = np.concatenate([best[rows], scores], axis=1)
            where = np.concatenate([found[rows], np.broadcast_to(np.arange(start, end), scores.shape)], axis=1)
            cut = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            last = np.take_along_axis(both, cut, 1).min(axis=1, initial=np.inf)
            for row in np.flatnonzero((last > -np.inf) & ((both >= last[:, None] - TIE).sum(axis=1) > keep)):
                tied = np.flatnonzero(both[row] >= last[row] - TIE)  # settled by exact score, then smallest id
                exact = (queries[rows[row]] * vectors[where[row, tied]]).sum(axis=1)
                cut[row] = tied[np.lexsort((least_id[where[row, tied]], -exact))[:keep]]
            best[rows], found[rows] = np.take_along_axis(both, cut, 1), np.take_along_axis(where, cut, 1)
            return
        away = gap(rows, queries[rows] @ vectors[vantage])
        bounds = nodes[node, 5:]
        near = away <= (bounds[1] + bounds[2]) / 2
        visit(inner, rows[near])
        visit(outer, rows[~near])
        for child, chosen, (low, high) in ((outer, near, bounds[2:]), (inner, ~near, bounds[:2])):
            least = np.maximum(np.maximum(away[chosen] - high, low - away[chosen]), 0)
            visit(child, rows[chosen][factor * least <= gap(rows[chosen], best[rows[chosen]].min(axis=1)) + 1e-9])

    visit(0, np.arange(len(queries)))
    query, column = np.nonzero(found >= 0)
    vector = found[query, column]
    first, last = np.searchsorted(tree["owner"], vector), np.searchsorted(tree["owner"], vector, "right")
    counts = last - first
    take = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    query, vector, candidate = np.repeat(query, counts), np.repeat(vector, counts), tree["ids"][take]
    score = np.empty(len(query))
    for at in range(0, len(query), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = (queries[query[part]] * vectors[vector[part]]).sum(axis=1)
    other = candidate != ids[query]
    query, candidate, score = query[other], candidate[other], score[other]
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], candidate[place < k], score[place < k]


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def _blocks(rows: DataFrame, per_block: int, name: str, seed: int) -> tuple[DataFrame, int]:
    """``dim, name`` dealt by hash of the id, with the number of blocks."""
    blocks = max(1, -(-rows.count() // per_block))
    return rows.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(blocks)).cast("int")), blocks


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    kept = df.where(usable(vector)).where(F.col(f"`{key}`").isNotNull())
    return kept.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                       F.size(F.col(f"`{vector}`")).alias("dim"))


def index(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
          shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One stored tree per (dimension, shard), and the number of shards; every usable row is in one of them."""
    dealt, shards = _blocks(_rows(df, key, vector), shard_rows, "shard", 11)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(group["id"].to_numpy(np.int64), np.stack(group["v"].to_numpy()), k)
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "tree": [_packed(tree)]})

    trees = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    return stage(trees, "trees"), shards


def search(trees: DataFrame, shards: int, queries: DataFrame, k: int, factor: float, key: str = "vec_id",
           vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found.

    Blocks of queries meet every shard; a task holds one block and one tree.
    """
    dealt, blocks = _blocks(_rows(queries, key, vector), block_rows, "block", 12)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = group["id"].to_numpy(np.int64), np.stack(group["v"].to_numpy())
        _, once = np.unique(np.column_stack([ids, vectors.view(np.int64)]), axis=0, return_index=True)
        held = {"ids": ids[once], "vectors": vectors[once]}
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1], "queries": [_packed(held)]})

    gathered = dealt.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, queries binary")
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = gathered.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block in zip(batch["tree"], batch["queries"]):
                held = _unpacked(block)
                query, candidate, score = search_tree(_unpacked(tree), held["ids"], held["vectors"], k, factor)
                yield pd.DataFrame({"query_id": held["ids"][query], "vec_id": candidate, "score": score})

    pairs = left.join(right, ["dim", "shard", "block"]).select("tree", "queries")
    found = pairs.mapInPandas(walk, "query_id bigint, vec_id bigint, score double")
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
