"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of its name and
the row's key, and the smallest draw wins, so a child gets keys in proportion to its weight. Draws do not depend on
siblings: raising a child's weight moves keys only into it, lowering it only out of it, and nothing moves within
subtrees whose weights stay. A shard grown as a region of its own takes rows only into itself.

Null keys hash to one fixed value and share a shard; equal keys always share a shard. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.llm.ranks import gapless_rank

#: region name -> rack name -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """Shards of weight one, dealt in order to racks and regions of fixed size."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a new region, so that rows move only into it."""
    return {**tree, f"grown{shard}": {f"grown{shard}": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _winner(level: str, children: dict, key: Column) -> Column:
    """Position of the child with the smallest weighted draw; children without weight draw nothing."""
    draws = []
    for position, (name, child) in enumerate(children.items()):
        if _weight(child) > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}/{name}"), key), 11)
            u = (bits.cast("double") + 0.5) * (2.0 ** -53)
            draws.append(F.struct((-F.ln(u) / _weight(child)).alias("draw"), F.lit(position).alias("child")))
    if not draws:
        raise ValueError("a tree needs a positive weight")
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else draws[0]["child"]


def shard_of(tree: Tree, key: Column) -> Column:
    """The shard a key descends to; the expression has one draw per node of the tree."""
    def descend(level: str, node) -> Column:
        if not isinstance(node, dict):
            return F.lit(int(level.rpartition("/")[2]))
        alive = {str(n): c for n, c in node.items() if _weight(c) > 0}
        branches = [descend(f"{level}/{n}", c) for n, c in alive.items()]
        if len(branches) == 1:
            return branches[0]
        won = _winner(level, alive, key)
        chosen = F.when(won == 0, branches[0])
        for position, branch in enumerate(branches[1:], 1):
            chosen = chosen.when(won == position, branch)
        return chosen
    return descend("", tree).cast("int")


def assign(df: DataFrame, key: str, tree: Tree, shard: str = "shard") -> DataFrame:
    """Adds the shard of every row."""
    return df.withColumn(shard, shard_of(tree, F.col(f"`{key}`")))


def place(df: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",), slot: str = "slot") -> DataFrame:
    """Adds each row's place in its shard, gapless from 0; shards larger than a task are ranked in buckets."""
    return gapless_rank(df, [shard], list(order), slot)
