import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import negatives
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, label int, embedding array<double>"


def brute(rows, is_anchor, mine=negatives.Mine()):
    """Rows of the contract, by every pair in turn."""
    kept = sorted({(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows
                   if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for i, label, v in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in kept if j != i and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:mine.positives]:
            hard = [s for s in scored if s[2] != label and mine.low * -p <= 100 * -s[0] <= mine.high * -p]
            out |= {(i, positive, rank + 1, j, -p, -n) for rank, (n, j, _) in enumerate(hard[:mine.negatives])}
    return sorted(out)


def mined(df, is_anchor, **sizes):
    own = {k: sizes.pop(k) for k in ("tree_rows", "leaf_rows") if k in sizes}
    trees = negatives.index(df, **own)
    found = negatives.mine_negatives(trees, df.where(is_anchor), **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    assert len(want) > 100
    assert sorted(map(tuple, QUERIES["op13_cover_tree_negatives"](spark, SMALL).collect())) == want


@pytest.mark.parametrize("dim,spread", [(2, 1.0), (6, 0.2)])
def test_deep_trees_equal_brute_force(spark, dim, spread):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(9, dim))
    points = centres[rng.integers(0, 9, 700)] + spread * rng.normal(size=(700, dim)) * rng.random((700, 1))
    rows = [(int(i), int(rng.integers(0, 4)), np.round(p, 2).tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df, "vec_id % 10 = 0", tree_rows=150, leaf_rows=8, block_rows=20, run_trees=2) == brute(rows, lambda i: i % 10 == 0)


def test_tree_holds_its_bounds():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (200, 5)) for c in rng.normal(size=(10, 5))])).astype(np.int64)
    arrays = negatives.build_tree(np.arange(2000), rng.integers(0, 3, 2000), vectors, leaf_rows=16)
    tree, query = negatives.Tree(arrays), rng.normal(size=5) * 300
    low, high = tree.bounds(query, float(np.linalg.norm(query)), slice(0, len(tree.start)))
    assert len(tree.start) > 40 and sorted(arrays["ids"].tolist()) == list(range(2000))
    for n in range(len(tree.start)):
        scores = tree.vectors[tree.start[n]:tree.end[n]] @ query
        assert low[n] <= scores.min() and scores.max() <= high[n]
        if tree.children[n]:
            parts = sorted((tree.start[c], tree.end[c]) for c in range(tree.child[n], tree.child[n] + tree.children[n]))
            assert parts[0][0] == tree.start[n] and parts[-1][1] == tree.end[n] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_clustered_vectors_are_mostly_skipped():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.02, (160, 16)) for c in rng.normal(size=(50, 16))])).astype(np.int64)
    labels = rng.integers(0, 3, len(vectors))
    tree = negatives.Tree(negatives.build_tree(np.arange(len(vectors)), labels, vectors, leaf_rows=32))
    for i in range(0, len(vectors), 100):
        tree.best(tree.vectors[i], int(tree.ids[i]), int(tree.labels[i]), True, 5, [(-(1 << 62), 1 << 62)], [[]])
    assert tree.compared < 0.15 * len(vectors) * (len(vectors) / 100)


def test_hot_vectors_nulls_and_repeats(spark):
    rng = np.random.default_rng(6)
    same = [0.5, 0.25, 0.0]
    rows = [(i, i % 2, same) for i in range(200)] + [(i, i % 3, rng.normal(size=3).round(2).tolist()) for i in range(200, 300)]
    rows += [(40, 0, same)] * 100 + [(60, 1, [0.1, 0.2]), (61, 0, [0.3, 0.2]), (62, 0, [0.3, 0.1])]
    rows += [(None, 1, same), (301, None, same), (302, 1, None), (320, 1, [1.0, None, 0.0]), (340, 0, [float("nan"), 0.0, 1.0]),
             (360, 1, [float("inf"), 0.0, 1.0]), (380, 1, []), (400, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit(1), "v": F.lit(2), "dim": F.lit(3), "row": F.lit(4), "tree": F.lit(5)})
    want = brute(rows, lambda i: i % 20 == 0)
    assert mined(df, "vec_id % 20 = 0") == want
    assert mined(df, "vec_id % 20 = 0", tree_rows=30, leaf_rows=4, block_rows=3, run_trees=1) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mined(empty, "vec_id % 20 = 0") == []
    some = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [1.0])], VECTORS)
    assert mined(some, "vec_id % 20 = 0") == []
