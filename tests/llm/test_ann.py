import numpy as np
import pytest

from regiometra.llm import ann
from regiometra.llm.queries import QUERIES


def brute(rows, k):
    """Rows of the contract by comparing every pair."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for q, a in good:
        if q % 20:
            continue
        scored = sorted((-float((a * b).sum()), i) for i, b in good if i != q and len(b) == len(a))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def run(spark, rows, k, factor, **shapes):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<double>, dim int, shard int")
    trees, shards = ann.index(df, k, **shapes)
    return ann.search(trees, shards, df.where("vec_id % 20 = 0"), k, factor, block_rows=3)


def test_factor_one_is_exact_over_shards_blocks_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    rows += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 1.0, 0.0, 0.0]),
             (504, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4), (520, [1.0, 2.0]), (521, [2.0, 2.0]), (540, [])]
    assert got(run(spark, rows, 5, 1.0, shard_rows=100)) == brute(rows, 5)


def test_small_trees_are_exact_at_factor_one():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 6)) * rng.uniform(0.1, 9, (300, 1))
    tree = ann.build_tree(np.arange(300), vectors, 4, leaf_rows=8)
    query, candidate, score = ann.search_tree(tree, np.arange(300), vectors, 4, 1.0)
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    assert np.allclose(score.reshape(300, 4), -np.sort(-scores, axis=1)[:, :4])
    assert (candidate.reshape(300, 4) == np.argsort(-scores, axis=1)[:, :4]).all()


def test_different_vectors_of_the_own_id_take_no_places():
    rng = np.random.default_rng(7)
    ids = np.concatenate([np.zeros(9, np.int64), np.arange(1, 61)])
    vectors = np.concatenate([9 + rng.random((9, 4)), rng.random((60, 4))])
    tree = ann.build_tree(ids, vectors, 5, leaf_rows=8)
    query, candidate, _ = ann.search_tree(tree, ids[:1], vectors[:1], 5, 1.0)
    assert query.tolist() == [0] * 5
    assert candidate.tolist() == (1 + np.argsort(-(vectors[9:] @ vectors[0]))[:5]).tolist()


def test_repeated_and_empty(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 0.0])] * 2
    assert got(run(spark, rows, 4, 1.0)) == sorted([(0, 1, 1, 1.0), (0, 2, 1, 1.0)])
    assert run(spark, [], 4, 1.0).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, have = brute(rows, 20), got(QUERIES["op7_vantage_point_search"](spark, folder))
    assert len(have) == len(want)
    assert len({r[::2] for r in have} & {r[::2] for r in want}) >= 0.9 * len(want)
