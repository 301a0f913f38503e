import itertools
import random

import numpy as np
import pytest

from regiometra.llm import mixing
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_fill_shares_and_caps():
    sizes = {"a": 10, "b": 100, "c": 0, "d": 50}
    targets = mixing.fill(sizes, {"a": 5, "b": 2, "c": 1, "d": 5})
    assert targets["a"] == 20 and targets["c"] == 0 and targets["d"] == 100 and targets["b"] == pytest.approx(240 - 120)
    assert mixing.fill({}, {}) == {} and mixing.fill({"a": 0}, {"a": 5}) == {"a": 0.0}


@pytest.mark.parametrize("fitted", [8, 60, 10_000])
def test_fit_is_the_best_subset_sum_of_what_is_fitted(fitted):
    rng = random.Random(fitted)
    for _ in range(60):
        sizes = np.array(rng.sample(range(0, 30), rng.randint(1, 6)))
        counts = np.array([rng.randint(1, 4) for _ in sizes])
        budget = rng.randint(0, int((sizes * counts).sum()) + 5)
        taken = mixing.fit_counts(sizes, counts, budget, fitted)
        assert (taken >= 0).all() and (taken <= counts).all()
        sums = {int((sizes * c).sum()) for c in itertools.product(*[range(n + 1) for n in counts])}
        if fitted == 10_000:
            assert (sizes * taken).sum() == min(sums, key=lambda s: (abs(s - budget), s))


def test_fit_of_large_counts_comes_near():
    sizes, counts = np.arange(1, 2_000), np.full(1_999, 10 ** 7)
    budget = int((sizes * counts).sum()) * 2 // 7 + 5
    taken = mixing.fit_counts(sizes, counts, budget)
    assert (sizes * taken).sum() == budget and (taken <= counts).all()


@pytest.mark.parametrize("copies, budget_share", [(1, 0.4), (1, 0.7), (3, 0.55), (50, 0.6)])
def test_every_band_of_lengths_gives_its_share(copies, budget_share):
    sizes, counts = np.arange(1, 2_001), np.full(2_000, copies)
    budget = round(budget_share * int((sizes * counts).sum()))
    shares = []
    for seed in (17, 18):
        taken = mixing.fit_counts(sizes, counts, budget, seed=seed)
        assert (taken >= 0).all() and (taken <= counts).all() and (sizes * taken).sum() == budget
        bands = [taken[k:k + 200].sum() / counts[k:k + 200].sum() for k in range(0, 2_000, 200)]
        assert bands == pytest.approx([budget_share] * 10, abs=0.05)
        shares.append(taken.tolist())
    assert shares[0] != shares[1]


def test_a_small_source_gives_long_and_short_documents_alike():
    lengths, counts = np.unique(np.random.default_rng(5).integers(20, 160, 500), return_counts=True)
    budget = int((lengths * counts).sum()) * 6 // 10
    taken = mixing.fit_counts(lengths, counts, budget)
    assert (lengths * taken).sum() == budget
    for band in np.array_split(np.arange(len(lengths)), 5):
        assert taken[band].sum() / counts[band].sum() == pytest.approx(0.6, abs=0.12)


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_subset_sum_mixing"](spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_subset_sum_mixing"](spark, SMALL).collect()))
    totals, taken, seen = {}, {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size)
        totals[d.source] = totals.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
        seen[d.source] = (r.source_size, r.target)
    names = sorted(totals)
    want = mixing.fill(totals, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in names:
        assert seen[s] == (totals[s], pytest.approx(want[s])) and abs(taken[s] - want[s]) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(totals.values()))


def test_edges(spark):
    rows = [(1, None, 5), (2, "a", None), (3, "a", 7), (3, "a", 7), (None, "b", 0), (4, None, 10_000_000), (5, "n", 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, size int, target_size int")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 7 and all(0 <= r.copies <= 2 for r in mixed)
    assert {r.source for r in mixed if r.target == 0} == {"b"}
    assert mixing.mix(docs.limit(0)).count() == 0
