import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import components, jaccard
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def grams(text, n):
    words = (text or "").encode().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, n, num, den):
    """(id, class id, links) by comparing every pair."""
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return sorted(((k, least.get(find(i)), links[i]) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    hot = rng.choices(vocabulary, k=60)
    for group in range(30):
        base = hot if group == 0 else rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(60 if group == 0 else rng.choice([1, 1, 2, 3, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((at * 7 % 1009, rng.choice([" ", "\n"]).join(words)))
            at += 1
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "a  b"), (2005, "a b c"), (None, rows[0][1]),
                   (None, "only here it is so"), rows[3], rows[3], (2006, "x y z q r " * 3000)]


@pytest.mark.parametrize("blocks", [(4096, 512), (6, 5)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BAND_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", blocks[1])
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, id int, class_id int")
    have = jaccard.similar(docs).select(F.nullif("id", F.lit(jaccard.NO_ID)).alias("id"), F.nullif("class_id", F.lit(jaccard.NO_ID)).alias("c"), "n_links")
    assert sorted((tuple(r) for r in have.collect()), key=str) == brute(rows, 5, 4, 5)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    have = QUERIES["op6_bayes_jaccard_join"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in have), key=str) == brute(rows, 5, 4, 5)


def test_keep_one_keeps_one_of_each_class(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, __th2 int")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    classes = {}
    for (k, c, _), (_, text) in zip(brute(rows, 5, 4, 5), sorted(rows, key=str)):
        classes.setdefault(c, k)
    assert len(kept) == len({c for _, c, _ in brute([r for r in rows if r[0] is not None or r[1] != "only here it is so"], 5, 4, 5)}) + 1
    assert {k for k, t in kept if k is not None and t} >= {c for c in classes if c is not None and c < 2000}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.similar(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_posterior_bounds_only_rise_and_survivors_agree():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < jaccard.STEP and least[-1] < jaccard.COMPARED
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (200, 64), dtype=np.uint8)
    b = np.where(rng.random((200, 64)) < rng.random((200, 1)), a, 1 - a)
    want = [i for i in range(200) if all((a[i, :16 * (k + 1)] == b[i, :16 * (k + 1)]).sum() >= m for k, m in enumerate(least))]
    assert jaccard.survivors(a, b, least).tolist() == want


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert jaccard.intersections(sets[:4], sets[4:], 64).tolist() == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150)]
    have = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert have == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 150: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_threshold_is_exact():
    assert Fraction(str(0.8)) == Fraction(4, 5)
