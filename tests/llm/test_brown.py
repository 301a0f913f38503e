import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import brown
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def base(rows, held):
    """n_tokens, n_known, train tokens and base score of every row, word by word."""
    counts = Counter(t for (k, text), h in zip(rows, held) if not h for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[t] > 0 for t in ts), total,
             sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)) for ts in (tokens(x) for _, x in rows)]


def test_query_base_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    have = {r.doc_id: r for r in QUERIES["op2_brown_class_scores"](spark, SMALL).collect()}
    assert len(have) == len(rows)
    for (k, _), h, (n, known, total, score) in zip(rows, held, base(rows, held)):
        r = have[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.score < 0
    out = [r for r in have.values() if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_probabilities_after_each_class_sum_to_one():
    rng = np.random.default_rng(1)
    classes = rng.integers(1, brown.CLASSES, 500)
    counts = rng.integers(1, 40, 500)
    sizes = np.bincount(classes, counts, brown.CLASSES)
    types = np.bincount(classes, minlength=brown.CLASSES).astype(float)
    moves = rng.integers(0, 9, (brown.CLASSES, brown.CLASSES)).astype(float)
    transition, size, unknown = brown.log_tables(moves, sizes, types)
    assert np.allclose((10 ** transition).sum(axis=1), 1)
    for c in np.flatnonzero(sizes):
        words = (counts[classes == c] - brown.DISCOUNT) / 10 ** size[c]
        assert words.sum() + 10 ** unknown[c] == pytest.approx(1)


def test_block_scores_equal_a_walk_over_tokens():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30))).encode() for _ in range(20)] + [b"", b" \n", b"A a\x0bB"]
    block = brown.code(texts, np.zeros(len(texts), bool))
    counts = rng.integers(0, 5, len(block.words)) * rng.integers(0, 2, len(block.words))
    classes = rng.integers(1, 9, len(block.words)).astype(np.uint8)
    tables = brown.log_tables(rng.random((64, 64)) * 9, rng.integers(1, 50, 64).astype(float), rng.integers(1, 9, 64).astype(float))
    transition, size, unknown = tables
    n, known, score = brown.score_block(block, counts, classes, tables)
    at = 0
    for i, text in enumerate(texts):
        assert n[i] == len(text.lower().split()) + 1
        want, last, seen = 0.0, brown.END_CLASS, 0
        if i:
            t = block.tokens[at - 1]
            last = prior if i else last
        for t in block.tokens[at:at + n[i]].tolist():
            if counts[t]:
                own, seen = int(classes[t]), seen + 1
                want += transition[last, own] + math.log10(counts[t] - brown.DISCOUNT) - size[own]
            else:
                own = int((transition[last] + unknown).argmax())
                want += transition[last, own] + unknown[own]
            last = own
        prior, at = last, at + n[i]
        assert known[i] == seen and score[i] == pytest.approx(want)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(300):
        side = rng.integers(2)
        words = [f"{'xy'[side]}{rng.integers(40)}" if rng.random() < 0.7 else ("the", "der")[side] for _ in range(30)]
        texts.append(" ".join(words).encode())
    block = brown.code(texts, np.zeros(len(texts), bool))
    classes = np.full(len(block.words), 1, np.uint8)
    classes[block.words == brown.END] = 0
    classes[:] = np.where(classes == 0, 0, 1 + np.arange(len(classes)) % 7)
    for _ in range(8):
        before, after = brown.neighbours(block, classes)
        own = classes[block.tokens]
        moves = np.bincount(before.astype(int) * 64 + own, minlength=4096).reshape(64, 64)
        near = np.zeros((len(classes), 128))
        np.add.at(near, (block.tokens, before), 1)
        np.add.at(near, (block.tokens, 64 + after), 1)
        classes = brown.better(near, np.ones(len(classes)), classes, moves)
    names = {h: w for w in {w for t in texts for w in t.split()} for h in [brown.code([w], np.zeros(1, bool)).words]
             for h in [int(h[h != brown.END][0])]}
    sides = {}
    for h, c in zip(block.words.tolist(), classes.tolist()):
        if h in names and names[h] not in (b"the", b"der"):
            sides.setdefault(c, Counter())[names[h][:1]] += 1
    assert sum(max(s.values()) for s in sides.values()) >= 0.9 * sum(sum(s.values()) for s in sides.values())


def test_repeated_rows_are_coded_once_and_count_each_time(spark):
    rows = [(1, "a b")] * 2_300 + [(1, "b a"), (2, "a b"), (None, "c"), (None, "c"), (4, "a q"), (4, "a q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    held = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    blocks, _ = brown._store(docs, "doc_id", "text", held)
    weights = [w for r in blocks.collect() for w in np.frombuffer(r.weights, np.int64).tolist()]
    assert sorted(weights) == [1, 1, 2, 2, 2_300]
    have = brown.lm_scores(docs, held).collect()
    want = sorted((k or 0, n, known, total, round(s, 9)) for (k, _), (n, known, total, s) in
                  zip(rows, base(rows, [k == 4 for k, _ in rows])))
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in have) == want
    singly = docs.withColumn("doc_id", F.when(F.col("doc_id") == 4, 4).otherwise(10 + F.monotonically_increasing_id()))
    alone = brown.lm_scores(singly, F.col("doc_id") == 4).collect()
    assert sorted(round(r.score, 9) for r in have) == sorted(round(r.score, 9) for r in alone)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b " * 20_000), (3, "A b " * 20_000), (None, "b c"), (4, "q")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, block int")
    have = brown.lm_scores(docs, F.col("doc_id") == 4).collect()
    assert len(have) == len(rows)
    want = {(n, known, total): s for n, known, total, s in base(rows, [k == 4 for k, _ in rows])}
    for r in have:
        assert r.base_score == pytest.approx(want[r.n_tokens, r.n_known, r.train_tokens]) and math.isfinite(r.score)
    assert brown.lm_scores(docs.limit(0), F.lit(False)).count() == 0
    nothing = brown.lm_scores(docs, F.lit(True)).collect()
    assert len(nothing) == len(rows) and all(r.n_known == 0 and math.isfinite(r.score) for r in nothing)
