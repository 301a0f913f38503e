import random
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import windows, word_cache
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def odd_texts(count):
    rng = random.Random(1)
    parts = [" ", "\n", "\t", "\r\n", "\x1c", "\x85", "　", "\xa0", "a", "B", "\xe9", "é", "Σ", "ΑΣ", "İ",
             "ﬁ", "日本", "<|endoftext|>", "<|startoftext|>", "'s", "'", "١", "!!", "\x00", "\U0001f600", "foo",
             "  ", "́", "</w>", "​", "Ġ", "1a2", "\xdf", "\xc9T\xc9", "\xb5", "\xd7", "\xff", "STRASSE"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def test_ids_equal_the_library(spark, path, library):
    encode = word_cache.lower_words(path)
    texts = odd_texts(3000) + [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert all(encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_a_small_cache_gives_the_same():
    cache = word_cache.WordCache(lambda word: [len(word)], bound=100)
    for text in ("a bb ccc", "bb bb a", "dddd a"):
        assert cache.ids(text.split(" ")).tolist() == [len(w) for w in text.split(" ")]
    assert len(cache) < 4


def check_places(rows, window):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window
    return by_sequence


def test_query_keeps_every_id_and_pads_nothing(spark, library):
    rows = QUERIES["op12_least_squares_windows"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = check_places(rows, 4096)
    assert len(sequences) <= sum(r.length for r in rows) // 4096 + 13


def test_combinations_are_exact_and_complete():
    found = set(map(tuple, windows.combinations(np.arange(1, 13), 12, 4).tolist()))
    want = {(i, 12 // i, 0, 0) for i in range(1, 5) if 12 % i == 0} | {
        (i, a, j, b) for i in range(1, 4) for j in range(1, 5 - i) for a in range(1, 13) for b in range(a + 1, 13) if i * a + j * b == 12}
    assert found == want


def test_a_solvable_histogram_is_not_cut():
    made = windows.plan({3: 60, 6: 20, 5: 40, 2: 60}, 16, depth=4)  # 3+3+5+5, 6+6+2+2, ...
    taken = sum(int(made.fitted[n]) * n for n in (3, 6, 5, 2))
    assert taken >= 0.7 * (3 * 60 + 6 * 20 + 5 * 40 + 2 * 60)
    one = windows.plan({4: 40, 12: 40}, 16)
    assert one.sequences == 40 and not one.last and (one.fitted[[4, 12]] == 40).all()


def test_least_squares_are_least():
    parts = windows.combinations(np.arange(1, 9), 8, 3)
    counts = np.array([0, 5, 3, 0, 9, 1, 4, 2, 0], float)
    repeats = windows.solve_repeats(parts, counts, 5000)
    matrix = np.zeros((9, len(parts)))
    for k, (i, a, j, b) in enumerate(parts):
        matrix[a, k] += i
        matrix[b, k] += j
    slope = matrix.T @ (matrix @ repeats - counts)
    assert slope.min() > -1e-3 and np.abs(slope[repeats > 1e-6]).max() < 1e-3


@pytest.mark.parametrize("window", [64, 48])
def test_plan_places_all_without_overlap(window):
    rng = np.random.default_rng(3)
    histogram = {int(x): int(n) for x, n in zip(range(1, window), rng.integers(0, 90, window - 1))}
    made, used = windows.plan(histogram, window), {}
    for length, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in made.fragments(length, rank):
                assert start == at
                at += size
                used.setdefault(sequence, []).append((offset, size))
            assert at == length
    sizes = []
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    assert set(used) == set(range(made.sequences))
    assert all(s == window or s & (s - 1) == 0 for s in sizes) and sizes.count(window) >= len(sizes) - 6


def test_most_tokens_are_never_cut():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6.2, 0.9, 200_000).astype(int) + 1, 4095)
    counts = np.bincount(lengths, minlength=4097)
    made = windows.plan(dict(enumerate(counts.tolist())), 4096)
    assert (made.fitted * np.arange(4097)).sum() > 0.9 * lengths.sum()


def test_edges(spark, path):
    encoder = partial(word_cache.lower_words, path)
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 5000, "z"), (None, "a b", None)] + [(3, "same words", "z")] * 300 + [(None, "a b", "n")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string").withColumn("task", F.lit(1)).withColumn("ids", F.lit(2))
    placed = windows.pack(docs.repartition(5), encoder, 16, 2).collect()
    assert placed[0].asDict().keys() == {"doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"}
    assert sum(r.length for r in placed) == 1 + 1 + 5001 + 3 + 300 * 3 + 300 * 3
    assert sum(r.length for r in placed if r.doc_id is None) == 301 * 3
    assert [bytes(r.ids) for r in placed if r.doc_id in (1, 2)] == [b"\2\0\0\0"] * 2
    check_places(placed, 16)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert windows.pack(empty, encoder, 16, 2).count() == 0
