import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import packing, tokens
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("text", ["", " ", "a", "It's  two\n\n lines\t ", "<|endoftext|>x", "é日本 ١٢ 　 z", "!" * 900, "\x00\x1f"])
def test_ids_equal_the_library(path, library, text):
    assert tokens.encoder(path)(text) == library.encode(text, add_special_tokens=False).ids


def test_query_keeps_every_id_and_fills_sequences(spark, library):
    rows = QUERIES["op3_pattern_packing"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.length for r in pieces[1:]] == [1024] * (len(pieces) - 1)
        assert sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_patterns_are_exact_and_complete():
    found = {tuple(x for x in p if x) for p in packing.exact_patterns(np.arange(1, 13), 12).tolist()}
    want = {(12,)} | {(a, 12 - a) for a in range(1, 7)} | {
        (a, b, 12 - a - b) for a in range(1, 13) for b in range(a, 13) if 12 - a - b >= b}
    assert found == want


def test_fit_finds_a_solvable_histogram():
    counts = np.zeros(13, int)
    counts[[3, 9]] = 40
    counts[[4, 8]] = 7
    plan = packing.plan(dict(enumerate(counts.tolist())), 12)
    assert plan.sequences == 47


def test_plan_places_all_without_overlap():
    rng = np.random.default_rng(3)
    histogram = {int(x): int(n) for x, n in zip(range(1, 65), rng.integers(0, 90, 64))}
    plan = packing.plan(histogram, 64)
    used = {}
    for length, n in histogram.items():
        for rank in range(n):
            s, o = plan.places(np.array([length]), np.array([rank]))
            used.setdefault(int(s[0]), []).append((int(o[0]), length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == plan.sequences


def test_edges(spark, path):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 5000, "z"), (3, "word " * 5000, "z"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string")
    pieces = tokens.token_pieces(docs, path, 16, 2)
    assert pieces.filter("length > 16 or length < 1").count() == 0
    assert pieces.where("doc_id = 1").select("length", F.crc32("ids").alias("c")).first() == (1, zlib.crc32(b"\2\0\0\0"))
    placed = packing.pack(pieces.withColumn("base", F.lit(1)).withColumn("rank", F.lit(2)), 16).collect()
    assert len(placed) == pieces.count() and len({(r.sequence_id, r.offset) for r in placed}) == len(placed)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(tokens.token_pieces(empty, path, 16, 2), 16).count() == 0
