import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from regiometra.llm import mixing
from regiometra.session import stage
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_rules import brute as brute_measures

SMALL = "/root/testdata/sf0.001"


def cut(rows, window=50):
    """Texts without the bytes of windows that a smaller id has."""
    first = {}
    for i, t in rows:
        data = t.encode()
        for s in range(len(data) - window + 1):
            w = data[s:s + window]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        data, gone = t.encode(), set()
        for s in range(len(data) - window + 1):
            if first[data[s:s + window]] < i:
                gone.update(range(s, s + window))
        out[i] = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), f"test-{name}")
        out.append(docs)
    return out


def test_order_of_stages_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixed_sources", "packed_sequences"]
    assert all(r.dtypes == results[0].dtypes for r in results[:5])


def test_each_stage_equals_brute_force_on_its_input(results):
    rows = [{r.doc_id: r for r in df.collect()} for df in results[:4]]
    kept = set()
    for k, r in rows[0].items():
        m = brute_measures(r.text)
        junk = (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
                or m["word_chars"] < 3 * m["n_words"] or m["word_chars"] > 10 * m["n_words"]
                or 10 * m["n_capitals"] > 3 * m["word_chars"] or 2 * m["n_dup_lines"] > m["n_lines"])
        if not junk:
            kept.add(k)
    assert set(rows[1]) == kept
    classes = brute_classes([(k, r.text) for k, r in rows[1].items()], 5, 4, 5)
    assert set(rows[2]) == {c for _, c, _ in classes}
    texts = cut([(k, r.text) for k, r in rows[2].items()])
    assert {k: r.text for k, r in rows[3].items()} == {k: t for k, t in texts.items() if t.split()}
    assert all(r.n_chars == len(r.text) for r in rows[3].values())

    sizes = {k: len(r.text.encode().split()) for k, r in rows[3].items()}
    totals, taken = Counter(), Counter()
    copies = Counter(r.doc_id for r in results[4].collect())
    for k, r in rows[3].items():
        totals[r.source] += sizes[k]
        taken[r.source] += copies[k] * sizes[k]
    names = sorted(totals)
    want = mixing.fill(totals, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    largest = {s: max(sizes[k] for k, r in rows[3].items() if r.source == s) for s in names}
    assert max(copies.values()) <= 2 and all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in names)


def test_packing_holds_every_copy(results):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in results[4].collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for piece, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if a == 0 else a + 1024
            want[r.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got, sequences = Counter(), {}
    for r in results[5].collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_edges(spark):
    good = " ".join(f"w{i} and{i % 7}x" for i in range(80))
    rows = [(1, good, "en", "a", 9, 5), (1, good, "en", "a", 9, 5), (2, None, None, None, None, None), (None, good + " tail", None, None, None, 6),
            (3, "", "x", "b", 0, 7), (4, " ".join(f"v{i}" for i in range(60_000)), "en", None, 1, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int")
    for _, function in corpus_pipeline.STAGES[:4]:
        after = stage(function(spark, docs, SMALL), "edges")
        assert after.columns == docs.columns
        docs = after
    assert docs.count() > 0
