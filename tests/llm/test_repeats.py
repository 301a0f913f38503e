import hashlib
import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import repeats, suffix_array, suffix_tree
from regiometra.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute_bytes(rows, window):
    """(bytes, removed, spans, kept) of every row, by looking up every window."""
    first = {}
    big = float("inf")
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - window + 1):
            w = data[s:s + window]
            first[w] = min(first.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1):
            if first[data[s:s + window]] < (big if i is None else i):
                gone[s:s + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window):
    first = {}
    big = float("inf")
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            w, at = tuple(words[s:s + window]), (big if i is None else i, s)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        starts = {}
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if first[w][0] < (big if i is None else i) or w in starts:
                gone[s:s + window] = [True] * window
            starts[w] = s
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_suffix_array_of_random_strings():
    rng = random.Random(1)
    for _ in range(500):
        v = [rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        assert suffix_array.suffix_array(v) == sorted(range(len(v)), key=lambda i: v[i:])


@pytest.mark.parametrize("many", [2, 5, 24])
def test_suffix_array_by_whole_groups(monkeypatch, many):
    monkeypatch.setattr(suffix_array, "MANY", many)
    rng = random.Random(many)
    for _ in range(500):
        v = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(40))] * rng.choice([1, 1, 4])
        assert suffix_array.suffix_array(v) == sorted(range(len(v)), key=lambda i: v[i:])


def test_suffix_array_takes_no_step_per_suffix_of_a_large_group():
    rng, lines = random.Random(1), 0
    one = [rng.randint(2, 200) for _ in range(60)]
    values = (one + [1]) * 300

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        order = suffix_array.suffix_array(values)
    finally:
        sys.settrace(None)
    assert order == sorted(range(len(values)), key=lambda i: values[i:])
    assert lines < 3 * len(values)


@pytest.mark.parametrize("limit", [2, 7, 1000])
def test_trees_and_arrays_class_windows_alike(limit):
    rng = random.Random(2)
    contexts = [b" ".join(rng.choice([b"a", b"bb", b"c"]) for _ in range(rng.randint(4, 12))) for _ in range(60)]
    which, offset, klass = suffix_tree.window_classes(contexts, 4, limit)
    by = {}
    for w, o, k in zip(which.tolist(), offset.tolist(), klass.tolist()):
        by.setdefault(tuple(contexts[w].split()[o:o + 4]), set()).add(k)
    assert all(len(ks) == 1 for ks in by.values()) and len({k for ks in by.values() for k in ks}) == len(by)
    which, offset, klass = suffix_array.window_classes(contexts, 5)
    by = {}
    for w, o, k in zip(which.tolist(), offset.tolist(), klass.tolist()):
        by.setdefault(contexts[w][o:o + 5], set()).add(k)
    assert sum(max(0, len(c) - 4) for c in contexts) == len(which)
    assert all(len(ks) == 1 for ks in by.values()) and len({k for ks in by.values() for k in ks}) == len(by)


def test_queries_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(QUERIES["op8_suffix_array_dedup"](spark, SMALL)) == brute_bytes(rows, 50)
    assert got(QUERIES["op10_suffix_tree_dedup"](spark, SMALL)) == brute_words(rows, 20)


def small_corpus():
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 20))) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(1, 5))]
        rows.append((i * 3 % 120, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(7, rows[0][1]), (500, None), (501, ""), (None, rows[1][1]), (None, "é" * 30), (502, "é" * 30), (3, rows[3][1]), rows[5], rows[5]]
    return rows + [(600, "ab " * 4000), (601, "xx " + "ab " * 3000), (602, "z" * 5000)]


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
@pytest.mark.parametrize("slab", [1 << 20, 64])
def test_small_corpus_equals_brute_force(spark, monkeypatch, hot, slab):
    monkeypatch.setattr(repeats, "SLAB", slab)
    rows = small_corpus()
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id bigint, text string, id int, kept binary")
    found = suffix_array.remove_repeats(docs, 12, 6, hot=hot)
    digest = found.select("id", "th", "units", "removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h"))
    have = repeats.attach(docs, digest).select("doc_id", "__cut.units", "__cut.removed", "__cut.n", "__cut.h")
    assert got(have) == brute_bytes(rows, 12)
    found = suffix_tree.remove_repeats(docs, 6, 3, hot=hot)
    digest = found.select("id", "th", "units", "removed", F.sha2("kept", 256).alias("h"))
    have = repeats.attach(docs, digest).select("doc_id", "__cut.units", "__cut.removed", "__cut.h")
    assert got(have) == brute_words(rows, 6)


def test_repeated_rows_are_stored_once(spark):
    rows = [(1, "a b c")] * 300 + [(2, "a b c"), (2, "d"), (None, None), (None, "")]
    stored, _ = repeats.store(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    have = sorted((r.id, bytes(r.data)) for r in stored.collect())
    assert have == [(1, b"a b c"), (2, b"a b c"), (2, b"d"), (repeats.NO_ID, b"")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_array.remove_repeats(docs).count() == 0 and suffix_tree.remove_repeats(docs).count() == 0


def test_spans_and_kept_are_whole(spark):
    docs = spark.createDataFrame([(1, "abcdefghijkl"), (2, "xxcdefghiyy")], "doc_id bigint, text string")
    rows = {r.id: r for r in suffix_array.remove_repeats(docs, 5, 3).collect()}
    assert rows[1].kept == b"abcdefghijkl" and rows[2].kept == b"xxyy"
    assert [tuple(s) for s in rows[2].spans] == [(2, 9)]


def test_reach_keeps_every_shared_window():
    rng = random.Random(8)
    contexts, offsets, groups = [], [], []
    for g in range(12):
        anchor = bytes(rng.choice(b"abc") for _ in range(3))
        for _ in range(rng.randint(1, 9)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5)))
            contexts.append(left + anchor + bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 7))))
            offsets.append(len(left))
            groups.append(g * 5)
    low, high = suffix_array.reach(contexts, np.array(offsets), np.array(groups))
    for i, c in enumerate(contexts):
        best = [0, 0]
        for j, d in enumerate(contexts):
            if i != j and groups[i] == groups[j]:
                a, b = c[offsets[i]:], d[offsets[j]:]
                best[1] = max(best[1], next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
                a, b = c[:offsets[i]][::-1], d[:offsets[j]][::-1]
                best[0] = max(best[0], next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
        assert (low[i], high[i]) == (offsets[i] - best[0], offsets[i] + best[1])


def test_owners_cost_the_same_whatever_their_number():
    rng = np.random.default_rng(1)
    seconds = {}
    for owners in (64, 4096):
        owner, chosen = rng.integers(0, owners, 1 << 20), np.flatnonzero(rng.random(1 << 20) < 0.3)
        start = time.process_time()
        found = repeats.by_owner(owner, chosen)
        seconds[owners] = time.process_time() - start
        assert [d for d, _ in found] == sorted({int(d) for d in owner[chosen]})
        assert all((owner[c] == d).all() and (np.diff(c) > 0).all() for d, c in found)
        assert sum(len(c) for _, c in found) == len(chosen)
    assert seconds[4096] < 3 * seconds[64] + 0.1
    assert repeats.by_owner(np.zeros(0, int), np.zeros(0, int)) == []
