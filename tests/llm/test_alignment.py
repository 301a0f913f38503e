import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometra.llm import alignment, sides
from regiometra.llm.queries import QUERIES
from tests.llm.test_windows import odd_texts

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    byte_level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    return byte_level, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return lambda: (sides.byte_level(a), sides.sentence_pieces(b))


def brute(texts, libraries):
    """Rows of the contract, from whole-text encodings and every pair of tokens in turn."""
    byte_level, pieces = libraries
    decoded = {}
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for i, b in enumerate([*own, *[b for b in range(256) if b not in own]]):
        decoded[chr(b) if b in own else chr(256 + i - len(own))] = b
    made, held = [], Counter()
    for text in texts:
        a = byte_level.encode(" " + text, add_special_tokens=False) if text else None
        ids_a, ids_b = (a.ids, pieces.encode(text)) if text else ([], [])
        spelled_a = [bytes(decoded[c] for c in t) for t in a.tokens] if text else []
        spelled_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                     for i in ids_b for p in [pieces.id_to_piece(i)]]
        data = (" " + (text or "")).encode()
        if not text or b"".join(spelled_a) != data or b"".join(spelled_b) != data:
            ids_a, ids_b, spelled_a, spelled_b = [], [], [], []
        spans = [], []
        for side, spelled in zip(spans, (spelled_a, spelled_b)):
            at = 0
            for s in spelled:
                side.append((at, at + len(s)))
                at += len(s)
        pairs = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(x) for x, (s, _) in zip(ids, side) if low <= s < high)
                                   for ids, side in ((ids_a, spans[0]), (ids_b, spans[1]))))
            low = high
        held.update(set(pairs))
        made.append((len(ids_a), len(ids_b), len(cuts), pairs, ";".join(groups)))
    highest = Counter()
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return [(n_a, n_b, n_groups, len(pairs), sum(held[p] == highest[p[0]] for p in pairs), sum(held[p] for p in pairs),
             hashlib.sha256(groups.encode()).hexdigest() if n_a else "") for n_a, n_b, n_groups, pairs, groups in made]


def test_ids_equal_the_libraries(spark, libraries, both):
    texts = odd_texts(3000) + [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    a, b = both()
    for t in texts:
        assert a.encode(" " + t).tolist() == libraries[0].encode(" " + t, add_special_tokens=False).ids
        assert b.encode(t).tolist() == libraries[1].encode(t)


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 22])
def test_odd_texts_equal_brute_force(spark, libraries, both, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    texts = odd_texts(150) + ["▁a b", "x ▁", None, "", " ", "a" * 400, "<|endoftext|>", "</s> <unk>", "same", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns(
        {"pairs": F.lit(1), "block": F.lit(2), "key": F.lit(3)})
    want = brute(texts, libraries)
    rows = {r.doc_id: r for r in alignment.align(docs.repartition(3), both).collect()}
    assert len(rows) == len(texts) and want[150][6] == "" == want[151][6]
    for i, w in enumerate(want):
        assert tuple(rows[i][c] for c in COLUMNS) == w, texts[i]


def test_query_equals_brute_force(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    texts = dict(sorted(texts.items(), key=lambda x: len(x[1] or "")))
    rows = {r.doc_id: r for r in QUERIES["op11_hash_set_alignment"](spark, SMALL).collect()}
    assert set(rows) == set(texts)
    want = dict(zip(texts, quick(list(texts.values()), libraries)))
    for key, w in want.items():
        assert tuple(rows[key][c] for c in COLUMNS) == w


def quick(texts, libraries):
    """As ``brute``, with every overlap found from byte ownership, so that long texts end."""
    made, held = [], Counter()
    for text in texts:
        if not text:
            made.append(([], [], 0, Counter(), ""))
            continue
        a, b = sides_of(text, libraries)
        owner_a, owner_b = (np.repeat(np.arange(len(s)), [len(x) for _, x in s]) for s in (a, b))
        links = sorted(set(zip(owner_a.tolist(), owner_b.tolist())))
        pairs = Counter((a[i][0], b[j][0]) for i, j in links)
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            last = np.searchsorted(owner_a, i, "right") == np.searchsorted(owner_b, j, "right")
            if last:
                groups.append(",".join(str(x) for x, _ in a[i0:i + 1]) + "|" + ",".join(str(x) for x, _ in b[j0:j + 1]))
                i0, j0 = i + 1, j + 1
        held.update(pairs.keys())
        made.append((a, b, len(groups), pairs, ";".join(groups)))
    highest = Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(len(a), len(b), n, sum(p.values()), sum(t for k, t in p.items() if held[k] == highest[k[0]]),
             sum(t * held[k] for k, t in p.items()), hashlib.sha256(g.encode()).hexdigest() if a else "") for a, b, n, p, g in made]


def sides_of(text, libraries):
    import public_tokenizers
    byte_level, pieces = libraries
    table = sides.byte_level(public_tokenizers.path("byte_bpe_50k.json")).pieces
    a = [(i, table[i]) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
         for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode() else ([], [])


def test_groups_come_along(spark, both):
    docs = spark.createDataFrame([(1, "aligned tokens overlap"), (2, None), (None, "x")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, both, groups=True).collect()}
    one = rows[1]
    assert sum(one.a_sizes) == one.n_a == len(one.a_ids) and sum(one.b_sizes) == one.n_b and len(one.a_sizes) == one.n_groups
    assert rows[2].a_ids == [] and rows[None].n_a > 0


def test_an_empty_table_gives_none(spark, both):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(empty, both).count() == 0


def test_no_piece_is_looked_up_for_every_token(spark, libraries, both):
    texts = ["aligned tokens overlap", "x ▁", "naïve\ttabs  and spaces ", None]

    def sealed():
        class Sealed(list):
            def __getitem__(self, i):
                raise AssertionError("one by one")

        return tuple(alignment.Side(s.encode, Sealed(s.pieces)) for s in both())

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, sealed).collect()}
    for i, w in enumerate(brute(texts, libraries)):
        assert tuple(rows[i][c] for c in COLUMNS) == w


def test_steps_on_arrays_equal_plain_ones():
    rng, pieces = np.random.default_rng(1), [b"", b"a", b"bc", "é".encode(), b"\0def"]
    spelling = alignment.Spelling(alignment.Side(None, pieces))
    for _ in range(200):
        ids = rng.integers(0, len(pieces), rng.integers(0, 9))
        data = b"".join(pieces[i] for i in ids)
        assert spelling.spells(ids, data) and not spelling.spells(ids, data + b"a")
        assert not data or not spelling.spells(ids, bytes([data[0] ^ 1]) + data[1:])
    for _ in range(200):
        ends = [np.sort(rng.choice(np.arange(1, 20), rng.integers(1, 15))) for _ in range(2)]
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        for at, own in zip(alignment.slices(*ends), ends):
            assert at.tolist() == [int((own <= e).sum()) for e in common]
        union = sorted({*ends[0].tolist(), *ends[1].tolist()})
        for at, own in zip(alignment.links(*ends), ends):
            assert at.tolist() == [int((own < e).sum()) for e in union]
