import zlib

import numpy as np

from regiometra.llm import convnet
from regiometra.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow_probability(net, text):
    """Position by position, chunk by chunk, without slabs or batches."""
    blocks = (len(text) + convnet.LAGS + 8) // convnet.BLOCK + 1
    codes = []
    padded = text.ljust(blocks * convnet.BLOCK, b"\0")
    for i in range(blocks * convnet.BLOCK):
        eight = (padded + bytes(8))[i:i + 8]
        again = any(i >= lag and (padded + bytes(8))[i - lag:i - lag + 8] == eight for lag in range(1, convnet.LAGS + 1))
        codes.append(padded[i] + 256 * again if i < len(text) else convnet.PAD)
    codes += [convnet.PAD] * convnet.WIDTH
    x = net.embedding[np.array(codes)]
    response = []
    for at in range(0, blocks * convnet.BLOCK, convnet.STEP):
        window = x[at:at + convnet.WIDTH].reshape(convnet.TAPS, -1)
        response.append(np.maximum(sum(window[t] @ net.filters[t] for t in range(convnet.TAPS)) + net.offset, 0))
    response = np.array(response)
    per = convnet.BLOCK // convnet.STEP
    chunks = np.array([response[b * per:(b + 2) * per].max(axis=0) for b in range(blocks)])
    z = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]) @ net.combine + net.bias[0]
    return 1 / (1 + np.exp(-z))


def test_batches_and_slabs_equal_one_by_one(monkeypatch):
    net = convnet.new_network(3, 4, 5)
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"the the the the the", bytes(rng.integers(32, 120, 700, dtype=np.uint8)), b"ab " * 400, "é".encode() * 131]
    want = [slow_probability(net, t) for t in texts]
    assert np.allclose(convnet.probability(net, texts), want, atol=1e-5)
    monkeypatch.setattr(convnet, "SLAB", 2 * convnet.BLOCK)
    assert np.allclose(convnet.probability(net, texts), want, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_byte_convnet_quality"](spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(rows[k].score, q) for k, q in marks.items() if k in rows and rows[k].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.92


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 300_000, 0.5), (3, "x" * 300_000, 0.5), (None, "y", None)],
                                 "doc_id bigint, text string, score double")
    marks = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (3, None), (9, 1), (None, 1)], "doc_id bigint, quality int")
    texts, labels = convnet.labelled_sample(docs.where("text is not null"), marks, "quality", 5, 1 << 20)
    assert labels.tolist() == [1] and len(texts[0]) == 300_000
    assert convnet.labelled_sample(docs, marks.limit(0), "quality", 5, 10)[0] == []
    scored = convnet.score(docs, convnet.train([], np.zeros(0))).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert convnet.score(docs.limit(0), convnet.new_network(1)).count() == 0


def test_sample_takes_the_least_text_of_a_repeated_key(spark):
    rows = [(1, t) for t in ["b", "a", "c" * 99, None] + ["d"] * 50] + [(2, "z")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string")
        texts, y = convnet.labelled_sample(docs, labels, "quality", 5, 10)
        assert texts == [b"a", b"z"] and y.tolist() == [1, 0]


def test_sample_of_a_long_text_covers_it_from_start_to_end(spark):
    text = "".join(chr(97 + i // 100) for i in range(2000))
    docs = spark.createDataFrame([(1, text), (2, "s" * 80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    texts, y = convnet.labelled_sample(docs, labels, "quality", 5, 80)
    at = [(2000 - 10) * i // 7 for i in range(8)]
    assert texts == ["".join(text[a:a + 10] for a in at).encode(), b"s" * 80] and y.tolist() == [1, 0]
