"""A byte-level convolutional network in numpy that scores document quality.

A document is its UTF-8 bytes. Each byte has a symbol: its value, and whether the eight bytes from it on occurred up
to ``LAGS`` bytes earlier. Symbols are embedded, learned filters of ``WIDTH`` bytes run over the whole document every
``STEP`` bytes, and their largest responses are pooled over chunks of two blocks that overlap by one. The maximum and
the mean over chunks of every filter are combined into one probability.

Null and empty texts are one chunk of padding and get a score too. Texts of any length are scored in slabs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, TAPS, BLOCK = 4, 3, 256
WIDTH, LAGS, PAD = STEP * TAPS, 40, 512
#: Bytes convolved at once.
SLAB = 1 << 20
#: Windows of a text that is too long to fit on as a whole.
SAMPLE_WINDOWS = 8


@dataclass
class Network:
    """Embedding of symbols, filters, and the weights of the pooled maxima and means."""

    embedding: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    combine: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offset, self.combine, self.bias]


def new_network(seed: int, channels: int = 6, filters: int = 24) -> Network:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.5, (PAD + 1, channels)).astype(np.float32)
    embedding[PAD] = 0
    shape = (TAPS, STEP * channels, filters)
    return Network(embedding, rng.normal(0, (2 / (WIDTH * channels)) ** 0.5, shape).astype(np.float32),
                   np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), np.zeros(1, np.float32))


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, each padded to whole blocks, and the blocks of each."""
    blocks = np.array([(len(t) + LAGS + 8) // BLOCK + 1 for t in texts])
    raw = np.frombuffer(b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks.tolist())), np.uint8)
    eight = np.zeros(len(raw), np.uint64)
    for i in range(8):
        eight[:len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(8 * i)
    again = np.zeros(len(raw), bool)
    for lag in range(1, LAGS + 1):
        again[lag:] |= eight[lag:] == eight[:-lag]
    out = raw.astype(np.int16) + 256 * again.astype(np.int16)
    starts = (np.cumsum(blocks) - blocks) * BLOCK
    for start, n, t in zip(starts.tolist(), blocks.tolist(), texts):
        out[start + len(t):start + n * BLOCK] = PAD
    return out, blocks


def _inputs(net: Network, codes: np.ndarray) -> np.ndarray:
    """Embedded symbols by step, with the taps past the end padded."""
    whole = np.concatenate([codes, np.full((TAPS - 1) * STEP, PAD, codes.dtype)])
    return net.embedding[whole].reshape(len(whole) // STEP, -1)


def _last_blocks(blocks: np.ndarray) -> np.ndarray:
    last = np.zeros(blocks.sum(), bool)
    last[np.cumsum(blocks) - 1] = True
    return last


def _responses(net: Network, x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Responses by block and step. Windows that reach past a document's padding are off; others see only padding there."""
    n = len(x) - TAPS + 1
    out = sum(x[t:t + n] @ net.filters[t] for t in range(TAPS)) + net.offset
    out = np.maximum(out, 0, out=out).reshape(-1, BLOCK // STEP, out.shape[1])
    out[last, 1 - TAPS:] = 0
    return out


def block_peaks(net: Network, codes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Largest response of every filter in every block, slab by slab."""
    found, halo, last = [], (TAPS - 1) * STEP, _last_blocks(blocks)
    for at in range(0, len(codes), SLAB):
        x = _inputs(net, codes[at:at + SLAB + halo])[:min(SLAB, len(codes) - at) // STEP + TAPS - 1]
        found.append(_responses(net, x, last[at // BLOCK:(at + SLAB) // BLOCK]).max(axis=1))
    return np.concatenate(found)


def pooled(peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum and mean over chunks per document, and which of its two blocks each chunk's peak is in."""
    starts = np.cumsum(blocks) - blocks
    following = np.where(_last_blocks(blocks)[:, None], -1, np.concatenate([peaks[1:], peaks[:1]]))
    second = following > peaks
    chunks = np.where(second, following, peaks)
    mean = np.add.reduceat(chunks, starts) / blocks[:, None]
    return np.concatenate([np.maximum.reduceat(peaks, starts), mean], axis=1), starts, second


def probability(net: Network, texts: list[bytes]) -> np.ndarray:
    codes, blocks = symbols(texts)
    features, _, _ = pooled(block_peaks(net, codes, blocks), blocks)
    return 1 / (1 + np.exp(-(features.astype(np.float64) @ net.combine + net.bias[0])))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    codes, blocks = symbols(texts)
    x = _inputs(net, codes)
    responses = _responses(net, x, _last_blocks(blocks))
    where, peaks = responses.argmax(axis=1), responses.max(axis=1)
    features, starts, second = pooled(peaks, blocks)
    n_filters, owner = peaks.shape[1], np.repeat(np.arange(len(blocks)), blocks)
    p = 1 / (1 + np.exp(-(features @ net.combine + net.bias[0])))
    error = ((p - labels) * weights).astype(np.float32)
    back = error[:, None] * net.combine
    chunk = np.repeat(back[:, n_filters:] / blocks[:, None], blocks, axis=0)
    grad = np.where(second, 0, chunk)
    grad[1:] += np.where(second[:-1], chunk[:-1], 0)
    top = peaks == features[owner, :n_filters]
    grad += top * back[owner, :n_filters] / np.maximum(np.add.reduceat(top.astype(np.float32), starts), 1)[owner]
    grad = np.where(peaks > 0, grad, 0)
    block, column = np.nonzero(grad)
    g = grad[block, column].astype(np.float32)
    at = block * (BLOCK // STEP) + where[block, column]
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    whole = np.concatenate([codes, np.full((TAPS - 1) * STEP, PAD, codes.dtype)])
    for t in range(TAPS):
        rows = x[at + t] * g[:, None]
        for f in range(n_filters):
            d_filters[t, :, f] = rows[column == f].sum(axis=0)
        back_x = (net.filters[t].T[column] * g[:, None]).reshape(len(g), STEP, -1)
        codes_at = whole[((at + t) * STEP)[:, None] + np.arange(STEP)]
        for c in range(net.embedding.shape[1]):
            d_embedding[:, c] += np.bincount(codes_at.ravel(), back_x[:, :, c].ravel(), PAD + 1)
    d_embedding[PAD] = 0
    return [d_embedding, d_filters, np.bincount(column, g, n_filters).astype(np.float32), error @ features,
            np.array([error.sum()], np.float32)]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5, epochs: int = 8, batch: int = 32,
          rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Fits by Adam on balanced classes; without any label the network stays as it was drawn."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.05, 0.95)
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            picked = order[at:at + batch]
            grads = _gradients(net, [texts[i] for i in picked], labels[picked], weights[picked] / len(picked))
            step += 1
            pace = rate * (1 - 0.9 * step / steps)
            for part, grad, m, v in zip(net.parts(), grads, first, second):
                grad = grad + decay * part
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net.embedding[PAD] = 0
    return net


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """``key`` and the probability of every whole text."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, held = [], [], 0
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                texts.append(data)
                held += len(data) + BLOCK
                if held > SLAB:
                    scores.append(probability(shared.value, texts))
                    texts, held = [], 0
            if texts:
                scores.append(probability(shared.value, texts))
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["key", "score"])

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, f"key {kind}, score double").select(F.col("key").alias(key), F.col("score").alias(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, longest: int,
                    key: str = "doc_id", text: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels to train on: at most ``rows_per_class`` of each class by hash of the key.

    Of a text of more than ``longest`` bytes, windows spread evenly from its start to its end make up that many (scoring
    reads it whole), which bounds the sample. Unlabelled and contradictory keys are not used; a key counts once, with its least text.
    """
    agreed = (labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("k"))
              .agg(F.min(f"`{label}`").alias("y"), F.max(f"`{label}`").alias("z")).where("y = z AND k IS NOT NULL"))
    chosen = [r for y in (0, 1) for r in agreed.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows_per_class).collect()]
    if not chosen:
        return [], np.zeros(0)
    picked = docs.sparkSession.createDataFrame([(r.k, int(r.y)) for r in chosen], "k bigint, y int")
    least = (docs.join(F.broadcast(picked), F.col(f"`{key}`") == F.col("k"))  # at most two classes of that many rows
             .where(F.col(f"`{text}`").isNotNull()).groupBy("k", "y").agg(F.min(f"`{text}`").cast("binary").alias("t")))
    size, part = F.octet_length("t"), longest // SAMPLE_WINDOWS
    windows = [F.substring("t", (F.floor((size - part) * i / (SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(part)) for i in range(SAMPLE_WINDOWS)]
    rows = least.select("k", "y", F.when(size <= longest, F.col("t")).otherwise(F.concat(*windows)).alias("t")).collect()
    once = sorted(rows, key=lambda r: r.k)
    return [bytes(r.t) for r in once], np.array([r.y for r in once])
