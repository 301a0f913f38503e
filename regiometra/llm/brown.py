"""Brown class-based bigram scores: classes by exchange, transitions between classes, emissions of words.

Words are runs of non-space bytes in lower case, with one end after each document. Every training word is in one of
``CLASSES`` classes; the end is a class of its own and stands before every document. The probability of a token is
that of its class after the last one's, times that of the word in its class. Transitions are smoothed towards class
frequencies; emissions give up ``DISCOUNT`` of every count to one unknown word per class. An unknown token takes
the class that makes it likeliest after the last.

Exchange works on all words at once: with all other words fixed, each moves to the class with the largest likelihood
of its neighbours' classes and of itself (several machines can do that, word by word exchange cannot be split). The
most frequent words start as classes of their own and the others in the class of their commonest neighbour of those.

Documents are coded once into blocks of word numbers. Blocks ask the parts of the vocabulary for counts and classes
of their own words only, so no table of all words is ever in one place. Words are known by 64-bit hashes.

A null text is empty and has the end alone. An empty table, or one without training rows, gives scores from smoothing
alone. Repeated rows count each time they occur; they are coded once, with their number as weight. Null keys are scored as any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.llm.repeats import _BYTE_HASH, _spans_hash, mixed, word_spans
from regiometra.session import new_folder, stage

CLASSES, ROUNDS, DISCOUNT, PRIOR = 64, 2, 0.5, 8.0
BLOCK_BYTES = 16 << 20
#: The end's hash, its class, and the class of words without a frequent neighbour.
END, END_CLASS, OTHER_CLASS = np.uint64(0x5EED), 0, CLASSES - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Block:
    """Coded documents: tokens as places in ``words`` (by falling count), each document closed by the end.

    ``weight`` tells how many rows a document stands for.
    """

    words: np.ndarray
    tokens: np.ndarray
    ends: np.ndarray
    held: np.ndarray
    weight: np.ndarray

    def training(self) -> np.ndarray:
        return ~np.repeat(self.held, np.diff(self.ends, prepend=0))

    def weights(self) -> np.ndarray | None:
        """The weight of every training token; none if all documents stand for one row."""
        learn = ~self.held
        return None if (self.weight == 1).all() else np.repeat(self.weight[learn], np.diff(self.ends, prepend=0)[learn])


def code(texts: list[bytes], held: np.ndarray, weight: np.ndarray | None = None) -> Block:
    """A block of documents, tokenised slab by slab."""
    weight = np.ones(len(texts), np.int64) if weight is None else weight
    found, sizes, start, size = [], np.zeros(len(texts), np.int64), 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > 1 << 20 or i + 1 == len(texts):
            part = texts[start:i + 1]
            data = _LOWER[np.frombuffer(b" ".join(part), np.uint8)]
            first, last = word_spans(data)
            owner = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), first, "right")
            counts = np.bincount(owner, minlength=len(part))
            values = np.insert(_spans_hash(_BYTE_HASH[data], first, last), np.cumsum(counts), END)
            found.append(values)
            sizes[start:i + 1] = counts + 1
            start, size = i + 1, 0
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    words, tokens, times = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    return Block(words[order], rank[tokens.ravel()], np.cumsum(sizes), held, weight)


def neighbours(block: Block, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before and class after every token; documents begin and end at the end."""
    own = classes[block.tokens]
    before = np.concatenate([[END_CLASS], own[:-1]])
    after = np.concatenate([own[1:], [END_CLASS]])
    return before, after


def better(contexts: np.ndarray, counts: np.ndarray, classes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The class of largest likelihood for every word; ``contexts`` counts classes before and after it.

    ``moves`` are the class bigram counts now. Ties go to the smaller class; the end's class takes no other word.
    """
    smooth = moves + 0.1
    total = smooth.sum(axis=1)
    after = np.log(smooth / total[:, None])  # of the next class, by own class
    before = np.log(smooth / total[None, :])  # of own class given the last, over its frequency
    gain = contexts[:, CLASSES:] @ after.T + contexts[:, :CLASSES] @ (before - np.log(total)[:, None])
    gain[:, END_CLASS] = -np.inf
    best = gain.argmax(axis=1).astype(np.uint8)
    return np.where(classes == END_CLASS, classes, best)


def log_tables(moves: np.ndarray, sizes: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 transition table, log10 class sizes, and log10 probability of the unknown word in each class."""
    share = (sizes + 0.1) / (sizes + 0.1).sum()
    transition = np.log10((moves + PRIOR * share) / (moves.sum(axis=1, keepdims=True) + PRIOR))
    total = np.maximum(sizes, 1.0)
    return transition, np.log10(total), np.log10(np.maximum(DISCOUNT * types, DISCOUNT) / np.maximum(total, DISCOUNT + 0.5))


def score_block(block: Block, counts: np.ndarray, classes: np.ndarray, tables: tuple) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, and log10 probability of every document of a block."""
    transition, size, unknown = tables
    known = counts[block.tokens] > 0
    own = classes[block.tokens].astype(np.int64)
    start = np.concatenate([[0], block.ends[:-1]])
    guess = (transition + unknown[None, :]).argmax(axis=1)
    todo = np.flatnonzero(~known)
    own[todo] = -1
    while len(todo):  # one step along every run of unknown tokens
        last = np.where(todo > 0, own[todo - 1], END_CLASS)
        ready = last >= 0
        own[todo[ready]] = guess[last[ready]]
        todo = todo[~ready]
    last = np.concatenate([[END_CLASS], own[:-1]])
    emission = np.where(known, np.log10(np.maximum(counts[block.tokens] - DISCOUNT, DISCOUNT)) - size[own], unknown[own])
    each = transition[last, own] + emission
    return (np.diff(block.ends, prepend=0), np.add.reduceat(known.astype(np.int64), start), np.add.reduceat(each, start))


def _opened(frame: pd.DataFrame) -> Block:
    row = frame.iloc[0]
    return Block(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], np.uint32),
                 np.frombuffer(row["ends"], np.int64), np.frombuffer(row["held"], bool), np.frombuffer(row["weights"], np.int64))


class Vocabulary:
    """How words are dealt to parts; every block orders its words in the same way."""

    def __init__(self, blocks: int):
        self.shift = np.uint64(64 - min(20, max(3, (4 * blocks - 1).bit_length())))

    def order(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        part = (mixed(words) >> self.shift).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, first = np.unique(part[order], return_index=True)
        edges = [*first.tolist(), len(words)]
        return order, [(int(p), slice(a, b)) for p, a, b in zip(names, edges, edges[1:])]

    def answers(self, words: np.ndarray, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes of a block's words from the parts' replies."""
        order, _ = self.order(words)
        replies = replies.sort_values("part")
        counts, classes = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
        counts[order] = np.frombuffer(b"".join(replies["counts"]), np.int64)
        classes[order] = np.frombuffer(b"".join(replies["classes"]), np.uint8)
        return counts, classes


_BLOCKS = "block int, words binary, tokens binary, ends binary, held binary, weights binary, keys array<bigint>"
_WORDS = "part bigint, words binary, counts binary, classes binary"


def _store(docs: DataFrame, key: str, text: str, held: Column) -> tuple[DataFrame, int]:
    """Coded documents in the shared folder, bucketed by block, equal rows as one with a weight; and the number of blocks."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), data.alias("data"), F.coalesce(held, F.lit(False)).alias("held"))
    total, count = rows.agg(F.sum(F.octet_length("data")), F.count("*")).first()
    blocks = max(6, math.ceil((total or 0) / BLOCK_BYTES))
    # Equal rows are added up before they are dealt, so they meet in no task.
    rows = rows.groupBy("key", "held", F.xxhash64("data").alias("th")).agg(F.first("data").alias("data"), F.count("*").alias("weight"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "key", "th"), F.lit(blocks)).cast("int"))

    def coded(frame: pd.DataFrame) -> pd.DataFrame:
        block = code(list(frame["data"]), frame["held"].to_numpy(bool), frame["weight"].to_numpy(np.int64))
        keys = [None if pd.isna(k) else int(k) for k in frame["key"]]
        return pd.DataFrame([(int(frame["block"].iloc[0]), block.words.tobytes(), block.tokens.tobytes(), block.ends.tobytes(),
                              block.held.tobytes(), block.weight.tobytes(), keys)],
                            columns=["block", "words", "tokens", "ends", "held", "weights", "keys"])

    name, folder = f"brown_{new_folder(spark, '')[-32:]}", new_folder(spark, "blocks")
    (dealt.groupBy("block").applyInPandas(coded, _BLOCKS).write.option("path", folder).option("compression", "zstd")
     .bucketBy(blocks, "block").saveAsTable(name))
    return spark.table(name), blocks


def lm_scores(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows where ``held`` is true are scored but not learned from. ``base_score`` is that of single words with 0.1
    added to every count and to one unknown word.
    """
    blocks, n = _store(docs, key, text, held)
    deal = Vocabulary(n)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        block = _opened(frame)
        times = np.bincount(block.tokens[block.training()], block.weights(), minlength=len(block.words)).astype(np.int64)
        order, parts = deal.order(block.words)
        rows = [(p, int(frame["block"].iloc[0]), block.words[order[s]].tobytes(), times[order[s]].tobytes()) for p, s in parts]
        return pd.DataFrame(rows, columns=["part", "block", "words", "times"])

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(frame["words"]), np.uint64)
        distinct, inverse = np.unique(words, return_inverse=True)
        counts = np.bincount(inverse, np.frombuffer(b"".join(frame["times"]), np.int64), len(distinct)).astype(np.int64)
        classes = np.where(distinct == END, END_CLASS, OTHER_CLASS).astype(np.uint8)
        return pd.DataFrame([(int(frame["part"].iloc[0]), distinct.tobytes(), counts.tobytes(), classes.tobytes())],
                            columns=["part", "words", "counts", "classes"])

    def most_frequent(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(frame["counts"].iloc[0], np.int64)
        words = np.frombuffer(frame["words"].iloc[0], np.uint64)
        top = np.lexsort((words, -counts))[:CLASSES]
        return pd.DataFrame({"word": words[top].view(np.int64), "n": counts[top]})

    asks = stage(blocks.groupBy("block").applyInPandas(ask, "part bigint, block int, words binary, times binary"), "asks")
    words = stage(asks.groupBy("part").applyInPandas(add_up, _WORDS), "words")
    top = (words.groupBy("part").applyInPandas(most_frequent, "word bigint, n bigint")
           .where("n > 0").orderBy(F.desc("n"), "word").limit(CLASSES - 1).collect())
    leaders = np.array([r.word for r in top], np.int64).view(np.uint64)
    leaders = leaders[leaders != END][:CLASSES - 2]

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(frame["words"].iloc[0], np.uint64)
        classes = np.frombuffer(frame["classes"].iloc[0], np.uint8).copy()
        for c, leader in enumerate(leaders, 1):
            classes[own == leader] = c
        return frame.assign(classes=[classes.tobytes()])

    def reply(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame([], columns=["block", "part", "counts", "classes"])
        row = known.iloc[0]
        own, counts, classes = (np.frombuffer(row[c], t) for c, t in (("words", np.uint64), ("counts", np.int64), ("classes", np.uint8)))
        at = [np.searchsorted(own, np.frombuffer(w, np.uint64)) for w in asked["words"]]
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "counts": [counts[i].tobytes() for i in at],
                             "classes": [classes[i].tobytes() for i in at]})

    def tagged(known: DataFrame, function, schema: str) -> DataFrame:
        replies = asks.select("part", "block", "words").groupBy("part").cogroup(known.groupBy("part")).applyInPandas(
            reply, "block int, part bigint, counts binary, classes binary")
        return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(function, schema)

    def count_moves(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = _opened(frame)
        _, classes = deal.answers(block.words, replies)
        before, _ = neighbours(block, classes)
        own = classes[block.tokens]
        learn = block.training()
        moves = np.bincount(before[learn].astype(np.int64) * CLASSES + own[learn], block.weights(), minlength=CLASSES * CLASSES)
        moves = moves.astype(np.int64)
        some = np.flatnonzero(moves)
        return pd.DataFrame({"move": some, "n": moves[some]})

    def moves_of(known: DataFrame) -> np.ndarray:
        out = np.zeros(CLASSES * CLASSES)
        for r in tagged(known, count_moves, "move bigint, n bigint").groupBy("move").agg(F.sum("n").alias("n")).collect():
            out[r.move] = r.n
        return out.reshape(CLASSES, CLASSES)

    def send_contexts(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = _opened(frame)
        _, classes = deal.answers(block.words, replies)
        before, after = neighbours(block, classes)
        learn = block.training()
        word = block.tokens[learn].astype(np.int64) * (2 * CLASSES)
        keys, weights = np.concatenate([word + before[learn], word + CLASSES + after[learn]]), block.weights()
        if weights is None:
            keys, times = np.unique(keys, return_counts=True)
        else:
            keys, inverse = np.unique(keys, return_inverse=True)
            times = np.bincount(inverse.ravel(), np.tile(weights, 2), len(keys))
        width = np.uint32 if times.max(initial=0) < 1 << 32 else np.uint64
        place, context = keys // (2 * CLASSES), (keys % (2 * CLASSES)).astype(np.uint8)
        order, parts = deal.order(block.words)
        first, last = np.searchsorted(place, np.arange(len(block.words))), np.searchsorted(place, np.arange(len(block.words)), "right")
        rows = []
        for p, s in parts:
            chosen = order[s]
            sizes = last[chosen] - first[chosen]
            chosen, sizes = chosen[sizes > 0], sizes[sizes > 0]
            take = np.repeat(first[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            rows.append((p, block.words[chosen].tobytes(), sizes.astype(np.uint8).tobytes(), context[take].tobytes(),
                         times[take].astype(width).tobytes()))
        return pd.DataFrame(rows, columns=["part", "words", "sizes", "contexts", "times"])

    def move_words(moves: np.ndarray | None):
        def run(sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(known):
                return pd.DataFrame([], columns=["part", "words", "counts", "classes"])
            row = known.iloc[0]
            own, classes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["classes"], np.uint8)
            counts = np.frombuffer(row["counts"], np.int64)
            at = np.searchsorted(own, np.frombuffer(b"".join(sent["words"]), np.uint64))
            sizes = np.frombuffer(b"".join(sent["sizes"]), np.uint8).astype(np.int64)
            context = np.frombuffer(b"".join(sent["contexts"]), np.uint8)
            times = np.concatenate([np.zeros(0), *(np.frombuffer(t, np.uint32 if len(t) == 4 * len(c) else np.uint64)
                                                   for t, c in zip(sent["times"], sent["contexts"]))])
            target = np.repeat(at, sizes) * (2 * CLASSES) + context
            out = np.empty(len(own), np.uint8)
            order = np.argsort(target, kind="stable")
            target, times = target[order], times[order]
            for a in range(0, len(own), 1 << 16):
                b = min(len(own), a + (1 << 16))
                lo, hi = np.searchsorted(target, [a * 2 * CLASSES, b * 2 * CLASSES])
                near = np.bincount(target[lo:hi] - a * 2 * CLASSES, times[lo:hi], (b - a) * 2 * CLASSES).reshape(b - a, -1)
                if moves is None:  # the commonest frequent neighbour on either side names the first class
                    both = near[:, :CLASSES] + near[:, CLASSES:]
                    both[:, [END_CLASS, OTHER_CLASS]] = 0
                    guess = np.where(both.max(axis=1) > 0, both.argmax(axis=1), OTHER_CLASS)
                    out[a:b] = np.where(classes[a:b] == OTHER_CLASS, guess, classes[a:b])
                else:
                    out[a:b] = better(near, counts[a:b], classes[a:b], moves)
            return pd.DataFrame([(int(row["part"]), row["words"], row["counts"], out.tobytes())], columns=["part", "words", "counts", "classes"])
        return run

    words = stage(words.groupBy("part").applyInPandas(lead, _WORDS), "words")
    for i in range(rounds + 1):
        moves = moves_of(words) if i else None
        sent = tagged(words, send_contexts, "part bigint, words binary, sizes binary, contexts binary, times binary")
        words = stage(sent.groupBy("part").cogroup(words.groupBy("part")).applyInPandas(move_words(moves), _WORDS), "words")

    def class_sizes(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(frame["counts"].iloc[0], np.int64)
        classes = np.frombuffer(frame["classes"].iloc[0], np.uint8)
        return pd.DataFrame({"c": np.arange(CLASSES), "n": np.bincount(classes, counts, CLASSES).astype(np.int64),
                             "v": np.bincount(classes[counts > 0], minlength=CLASSES)})

    sizes, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("part").applyInPandas(class_sizes, "c int, n bigint, v bigint").groupBy("c").agg(
            F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sizes[r.c], types[r.c] = r.n, r.v
    tables = log_tables(moves_of(words), sizes, types)
    total, distinct = int(sizes.sum()), int(types.sum())

    def finish(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "weight"]
        if not len(frame):
            return pd.DataFrame([], columns=columns)
        block = _opened(frame)
        counts, classes = deal.answers(block.words, replies)
        tokens, known, score = score_block(block, counts, classes, tables)
        each = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))[block.tokens]
        base = np.add.reduceat(each, np.concatenate([[0], block.ends[:-1]]))
        return pd.DataFrame({"key": pd.array(list(frame["keys"].iloc[0]), "Int64"), "held_out": block.held, "n_tokens": tokens,
                             "n_known": known, "train_tokens": total, "base_score": base, "score": score, "weight": block.weight}, columns=columns)

    scored = tagged(words, finish, "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                   "base_score double, score double, weight bigint")
    # A row of large weight comes back in two steps, so that no list of numbers is long.
    scored = scored.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(weight - 1) div 1000"))))
    scored = scored.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("least(1000, weight - 1000 * __k)"))))
    return scored.drop("weight", "__k", "__n").withColumnRenamed("key", key)
