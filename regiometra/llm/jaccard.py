"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of word n-grams; documents of equal sets are one representative with a multiplicity. MinHash
values in bands give candidates. A candidate pair's values are compared a few at a time; it is dropped once the
posterior probability that its similarity reaches the threshold is below a tolerance. Survivors connect
representatives into components, inside of which every pair is verified exactly on whole n-gram sets. Classes are the
components of verified links; link counts include copies.

Bands of ``ROWS`` values miss a pair at the threshold 0.8 with probability (1 - 0.8^4)^24 = 3e-6, and less above it.
Large band groups and components are split into blocks, and pairs of blocks are tasks of their own; no pair of
documents ever becomes a row, only links that connect and counts do.

A null text is empty. A text with fewer than ``n`` words is one n-gram of all its words; without a word it is linked
to nothing. Null ids take part and sort last. Repeated rows are copies of one another. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.llm.memory import batches_giving_back
from regiometra.llm.components import components
from regiometra.llm.repeats import _BYTE_HASH, NO_ID, _spans_hash, mixed, run_hashes, word_spans
from regiometra.session import stage

ROWS, BANDS = 4, 24
#: Values compared by the posterior, one byte of each, so many at a time.
COMPARED, STEP = 64, 16
#: Representatives in a block, of band groups and of components.
BAND_BLOCK, VERIFY_BLOCK = 4_096, 512
_SLAB = 1 << 20


def _families(count: int) -> np.ndarray:
    return np.random.default_rng(2_024).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts one after another, sorted within each, and how many each has."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(data)
    words = _spans_hash(_BYTE_HASH[data], starts, ends)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    counts = np.bincount(owner, minlength=len(texts))
    grams = run_hashes(words, n)
    whole = owner[:len(grams)] == owner[n - 1:] if len(grams) else np.zeros(0, bool)
    values, where = grams[whole], owner[:len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        own = _spans_hash(words, first[short], first[short] + counts[short])
        values, where = np.concatenate([values, own]), np.concatenate([where, short])
    order = np.lexsort((values, where))
    values, where = values[order], where[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (where[1:] != where[:-1])]) if len(values) else np.zeros(0, bool)
    return values[new], np.bincount(where[new], minlength=len(texts))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 STEP, … compared bytes: the fewest matches whose posterior, from a uniform prior, is tolerable.

    After m matches of n the similarity is Beta(m + 1, n - m + 1), which exceeds t with the probability that
    n + 1 draws at t give at most m. Bytes of different values agree by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two tables of bytes may still reach the threshold; later bytes are read for survivors only."""
    alive = np.arange(max(len(left), len(right)))
    matches = np.zeros(len(alive), np.int16)
    for k, fewest in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        a = left[alive, part] if len(left) > 1 or len(right) == 1 else left[:, part]
        matches = matches + (a == right[alive, part]).sum(axis=1, dtype=np.int16)
        good = matches >= fewest
        alive, matches = alive[good], matches[good]
    return alive


def _by_document(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(data).alias("th"), data.cast("binary").alias("data"))


def _slabs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        start, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(column)):
            texts.append(value.as_py())
            held += len(texts[-1])
            if held > _SLAB or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []


def signatures(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, th, fa, fb, size, values``: set fingerprint, number of n-grams and MinHash values of every row."""
    families = _families(ROWS * BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slabs(batches, 2):
            grams, sizes = shingle_sets(texts, n)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            fa, fb = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            values = np.zeros((len(texts), len(families)), np.uint32)
            if len(some):
                fa[some] = np.add.reduceat(mixed(grams), starts)
                fb[some] = np.add.reduceat(mixed(grams + np.uint64(1)), starts)
                for f, family in enumerate(families):
                    values[some, f] = np.minimum.reduceat((grams * family >> np.uint64(32)).astype(np.uint32), starts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)),
                 pa.array(sizes.astype(np.int64)), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["id", "th", "fa", "fb", "size", "values"])

    return _by_document(docs, key, text).mapInArrow(batches_giving_back(run), "id bigint, th bigint, fa bigint, fb bigint, size bigint, values binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``keys``, several at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        edge = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
        if edge:
            yield pd.concat([*held, batch.iloc[:edge]], ignore_index=True)
            held = [batch.iloc[edge:]]
        elif held and (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _block_pairs(df: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Members of each group with the pairs of blocks they belong to; a small group is one pair."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).where("__n > 1")
    dealt = df.join(sizes, group).withColumn("__k", F.ceil(F.col("__n") / size).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(member), F.col("__k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    dealt = dealt.withColumn("other", other)
    return (dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
            .drop("__n", "__k", "other"))


def _connect(rows: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Edges from members to the first of their component; ``linked(i)`` gives the members after i linked to i."""
    label = np.arange(len(rows))
    for i in range(len(rows)):
        partners = linked(i)
        if len(partners):
            joined = np.unique(label[partners])
            joined = joined[joined != label[i]]
            if len(joined):
                both = np.concatenate([joined, label[i:i + 1]])
                label[np.isin(label, both)] = both.min()
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return rows[moved], rows[label[moved]]


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``a, b``: edges that connect representatives with every partner the posterior leaves."""
    least = least_matches(threshold, tolerance)
    values = F.col("values")
    keys = [F.xxhash64(F.lit(b), F.substring(values, 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    bands = reps.select("rid", F.explode(F.array(*keys)).alias("band"))
    pairs = _block_pairs(bands, "band", "rid", BAND_BLOCK).join(reps.select("rid", "values"), "rid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(batches, ["band", "lo", "hi"]):
            table = np.frombuffer(b"".join(frame["values"]), np.uint8).reshape(len(frame), -1)[:, ::4][:, :COMPARED]
            rid, block = frame["rid"].to_numpy(), frame["block"].to_numpy()
            diagonal = (frame["lo"] == frame["hi"]).to_numpy()
            group = frame[["band", "lo", "hi"]].ne(frame[["band", "lo", "hi"]].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(group)
            sizes = np.diff(np.append(starts, len(frame)))
            found = []
            for m in range(2, 9):  # small groups: their pairs side by side
                chosen = starts[(sizes == m) & diagonal[starts]]
                i, j = np.triu_indices(m, 1)
                a, b = (chosen[:, None] + i).ravel(), (chosen[:, None] + j).ravel()
                alive = survivors(table[a], table[b], least) if len(a) else np.zeros(0, np.int64)
                found.append((rid[a[alive]], rid[b[alive]]))
            for start, m in zip(starts.tolist(), sizes.tolist()):
                if m < 2 or m <= 8 and diagonal[start]:
                    continue
                own, bits, side = rid[start:start + m], table[start:start + m], block[start:start + m]
                inside = bool(diagonal[start])

                def linked(i: int) -> np.ndarray:
                    later = np.arange(i + 1, m) if inside else i + 1 + np.flatnonzero(side[i + 1:] != side[i])
                    if not len(later):
                        return later
                    return later[survivors(bits[i:i + 1], bits[later], least)]

                found.append(_connect(own, linked))
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pd.DataFrame({"a": a, "b": b})

    ordered = pairs.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return ordered.select("band", "lo", "hi", "block", "rid", "values").mapInPandas(batches_giving_back(compare), "a bigint, b bigint")


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns_at_once: int = 1 << 13) -> np.ndarray:
    """Numbers of common elements of every set on the left with every set on the right."""
    sizes = [len(x) for x in [*left, *right]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column.max(initial=-1)) + 1, columns_at_once):
        inside = (column >= at) & (column < at + columns_at_once)
        width = min(columns_at_once, int(column.max()) + 1 - at)
        bits = np.zeros((len(sizes), -(-width // 64) * 64), bool)
        bits[row[inside], column[inside] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(left)):
            out[i] += np.bitwise_count(packed[i] & packed[len(left):]).sum(axis=1, dtype=np.int64)
    return out


def verified(members: DataFrame, threshold: Fraction) -> DataFrame:
    """``rid, links, parent``: links of each block pair's members to others, with copies, and connecting edges.

    ``members`` holds ``comp, rid, times, grams`` (sorted distinct n-gram hashes) of every candidate component.
    """
    num, den = threshold.numerator, threshold.denominator
    pairs = _block_pairs(members, "comp", "rid", VERIFY_BLOCK)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(batches, ["comp", "lo", "hi"]):
            for (_, lo, hi), own in frame.groupby(["comp", "lo", "hi"], sort=False):
                if len(own) < 2:
                    continue
                rid, times = own["rid"].to_numpy(), own["times"].to_numpy()
                sets = [np.frombuffer(g, np.uint64) for g in own["grams"]]
                sizes = np.array([len(s) for s in sets])
                first = np.flatnonzero(own["block"].to_numpy() == lo)
                second = np.flatnonzero(own["block"].to_numpy() == hi)
                if not len(first) or not len(second):
                    continue
                common = intersections([sets[i] for i in first], [sets[i] for i in second])
                good = common * den >= num * (sizes[first][:, None] + sizes[second][None] - common)
                links = np.zeros(len(rid), np.int64)
                if lo == hi:
                    np.fill_diagonal(good, False)
                    links[first] = good @ times[second]
                else:
                    links[first] = good @ times[second]
                    links[second] = times[first] @ good
                near = np.zeros((len(rid), len(rid)), bool)
                near[np.ix_(first, second)] = good
                near |= near.T
                a, b = _connect(rid, lambda i: i + 1 + np.flatnonzero(near[i, i + 1:]))
                parent = dict(zip(a.tolist(), b.tolist()))
                some = links > 0
                yield pd.DataFrame({"rid": rid[some], "links": links[some], "parent": [parent.get(r, r) for r in rid[some].tolist()]})

    ordered = pairs.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return ordered.select("comp", "lo", "hi", "block", "rid", "times", "grams").mapInPandas(batches_giving_back(check), "rid bigint, links bigint, parent bigint")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """``rid, comp, times, grams`` of the wanted representatives, read from their documents."""
    texts = _by_document(docs, key, text).join(wanted, ["id", "th"]).select("rid", "comp", "times", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held in _slabs(batches, 3):
            grams, sizes = shingle_sets(held, n)
            ends = np.cumsum(sizes)
            blobs = [grams[e - s:e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(blobs, pa.binary())],
                                             names=["rid", "comp", "times", "grams"])

    return texts.mapInArrow(batches_giving_back(run), "rid bigint, comp bigint, times bigint, grams binary").dropDuplicates(["rid"])


def similar(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``id, th, class_id, class_th, n_links`` of every row: its class and the number of documents it is linked to.

    A class is named by its least (id, text hash). ``id`` is the largest integer where it was null.
    """
    exact = Fraction(str(threshold))
    signed = stage(signatures(docs, n, key, text), "signatures")
    whole = ["fa", "fb", "size"]
    reps = (signed.where("size > 0").groupBy(*whole)
            .agg(F.min(F.struct("id", "th")).alias("least"), F.count("*").alias("times"), F.min("values").alias("values"))
            .select("*", F.monotonically_increasing_id().alias("rid")))
    reps = stage(reps, "representatives")
    candidates = components(candidate_edges(reps, threshold, tolerance))
    wanted = (reps.join(candidates, reps.rid == candidates.node)
              .select("least.id", "least.th", "rid", F.col("root").alias("comp"), "times"))
    checked = stage(verified(_sets(docs, wanted, n, key, text), exact), "links")
    roots = components(checked.where("rid <> parent"), "rid", "parent")
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    named = reps.select("rid", *whole, "least", "times").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.join(links, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(firsts, "root").select(*whole, "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    alone = signed.where("size = 0").select("id", "th", F.col("id").alias("class_id"), F.col("th").alias("class_th"),
                                            F.lit(0).cast("bigint").alias("n_links"))
    return signed.where("size > 0").select("id", "th", *whole).join(named, whole).select(
        "id", "th", F.col("first.id").alias("class_id"), F.col("first.th").alias("class_th"), "n_links").union(alone)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the least (id, text hash) of every class, with its own columns; one of equal rows."""
    found = similar(docs, n, threshold, key=key, text=text)
    first = found.where("id = class_id AND th = class_th").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    data = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.withColumns({"__id": F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)), "__th": F.xxhash64(data)})
    kept = marked.join(first, ["__id", "__th"])
    wordless = F.btrim(data, F.lit(" \t\n\x0b\f\r")) == ""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (kept.where(~wordless).dropDuplicates(["__id", "__th"]).select(*columns)
            .union(kept.where(wordless).select(*columns)))
