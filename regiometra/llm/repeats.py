"""Long passages that occur again, found across all documents: the common frame of both dedup operators.

A passage is ``window`` consecutive units (bytes or words). Every window has an anchor: of its runs of ``gram`` units
the one with the smallest hash, leftmost first. Equal windows have equal anchors, so windows are compared only under
the same anchor, and anchors that occur once drop out early. No window is missed.

1. Documents are stored once, bucketed by a hash of their id; later steps join to a bucket without moving texts.
2. Each bucket sends its distinct anchor hashes with counts; anchors found in more than one place return.
3. Each bucket cuts the contexts of those anchors, settles equal contexts within itself, and sends the rest.
4. Under each anchor, equal contexts are settled by their first document; contexts that differ go to the operator's
   own construction, which tells which windows of which contexts equal one of an earlier document.
5. Ranges return to their bucket, where documents are cut.

An anchor with more than ``HOT`` occurrences is not compared in one task: its windows are sent by their own hashes,
and equal windows in a bucket travel once. Texts are cut whole; long ones are scanned in overlapping slabs.

A null text is empty. A null id counts as larger than every other. Rows of equal id do not remove from one another.
"""

from __future__ import annotations

import functools
import gc
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometra.llm.memory import giving_back
from regiometra.session import new_folder

#: Bytes of text in a bucket, and units scanned at once.
BUCKET_BYTES, SLAB = 8 << 20, 1 << 20
#: Occurrences beyond which the windows of an anchor are compared by their own hashes.
HOT = 50_000
NO_ID = (1 << 63) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Kind:
    """What a unit is, how long windows and anchors are, and whether a document repeats itself.

    ``compare(contexts)`` gets the differing contexts of some anchors and returns (context, offset) of every window
    and the number of its class, equal exactly for equal windows. ``trim(contexts, offsets, groups)``, if there is one,
    gets contexts with the places and numbers of their anchors and returns bounds outside of which no window can
    equal one of another context of the anchor.
    """

    words: bool
    window: int
    gram: int
    within: bool
    compare: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    trim: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None

    def cut(self, context: bytes, start: int, end: int) -> bytes:
        return b" ".join(context.split(b" ")[start:end]) if self.words else context[start:end]


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` values, by doubling."""
    out, done, power, held = None, 0, values, 1
    while True:
        if length & held:
            n = len(values) - done - held + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = power[:n] if out is None else mixed(out[:n] * _MULTIPLIER + power[done:done + n])
            done += held
        held *= 2
        if held > length:
            return out
        power = mixed(power[:-(held // 2)] * _MULTIPLIER + power[held // 2:]) if len(power) > held // 2 else power[:0]


def least_position(values: np.ndarray, length: int) -> np.ndarray:
    """Leftmost position of the least of every run of ``length`` values."""
    at, held = np.arange(len(values), dtype=np.int64), 1
    while held * 2 <= length:
        right = values[held:] < values[:-held]
        at, values = np.where(right, at[held:], at[:-held]), np.where(right, values[held:], values[:-held])
        held *= 2
    rest = length - held
    if rest:
        at = np.where(values[rest:] < values[:-rest], at[rest:], at[:-rest])
    return at


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a text given as bytes."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BACK = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


@functools.lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    power, back = np.full(count, _MULTIPLIER), np.full(count, _BACK)
    power[0] = back[0] = 1
    return np.cumprod(power), np.cumprod(back)


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans, from prefix sums of a polynomial."""
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    power, back = _powers(1 << len(values).bit_length())
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:len(values)])])
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Units:
    """The units of one document."""

    def __init__(self, data: bytes, kind: Kind):
        self.raw, self.kind = data, kind
        array = np.frombuffer(data, np.uint8)
        self.starts, self.ends = word_spans(array) if kind.words else (None, None)
        self.count = len(self.starts) if kind.words else len(data)

    def hashes(self) -> np.ndarray:
        values = _BYTE_HASH[np.frombuffer(self.raw, np.uint8)]
        return _spans_hash(values, self.starts, self.ends) if self.kind.words else values

    def piece(self, start: int, end: int) -> bytes:
        """Units from start to end; words are joined by one space."""
        if not self.kind.words:
            return self.raw[start:end]
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist()))


def entries(units: list[Units], kind: Kind, full: bool) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of all documents: hash, document, first and last window start, place, context hash.

    Short documents share a slab; a long one is cut into slabs that overlap by a window.
    """
    found: list[list[np.ndarray]] = []
    held: list[tuple[int, int, np.ndarray]] = []

    def scan() -> None:
        if not held:
            return
        values = np.concatenate([v for _, _, v in held])
        sizes = np.array([len(v) for _, _, v in held])
        grams = run_hashes(values, kind.gram)
        if len(values) < kind.window:
            held.clear()
            return
        anchor = least_position(grams, kind.window - kind.gram + 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
        ends = np.cumsum(sizes)
        starts = np.flatnonzero(np.arange(len(anchor)) + kind.window <= ends[owner])
        if len(starts):
            new = np.concatenate([[True], (anchor[starts][1:] != anchor[starts][:-1]) | (owner[starts][1:] != owner[starts][:-1])])
            first, last = starts[new], starts[np.concatenate([new[1:], [True]])]
            doc, shift = np.array([d for d, _, _ in held]), np.array([s for _, s, _ in held]) - (ends - sizes)
            own = owner[first]
            context = _spans_hash(values, first, last + kind.window) if full else first
            found.append([grams[anchor[first]], doc[own], first + shift[own], last + shift[own], anchor[first] + shift[own], context])
        held.clear()

    size = 0
    for i, u in enumerate(units):
        if u.count < kind.window:
            continue
        values = u.hashes()
        for at in range(0, u.count - kind.window + 1, SLAB):
            part = values[at:at + SLAB + kind.window - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= SLAB:
                scan()
                size = 0
    scan()
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*found))


def later(group: list[np.ndarray], ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, within: bool) -> np.ndarray:
    """Which members of each group of equal things have an earlier one: a smaller id, or an earlier start in the same row."""
    order = np.lexsort((starts, rows, ids, *group[::-1]))
    same = np.ones(max(len(order) - 1, 0), bool)
    for g in group:
        same &= g[order][1:] == g[order][:-1]
    first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    leader = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
    again = ids[order] > ids[leader]
    if within and len(order):
        again |= np.concatenate([[False], same & (rows[order][1:] == rows[order][:-1])])
    out = np.zeros(len(order), bool)
    out[order] = again
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def _ranges(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(document, start, end) with the ranges of each document merged."""
    names, place = np.unique(doc, return_inverse=True)
    shift = place.ravel() << 33  # documents follow one another on one line, too far apart to touch
    starts, ends = merged(shift + starts, shift + ends)
    place = starts >> 33
    return np.stack([names[place], starts - (place << 33), ends - (place << 33)], axis=1)


def by_owner(owner: np.ndarray, chosen: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(owner, its chosen indices, in order) of every owner of any, in one sort whatever the number of owners."""
    order = chosen[np.argsort(owner[chosen], kind="stable")]
    names, first = np.unique(owner[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, first[1:]))) if len(order) else []


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def release(spark) -> None:
    """Lets Spark delete shuffle files of finished jobs now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The documents bucketed by id in the shared folder, each (id, text) once, and the number of buckets."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(data).alias("th"), data.cast("binary").alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(12, math.ceil(total / BUCKET_BYTES))
    name, folder = f"repeats_{new_folder(spark, '')[-32:]}", new_folder(spark, "documents")
    # Repeated rows meet in no task: each input task sends one of them.
    dealt = rows.dropDuplicates(["id", "th"]).withColumn("db", F.pmod(F.xxhash64(F.lit(3), "id", "th"), F.lit(buckets)).cast("int"))
    (dealt.repartition(buckets, "db").write.option("path", folder).option("compression", "zstd")
     .bucketBy(buckets, "db").saveAsTable(name))
    release(spark)
    return spark.table(name), buckets


def _opened(frame: pd.DataFrame, kind: Kind) -> tuple[np.ndarray, np.ndarray, list[Units]]:
    """The documents of a bucket in order of (id, text hash)."""
    frame = frame.sort_values(["id", "th"], kind="stable")
    return frame["id"].to_numpy(np.int64), frame["th"].to_numpy(np.int64), [Units(d, kind) for d in frame["data"]]


def find_and_cut(docs: DataFrame, kind: Kind, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per different (id, text): ``id, th, units, removed, spans, kept``.

    ``spans`` are the removed units as [start, end); ``kept`` are the remaining bytes, or words joined by one space.
    """
    stored, buckets = store(docs, key, text)
    shift = np.uint64(64 - min(20, max(4, (buckets - 1).bit_length())))

    @giving_back
    def send_anchors(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, units = _opened(frame, kind)
        anchors = entries(units, kind, full=False)[0]
        anchors, counts = np.unique(anchors, return_counts=True)
        part = (mixed(anchors) >> shift).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, first = np.unique(part[order], return_index=True)
        rows = [(int(g), int(frame["db"].iloc[0]), _pack(anchors[o]), _pack(np.minimum(counts[o], 1 << 30).astype("<u4")))
                for g, o in zip(names, np.split(order, first[1:]))] if len(order) else []
        return pd.DataFrame(rows, columns=["part", "db", "anchors", "counts"])

    @giving_back
    def find_shared(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["anchors"].map(len).to_numpy() // 8
        anchors = np.frombuffer(b"".join(frame["anchors"]), np.uint64)
        counts = np.frombuffer(b"".join(frame["counts"]), "<u4").astype(np.int64)
        owner = np.repeat(frame["db"].to_numpy(), sizes)
        _, inverse, places = np.unique(anchors, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, counts)[inverse]
        shared = np.flatnonzero((places[inverse] > 1) | (total > 1))
        rows = [(db, _pack(anchors[chosen]), _pack(total[chosen] > hot)) for db, chosen in by_owner(owner, shared)]
        return pd.DataFrame(rows, columns=["db", "anchors", "hot"])

    @giving_back
    def send_contexts(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "db", "ids", "rows", "places", "anchors", "offsets", "sizes", "data"]
        if not len(frame) or not len(shared):
            return pd.DataFrame([], columns=columns)
        db = int(frame["db"].iloc[0])
        ids, ths, units = _opened(frame, kind)
        anchor, doc, first, last, at_anchor, context = entries(units, kind, full=True)
        known = np.frombuffer(b"".join(shared["anchors"]), np.uint64)
        hot_known = np.frombuffer(b"".join(shared["hot"]), bool)
        order = np.argsort(known, kind="stable")
        known, hot_known = known[order], hot_known[order]
        at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        used = known[at] == anchor
        is_hot = hot_known[at[used]]
        anchor, doc, first, last, at_anchor, context = (x[used] for x in (anchor, doc, first, last, at_anchor, context))
        if is_hot.any():  # each window becomes an entry of its own, under its own hash
            times = np.where(is_hot, last - first + 1, 1)
            spread = np.repeat(np.arange(len(anchor)), times)
            step = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
            anchor, doc, first, last, at_anchor, context, is_hot = (
                x[spread] for x in (anchor, doc, first, last, at_anchor, context, is_hot))
            first = first + np.where(is_hot, step, 0)
            last, at_anchor = np.where(is_hot, first, last), np.where(is_hot, first, at_anchor)
            own = {d: run_hashes(units[d].hashes(), kind.window) for d in np.unique(doc[is_hot]).tolist()}
            windows = np.array([own[d][s] for d, s in zip(doc[is_hot].tolist(), first[is_hot].tolist())], np.uint64)
            anchor[is_hot], context[is_hot] = mixed(windows), windows
        known_later = later([anchor, context], ids[doc], doc, first, kind.within)
        rows = []
        local = _ranges(doc[known_later], first[known_later], last[known_later] + kind.window)
        if len(local):
            rows.append((-1 - db, db, b"", _pack(local[:, 0]), _pack(local[:, 1:]), b"", b"", b"", b""))
        sent = np.flatnonzero(~known_later)
        part = (mixed(anchor[sent]) >> shift).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, cuts = np.unique(part[order], return_index=True)
        for g, o in zip(names.tolist(), np.split(sent[order], cuts[1:]) if len(order) else []):
            pieces = [units[doc[i]].piece(int(first[i]), int(last[i]) + kind.window) for i in o]
            rows.append((g, db, _pack(ids[doc[o]]), _pack(doc[o].astype("<u4")), _pack(first[o]), _pack(anchor[o]),
                         _pack((at_anchor[o] - first[o]).astype("<u2")), _pack(np.array([len(p) for p in pieces], "<u4")), b"".join(pieces)))
        return pd.DataFrame(rows, columns=columns)

    @giving_back
    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        columns = ["db", "rows", "ranges"]
        if frame["part"].iloc[0] < 0:
            return frame[["db", "rows", "places"]].set_axis(columns, axis=1)
        sizes = frame["ids"].map(len).to_numpy() // 8
        db = np.repeat(frame["db"].to_numpy(np.int64), sizes)
        ids, first = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("ids", "places"))
        docs_, lengths = (np.frombuffer(b"".join(frame[c]), "<u4").astype(np.int64) for c in ("rows", "sizes"))
        offsets = np.frombuffer(b"".join(frame["offsets"]), "<u2").astype(np.int64)
        anchor = np.frombuffer(b"".join(frame["anchors"]), np.uint64)
        data = b"".join(frame["data"])
        ends = np.cumsum(lengths)
        pieces = [data[b - n:b] for b, n in zip(ends.tolist(), lengths.tolist())]
        names: dict[bytes, int] = {}
        name = np.array([names.setdefault(p, len(names)) for p in pieces], np.int64)
        row = db << 32 | docs_  # a document, within this run
        again = later([anchor, name.view(np.uint64)], ids, row, first, kind.within)
        units = np.array([p.count(b" ") + 1 for p in pieces]) if kind.words else lengths
        hits = [(row[again], first[again], first[again] + units[again])]
        _, inverse = np.unique(anchor, return_inverse=True)
        different = np.zeros(len(anchor), bool)
        if len(anchor):
            order = np.lexsort((name, inverse))
            differs = np.concatenate([[False], (name[order][1:] != name[order][:-1]) & (inverse[order][1:] == inverse[order][:-1])])
            different = np.bincount(inverse, np.bincount(order[differs], minlength=len(anchor)))[inverse] > 0
        members = np.flatnonzero(different & ~again)
        if len(members):
            members = members[np.argsort(inverse[members], kind="stable")]
            offsets, first = offsets.copy(), first.copy()
            while kind.trim and len(members):  # shorter contexts may be equal, and without those others reach less far
                low, high = kind.trim([pieces[i] for i in members], offsets[members], inverse[members])
                fits = high - low >= kind.window
                members, low, high = members[fits], low[fits], high[fits]
                for i, a, b in zip(members.tolist(), low.tolist(), high.tolist()):
                    pieces[i] = kind.cut(pieces[i], a, b)
                first[members] += low
                offsets[members] -= low
                names.clear()
                named = np.array([names.setdefault(pieces[i], len(names)) for i in members], np.int64)
                again = later([inverse[members], named, offsets[members]], ids[members], row[members], first[members], kind.within)
                gone = members[again]
                hits.append((row[gone], first[gone], first[gone] + (high - low)[again]))
                members = members[~again]
                if not len(gone):
                    break
            total, start = 0, 0
            for i in range(len(members)):
                total += len(pieces[members[i]]) + 1
                if i + 1 == len(members) or total > 1 << 18 and inverse[members[i + 1]] != inverse[members[i]]:
                    chosen = members[start:i + 1]
                    which, offset, klass = kind.compare([pieces[j] for j in chosen])
                    holder = chosen[which]
                    place = first[holder] + offset
                    seen = later([klass], ids[holder], row[holder], place, kind.within)
                    hits.append((row[holder[seen]], place[seen], place[seen] + kind.window))
                    total, start = 0, i + 1
        where, start, end = (np.concatenate(x) for x in zip(*hits))
        found = _ranges(where, start, end)
        home = found[:, 0] >> 32
        rows = [(d, _pack(found[chosen, 0] & 0xFFFFFFFF), _pack(found[chosen, 1:])) for d, chosen in by_owner(home, np.arange(len(home)))]
        return pd.DataFrame(rows, columns=columns)

    @giving_back
    def cut(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame([], columns=["id", "th", "units", "removed", "spans", "kept"])
        ids, ths, units = _opened(frame, kind)
        doc = np.frombuffer(b"".join(found["rows"]), np.int64)
        ranges = np.frombuffer(b"".join(found["ranges"]), np.int64).reshape(-1, 2)
        order = np.argsort(doc, kind="stable")
        doc, ranges = doc[order], ranges[order]
        rows = []
        for i, u in enumerate(units):
            a, b = np.searchsorted(doc, [i, i + 1])
            s, e = merged(ranges[a:b, 0], ranges[a:b, 1])
            gaps = zip([0, *e.tolist()], [*s.tolist(), u.count])
            kept = [u.piece(x, y) for x, y in gaps if y > x]
            spans = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
            rows.append((int(ids[i]), int(ths[i]), u.count, int((e - s).sum()), spans, (b" " if kind.words else b"").join(kept)))
        return pd.DataFrame(rows, columns=["id", "th", "units", "removed", "spans", "kept"])

    sent = stored.groupBy("db").applyInPandas(send_anchors, "part bigint, db int, anchors binary, counts binary")
    shared = sent.groupBy("part").applyInPandas(find_shared, "db int, anchors binary, hot binary")
    contexts = stored.groupBy("db").cogroup(shared.groupBy("db")).applyInPandas(
        send_contexts, "part bigint, db int, ids binary, rows binary, places binary, anchors binary, offsets binary, sizes binary, data binary")
    found = contexts.groupBy("part").applyInPandas(settle, "db int, rows binary, ranges binary")
    return stored.groupBy("db").cogroup(found.groupBy("db")).applyInPandas(
        cut, "id bigint, th bigint, units bigint, removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def attach(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", how: str = "inner") -> DataFrame:
    """Every row of ``docs`` with the columns of ``found`` for its id and text, under one struct ``__cut``."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID))
    left = docs.withColumns({"__id": ident, "__th": F.xxhash64(data)})
    right = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.struct(*[F.col(c) for c in found.columns]).alias("__cut"))
    return left.join(right, ["__id", "__th"], how).drop("__id", "__th")
