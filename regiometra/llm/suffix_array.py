"""Suffix-array dedup of byte strings; suffixes are sorted by linear grouping.

:func:`suffix_array` groups suffixes by their Lyndon prefixes, from the highest group down, with previous-smaller
pointers, and then emits every group's order in one ascending sweep: no names, no recursion. The frame in
``repeats`` finds which contexts must be compared; their windows fall into classes along the suffix array.

Documents shorter than a window keep all bytes; see ``repeats`` for nulls, equal ids and long texts.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame

from regiometra.llm import repeats

#: Suffixes from which on a group is taken in one step.
MANY = 24


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def suffix_array(values: list[int] | np.ndarray) -> list[int]:
    """Starts of all suffixes in order; values are positive, and the end sorts before everything.

    A group of ``MANY`` suffixes or more is taken in one step over arrays, a smaller one suffix by suffix on the same
    memory.
    """
    text = np.append(np.asarray(values, np.int64), 0)
    n = len(text)
    order, place, group, size, before = (array("q", bytes(8 * (n + 1))) for _ in range(5))
    orders, places, groups, sizes, befores = (np.frombuffer(a, np.int64) for a in (order, place, group, size, before))
    orders[:n] = np.argsort(text, kind="stable")
    heads = _first_of_runs(text[orders[:n]])
    sizes[heads] = np.diff(heads, append=n)
    places[orders[:n]], groups[orders[:n]] = np.arange(n), np.repeat(heads, sizes[heads])
    group[n] = -1  # nothing lies before the text: -1, the last place of all lists
    moving = np.zeros(n, bool)

    def part(moved: np.ndarray) -> None:
        """Moves suffixes to the end of their groups, where they are groups of their own."""
        by = np.argsort(groups[moved], kind="stable")
        moved = moved[by]
        owner = groups[moved]
        new = _first_of_runs(owner)
        count, head = np.diff(new, append=len(owner)), owner[new]
        sizes[head] -= count
        start = head + sizes[head]
        sizes[start] = count
        target = np.arange(len(owner)) + np.repeat(start - new, count)
        moving[moved] = True
        target = target[~moving[orders[target]]]
        moving[moved] = False
        starts, at = np.repeat(start, count), places[moved]
        outside = at < starts
        enter, at, leave = moved[outside], at[outside], orders[target]
        orders[target], orders[at] = enter, leave
        places[enter], places[leave] = target, at
        groups[moved] = starts

    high = n
    while high > 0:
        i = order[high - 1]
        low = group[i]
        if high - low >= MANY:
            members = np.sort(orders[low:high])
            j = members - 1
            on = np.flatnonzero(groups[j] > low)
            while len(on):
                j[on] = befores[j[on]]
                on = on[groups[j[on]] > low]
            befores[members] = j
            on = np.flatnonzero(groups[j] == low)
            while len(on):  # through members of this group, twice as far each time
                j[on] = befores[j[on]]
                befores[members[on]] = j[on]
                on = on[groups[j[on]] == low]
            j = np.sort(j[j >= 0])
            new = _first_of_runs(j)
            j, times = j[new], np.diff(new, append=len(j))
            for t in np.unique(times)[::-1].tolist():
                part(j[times == t])
            high = low
            continue
        if high - low == 1:  # the one suffix before goes to the end of its group
            j = i - 1
            while group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                size[g] -= 1
                end = g + size[g]
                if end > g:
                    other, at = order[end], place[j]
                    order[at], place[other] = other, at
                    order[end], place[j] = j, end
                    group[j] = end
                size[end] = 1
            high = low
            continue
        times: dict[int, int] = {}
        for i in sorted(order[low:high]):
            j = i - 1
            while group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, t in times.items():
            levels.setdefault(t, []).append(j)
        for t in sorted(levels, reverse=True):
            for j in levels[t]:
                g = group[j]
                size[g] -= 1
                end = g + size[g]
                other, at = order[end], place[j]
                order[at], place[other] = other, at
                order[end], place[j] = j, end
            starts = {g: g + size[g] for g in {group[j] for j in levels[t]}}
            for j in levels[t]:
                group[j] = start = starts[group[j]]
                size[start] += 1
        high = low
    out, free, done = array("q", bytes(8 * n)), array("q", range(n + 1)), bytearray(n + 1)
    outs, frees, dones = np.frombuffer(out, np.int64), np.frombuffer(free, np.int64), np.frombuffer(done, bool)
    out[0], free[0], done[n - 1], done[n] = n - 1, 1, True, True
    rank = 0
    while rank < n:
        high = free[group[out[rank]]]
        if high - rank >= MANY:  # all that is known of a group
            j, source = outs[rank:high] - 1, np.arange(high - rank)
            sent = []
            while len(j):
                on = ~dones[j]
                j, source = j[on], source[on]
                sent.append((j, source))
                j = befores[j]
            j, source = (np.concatenate(x) for x in zip(*sent))
            if len(sent) > 2:  # of several ways to a suffix the first in order counts
                by = np.lexsort((source, j))
                by = by[_first_of_runs(j[by])]
                j = j[by][np.argsort(source[by], kind="stable")]
            by = np.argsort(groups[j], kind="stable")
            j = j[by]
            owner = groups[j]
            new = _first_of_runs(owner)
            count, head = np.diff(new, append=len(owner)), owner[new]
            outs[np.arange(len(owner)) + np.repeat(frees[head] - new, count)] = j
            frees[head] += count
            dones[j] = True
            rank = high
            continue
        for i in out[rank:high]:
            j = i - 1
            while not done[j]:
                g = group[j]
                out[free[g]] = j
                free[g] += 1
                done[j] = True
                j = before[j]
        rank = high
    return out[1:].tolist()


def window_classes(contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of every window of every context; windows are neighbours in the suffix array if equal."""
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"\0".join(contexts), np.uint8)
    break_at = np.cumsum(sizes + 1)[:-1] - 1
    values = joined.astype(np.int64) + 2
    values[break_at] = 1
    order = np.array(suffix_array(values), np.int64)
    starts = np.concatenate([[0], break_at + 1])
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[:len(joined)]
    offset = np.arange(len(joined)) - starts[owner]
    order = order[(offset + window <= sizes[owner])[order]]
    windows = np.lib.stride_tricks.sliding_window_view(values.astype(np.int16), window)
    new = np.ones(len(order), bool)
    for a in range(0, len(order) - 1, 1 << 16):
        part = order[a:a + (1 << 16) + 1]
        new[a + 1:a + len(part)] = (windows[part[1:]] != windows[part[:-1]]).any(axis=1)
    return owner[order], offset[order], np.cumsum(new)


def _agreement(table: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For every row, how many leading bytes it shares with the row of its group that it agrees with most."""
    width = table.shape[1]
    keyed = np.concatenate([groups.astype(">u4").view(np.uint8).reshape(-1, 4), table], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{width + 4}").ravel(), kind="stable")
    differs = table[order][1:] != table[order][:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width) * (groups[order][1:] == groups[order][:-1])
    most = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
    out = np.empty(len(table), np.int64)
    out[order] = most
    return out


def reach(contexts: list[bytes], offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in each context beyond which it differs from all others of its anchor, on either side of the anchor.

    Contexts come sorted by ``groups``.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    _, groups = np.unique(groups, return_inverse=True)

    def side(length: np.ndarray, step: int) -> np.ndarray:
        reached = np.zeros(len(sizes), np.int64)
        b = 0
        while b < len(sizes):  # whole groups at a time
            a, b = b, min(b + (1 << 17), len(sizes))
            b = int(np.searchsorted(groups, groups[b - 1], "right"))
            columns = np.arange(length[a:b].max())
            inside = columns < length[a:b, None]
            at = (starts + offsets - (step < 0))[a:b, None] + step * columns
            table = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
            reached[a:b] = np.minimum(_agreement(table, groups[a:b]), length[a:b]) if len(columns) else 0
        return reached

    return offsets - side(offsets, -1), offsets + side(sizes - offsets, 1)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16, key: str = "doc_id", text: str = "text",
                   hot: int = repeats.HOT) -> DataFrame:
    """``id, th, units, removed, spans, kept`` after removing bytes in windows that a smaller id also has."""
    kind = repeats.Kind(False, window, gram, False, lambda contexts: window_classes(contexts, window), reach)
    return repeats.find_and_cut(docs, kind, key, text, hot)
