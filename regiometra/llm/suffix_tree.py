"""Substring dedup of word sequences with prefix-partitioned suffix trees.

Suffixes reach a task by the prefix at their anchor (see ``repeats``). There they are split by variable-length
prefixes: a group of suffixes with one first word that is too large is split by the next word, and so on, and small
groups are joined, so that each subtree fits in memory. Internal nodes of a subtree that are at least a window deep
are maximal repeats; the leaves below such a node are equal windows.

Documents shorter than a window keep all words; see ``repeats`` for nulls, equal ids and long texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from regiometra.llm import repeats

#: Suffixes in one subtree.
SUBTREE = 1 << 15


def prefix_groups(words: np.ndarray, suffixes: np.ndarray, window: int, limit: int = SUBTREE) -> list[np.ndarray]:
    """Groups of suffixes that hold every suffix of each of their prefixes, at most ``limit`` large where words differ."""
    groups, small = [], []
    todo = [(suffixes, 0)]
    while todo:
        held, depth = todo.pop()
        if len(held) > limit and depth < window:
            column = words[held + depth]
            order = np.argsort(column, kind="stable")
            cuts = np.flatnonzero(column[order][1:] != column[order][:-1]) + 1
            todo += [(part, depth + 1) for part in np.split(held[order], cuts)]
        elif len(held) > limit // 2:
            groups.append(held)
        else:
            small.append(held)
            if sum(map(len, small)) > limit // 2:
                groups.append(np.concatenate(small))
                small = []
    return groups + ([np.concatenate(small)] if small else [])


def subtree(words: np.ndarray, suffixes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a suffix tree cut at ``window`` words, in order, and the depth of each one's branching from the last."""
    table = words[suffixes[:, None] + np.arange(window)]
    order = np.lexsort(table.T[::-1])
    table = table[order]
    differs = table[1:] != table[:-1]
    depth = np.where(differs.any(axis=1), differs.argmax(axis=1), window) if len(table) > 1 else np.zeros(0, np.int64)
    return suffixes[order], np.concatenate([[0], depth])


def deep_nodes(depth: np.ndarray, least: int) -> np.ndarray:
    """The number of the deepest node or leaf of every leaf, where leaves share a node that is ``least`` deep."""
    return np.cumsum(depth < least)


def window_classes(contexts: list[bytes], window: int, limit: int = SUBTREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of every window of every context of words joined by single spaces."""
    split = [c.split(b" ") for c in contexts]
    names: dict[bytes, int] = {}
    words = np.array([names.setdefault(w, len(names)) for c in split for w in c], np.int64)
    sizes = np.array([len(c) for c in split])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[owner]
    suffixes = np.flatnonzero(offset + window <= sizes[owner])
    leaves, classes, used = [], [], 0
    for group in prefix_groups(words, suffixes, window, limit):
        ordered, depth = subtree(words, group, window)
        nodes = deep_nodes(depth, window) + used
        used = int(nodes[-1])
        leaves.append(ordered)
        classes.append(nodes)
    at = np.concatenate(leaves)
    return owner[at], offset[at], np.concatenate(classes)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 8, key: str = "doc_id", text: str = "text",
                   hot: int = repeats.HOT) -> DataFrame:
    """``id, th, units, removed, spans, kept`` after removing words in windows that start earlier."""
    kind = repeats.Kind(True, window, gram, True, lambda contexts: window_classes(contexts, window))
    return repeats.find_and_cut(docs, kind, key, text, hot)
