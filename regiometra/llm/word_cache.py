"""Token ids of whole texts, put together from the ids of their words.

Words are cut where the tokenizer itself never merges across, so that a word has the same ids wherever it stands. Each
different word is encoded once; its ids are kept as bytes. The cache is emptied when it outgrows
its bound, which changes speed and nothing else.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

from regiometra.llm import tokens


class WordCache(dict):
    """Bytes of the ids (little-endian unsigned 32-bit) of words, looked up or encoded."""

    def __init__(self, encode: Callable[[str], list[int]], bound: int = 1 << 25, **fixed: list[int]):
        self.encode, self.bound, self.size, self.fixed = encode, bound, 0, fixed
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.update({word: np.array(ids, "<u4").tobytes() for word, ids in self.fixed.items()})
        self.size = 0

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = np.array(self.encode(word), "<u4").tobytes()
        self.size += len(word) + 64
        return ids

    def ids(self, words: list[str]) -> np.ndarray:
        """The ids of the words, one after another."""
        out = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")
        if self.size > self.bound:
            self.empty()
        return out


def _library(path: str) -> Callable[[str], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda word: tokenizer.encode(word, add_special_tokens=False).ids


# Words of ASCII and Latin-1 letters, which no normal form changes, and how the word vocabulary parts them.
_LATIN = re.compile("[\t-~À-ÖØ-öø-ÿ]*")
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")


def _latin_merges(path: str) -> Callable[[str], list[int]]:
    """Ids of a Latin word by the merges of a vocabulary with word ends; a zero byte stands for the end."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end, vocabulary = model["end_of_word_suffix"], model["vocab"]
    byte_of = {c: bytes([b]) for c, b in tokens.byte_characters().items()}

    def raw(token: str) -> bytes:
        own = token.removesuffix(end)
        return b"".join(byte_of[c] for c in own) + (b"\0" if own != token else b"")

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
    for pair in model["merges"]:
        ranks.setdefault(raw("".join(pair if isinstance(pair, list) else pair.split(" "))), len(ranks))
    id_of = {ranks[key]: i for token, i in vocabulary.items() if all(c in byte_of for c in token.removesuffix(end))
             if (key := raw(token)) in ranks}
    coding = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(word: str) -> list[int]:
        return [id_of[r] for r in coding.encode_ordinary("".join([p + "\0" for p in _LATIN_PARTS.findall(word.lower())]))]

    return encode


@functools.lru_cache(maxsize=2)
def lower_words(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a vocabulary with word ends, which drops white space; special tokens in texts count as such.

    Latin words are merged by tiktoken, in a fraction of the time; the tests hold both against the library.
    """
    library, merges = _library(path), _latin_merges(path)

    def encode(word: str) -> list[int]:
        return merges(word) if _LATIN.fullmatch(word) and "<|" not in word else library(word)

    cache = WordCache(encode)
    return lambda text: cache.ids(text.replace("\n", " ").split(" "))


# White space of the byte-level pattern (Unicode's), and how that pattern parts words from it.
_WHITE = "\t-\r \x85\xa0  -     　"
_BYTE_WORDS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_PIECE_WORDS = re.compile(" +[^ ]*")


@functools.lru_cache(maxsize=2)
def byte_words(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level vocabulary; strings of special tokens are plain text."""
    cache = WordCache(tokens.coding(path).encode_ordinary)
    return lambda text: cache.ids(_BYTE_WORDS.findall(text))


@functools.lru_cache(maxsize=2)
def piece_words(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a sentencepiece model that puts a space before it and keeps all spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # The model puts the first space of a word there itself, and nothing before an empty text.
    cache = WordCache(lambda word: model.encode(word[1:]), **{" ": [model.piece_to_id("\u2581")]})
    return lambda text: cache.ids(_PIECE_WORDS.findall(" " + text) if text else [])
