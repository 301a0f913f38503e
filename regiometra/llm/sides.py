"""The two public vocabularies as sides of an alignment."""

from __future__ import annotations

import functools
import json

from regiometra.llm import tokens, word_cache
from regiometra.llm.alignment import Side


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level vocabulary file; its token strings spell bytes by one character each."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = tokens.byte_characters()
    pieces = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    return Side(word_cache.byte_words(path), [pieces.get(i, b"") for i in range(max(pieces) + 1)])


@functools.lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Side:
    """A sentencepiece model; U+2581 is a space and pieces like <0x0A> are bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(word_cache.piece_words(path), [spelled(i) for i in range(model.get_piece_size())])
