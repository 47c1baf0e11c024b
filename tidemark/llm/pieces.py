"""A SentencePiece BPE model: its file, its segments, and its pair table.

A text gets a leading mark, and spaces become marks. No piece has the mark after another
character (checked when a model is read), so merges never cross from a character to a mark, and a text falls
into segments: some marks and the characters up to the next mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Fixed values of the public model format: kinds of pieces and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """Pieces by id, with their ranks: 0 is merged first."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.pieces: list[str] = []
        kinds, scores = [], []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
        self.ids = {self.pieces[i]: i for i in self.normal}
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)])
        rank = np.full(len(self.pieces), len(self.pieces), np.int64)
        rank[sorted(self.normal, key=lambda i: (-scores[i], i))] = np.arange(len(self.normal))
        self.rank = rank
        if trainer.get(3) != BPE or not trainer.get(35) or {USER_DEFINED, UNUSED} & {*kinds}:
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are served")
        if normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1:
            raise ValueError("only models that change nothing but spaces, and add a leading one, are served")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece crosses segments, or has a character that is no piece")

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """(left id, right id) to the id of the merged piece."""
        return {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}

    @cached_property
    def texts(self) -> list[bytes]:
        """What each id decodes to."""
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        return out


def segments(text: str) -> list[str]:
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []
