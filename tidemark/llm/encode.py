"""SentencePiece encoding by vectorised merge rounds, and decoding.

All unseen segments of a batch are one flat array of symbols. A round finds the smallest pair rank of each
segment, merges its leftmost pairs of that rank in all segments at once, and compacts the
array; segments without a pair leave. Merging every occurrence in one round equals merging one by one
as long as no new pair ranks before the others; where one does, the round ends after it in that segment.

A round costs as much as there are symbols, so segments over ``LONG`` characters, of which
there may be megabytes, have rounds of their own: places are kept by rank, a round takes those of the
smallest rank and touches only them and their neighbours. A text without spaces then costs in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, lookup, run_numbers, slices, small_batches
from .pieces import PieceModel, segments

_NONE = np.iinfo(np.int64).max
#: Segments kept from batch to batch, and the longest kept; what is not kept is encoded again.
CACHED, CACHED_CHARS = 200_000, 48
#: Characters beyond which a segment goes by places kept by rank; the results are the same.
LONG = 128


class Encoder:
    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.width = len(model.pieces)
        keys = np.array([a * self.width + b for a, b in model.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(model.pairs.values()), np.int64)[order]
        self.of_char = np.full(0x110000, -1, np.int64)
        single = [p for p in model.ids if len(p) == 1]
        self.of_char[[ord(p) for p in single]] = [model.ids[p] for p in single]
        self.by_rank = np.full(self.width + 1, -1, np.int64)
        self.by_rank[model.rank[model.normal]] = model.normal
        sizes = np.array([len(t) for t in model.texts])
        self.text, self.text_size, self.text_start = np.frombuffer(b"".join(model.texts), np.uint8), sizes, np.cumsum(sizes) - sizes
        # a piece that is part of one that ranks before it
        self.alone = np.zeros(self.width, bool)
        for (a, b), i in model.pairs.items():
            for part in (a, b):
                if model.rank[part] > model.rank[i]:
                    self.alone[part] = True

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        place = lookup(np.where((left >= 0) & (right >= 0), left * self.width + right, -1), self.keys)
        return np.where(place >= 0, self.model.rank[self.merged[place]], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty), and the n + 1 offsets between them."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        word, place, symbol = np.repeat(np.arange(len(words)), size), np.arange(len(code)), self.of_char[code]
        long = np.repeat(size > LONG, size)
        parts = [self._rounds(symbol[~long], place[~long], word[~long]), self._long_rounds(symbol[long], place[long], word[long])]
        symbol, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(place)
        return self._with_bytes(symbol[order], place[order], code, size)

    def _pair_ranks(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each symbol with the next, if both are in one word."""
        rank = np.full(len(symbol), _NONE)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        return rank

    def _in_time(self, piece: np.ndarray, left: np.ndarray, right: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which merges, in order of place, come before a new pair of their word that ranks before them.

        ``left`` and ``right`` are the symbols beside each merge when its turn comes, -1 at a word's edge.
        """
        rank = self.model.rank[piece]
        early = (self._ranks(left, piece) < rank) | (self._ranks(piece, right) < rank)
        before = np.cumsum(early) - early
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        return before == np.repeat(before[heads], np.diff(np.r_[heads, len(word)]))

    def _rounds(self, symbol: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self._pair_ranks(symbol, word)
        done_symbol, done_place = [], []
        while len(symbol):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            size = np.diff(np.r_[heads, len(word)])
            live = np.repeat(best != _NONE, size)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_place.append(place[~live])
                symbol, place, word, rank = symbol[live], place[live], word[live], rank[live]
                best, size = best[best != _NONE], size[best != _NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            piece = self.by_rank[rank[at]]
            if (some := np.flatnonzero(self.alone[piece])).size:
                spot, what, last = at[some], piece[some], len(symbol) - 1
                left = np.where((spot > 0) & (word[spot - 1] == word[spot]), symbol[spot - 1], -1)
                left = np.where(np.r_[False, (spot[1:] - spot[:-1] == 2) & (word[spot[1:]] == word[spot[:-1]])], what, left)
                beyond = np.minimum(spot + 2, last)
                right = np.where((spot + 2 <= last) & (word[beyond] == word[spot]), symbol[beyond], -1)
                late = some[~self._in_time(what, left, right, word[spot])]
                at, piece = np.delete(at, late), np.delete(piece, late)
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol[at] = piece
            now = (np.cumsum(keep) - 1)[at]
            symbol, place, word, rank = symbol[keep], place[keep], word[keep], rank[keep]
            for spot in (now, now[now > 0] - 1):
                after = np.minimum(spot + 1, len(symbol) - 1)
                joined = (after > spot) & (word[spot] == word[after])
                rank[spot] = np.where(joined, self._ranks(symbol[spot], symbol[after]), _NONE)
        return np.concatenate(done_symbol or [symbol]), np.concatenate(done_place or [place])

    def _long_rounds(self, symbol: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(symbol)
        # one more place, which belongs to no word, ends the links on both sides
        rank, live = np.r_[self._pair_ranks(symbol, word), _NONE], np.ones(n, bool)
        symbol, word = np.r_[symbol, -1], np.r_[word, -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, low, high in zip(own[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(at[low:high])

        wait(np.arange(n))
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            piece = self.by_rank[r]
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                run = np.flatnonzero(np.r_[True, ~chained])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            late = at[:0]
            if self.alone[piece]:
                left, right = before[at], after[after[at]]
                beside = np.where(word[left] == word[at], symbol[left], -1)
                beside[1:][left[1:] == after[at[:-1]]] = piece
                good = self._in_time(np.full(len(at), piece), beside, np.where(word[right] == word[at], symbol[right], -1), word[at])
                at, late = at[good], at[~good]
            gone = after[at]
            symbol[at], live[gone], rank[gone] = piece, False, _NONE
            after[at] = after[gone]
            before[after[at]] = at
            spots = np.concatenate((at, before[at]))
            spots = spots[spots >= 0]
            rank[spots] = np.where(word[spots] == word[after[spots]], self._ranks(symbol[spots], symbol[after[spots]]), _NONE)
            wait(np.concatenate((spots, late)))
        return symbol[:n][live], place[live]

    def _with_bytes(self, symbol: np.ndarray, place: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece as the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbol < 0)
        edges = np.r_[0, np.cumsum(size)]
        counts = np.ones(len(symbol), np.int64)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[place[odd]].tolist()]
        counts[odd] = [len(r) for r in raw]
        ids = np.repeat(symbol, counts)
        ids[np.repeat(symbol < 0, counts)] = self.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.r_[0, np.cumsum(counts)][np.searchsorted(place, edges)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, leading spaces included, and the offset of each id's in them."""
        size = self.text_size[ids]
        bytes_ = self.text[np.repeat(self.text_start[ids], size) + run_numbers(size)]
        return bytes_.tobytes(), np.r_[0, np.cumsum(size)]


def _rows(raw: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel(raw))
        # the first segments seen stay: common ones come early, and the others are encoded in each batch
        kept_ids: dict[str, bytes] = {}
        kept_text: dict[str, bytes] = {}
        for batch, _, _ in slices(batches, limit=4 << 20):
            column = batch.schema.get_field_index("text")
            parts = [segments(t) for t in batch.column(column).to_pylist()]
            new = list(set().union(*parts).difference(kept_ids))
            ids_of, text_of = kept_ids, kept_text
            if new:
                ids, edges = encoder.encode(new)
                text, ends = encoder.decode(ids)
                packed, bounds = ids.astype("<i4").tobytes(), ends[edges].tolist()
                edges = (4 * edges).tolist()
                fresh_ids = dict(zip(new, [packed[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True))
                fresh_text = dict(zip(new, [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))
                if len(kept_ids) < CACHED:
                    short = [w for w in new if len(w) <= CACHED_CHARS][: CACHED - len(kept_ids)]
                    kept_ids.update((w, fresh_ids[w]) for w in short)
                    kept_text.update((w, fresh_text[w]) for w in short)
                ids_of, text_of = kept_ids | fresh_ids, kept_text | fresh_text
            all_ids = [b"".join(map(ids_of.__getitem__, p)) for p in parts]
            all_text = [b"".join(map(text_of.__getitem__, p))[1:] for p in parts]
            edges = np.r_[0, np.cumsum([len(x) // 4 for x in all_ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(all_ids), "<i4")))
            edges = np.r_[0, np.cumsum([len(x) for x in all_text])].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.string(), len(all_text), [None, pa.py_buffer(edges), pa.py_buffer(b"".join(all_text))])
            rest = [(batch.column(i), k) for i, k in enumerate(batch.schema.names) if k != "text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), lists, decoded], [*(k for _, k in rest), "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs``: ids by the model file at ``model``.

    No begin or end ids; ``decoded`` is what the ids stand for, without the leading space that encoding
    adds. A null or empty text has no ids and decodes to the empty text. Repeated rows each get their ids; other
    columns, whatever their names, are left out. A very long text, with spaces or without, is one step.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as file:
        raw = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_text().alias("text")).mapInArrow(_rows(raw), f"doc_id {kind}, ids array<int>, decoded string")
