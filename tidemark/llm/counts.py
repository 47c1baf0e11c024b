"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

Each segment is a linked list of symbols and a heap of its adjacent pairs. The pair of lowest rank, the
leftmost of equals, is popped and merged until none is left; pairs whose symbols have
changed since are passed over. The count is the initial symbols less the merges, where a
character that is no piece counts as its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, slices, small_batches
from .pieces import PieceModel, segments

LIMIT = 4096
#: Segments kept from batch to batch, and the longest kept.
CACHED, CACHED_CHARS = 200_000, 48


class Counter:
    def __init__(self, model: PieceModel) -> None:
        rank = model.rank.tolist()
        self.width = len(model.pieces)
        self.chars = {p: i for p, i in model.ids.items() if len(p) == 1}
        #: left * width + right to rank * width + merged id: one number orders and names the merge
        self.pairs = {a * self.width + b: rank[i] * self.width + i for (a, b), i in model.pairs.items()}

    def count(self, word: str) -> int:
        ids = [self.chars.get(c, -1) for c in word]
        total = len(ids)
        if -1 in ids:
            total += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, i in zip(word, ids, strict=True) if i < 0)
        if len(ids) < 2:
            return total
        width, pairs, n = self.width, self.pairs, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for at in range(n - 1):
            left, right = ids[at], ids[at + 1]
            if left >= 0 and right >= 0 and (merge := pairs.get(left * width + right)) is not None:
                heap.append((merge, at, left, right))
        heapify(heap)
        while heap:
            merge, at, left, right = heappop(heap)
            end = after[at]
            if ids[at] != left or end >= n or ids[end] != right:
                continue
            total -= 1
            ids[at], ids[end] = merge % width, -2
            end = after[at] = after[end]
            if end < n:
                before[end] = at
                if ids[end] >= 0 and (new := pairs.get(ids[at] * width + ids[end])) is not None:
                    heappush(heap, (new, at, ids[at], ids[end]))
            start = before[at]
            if start >= 0 and ids[start] >= 0 and (new := pairs.get(ids[start] * width + ids[at])) is not None:
                heappush(heap, (new, start, ids[start], ids[at]))
        return total


def _rows(raw: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(PieceModel(raw))
        # the first segments seen stay: common ones come early, and the others are counted in each batch
        kept: dict[str, int] = {}
        for batch, _, offsets in slices(batches, limit=4 << 20):
            parts = [segments(t) for t in batch.column(1).to_pylist()]
            new = set().union(*parts).difference(kept)
            fresh = {w: counter.count(w) for w in new}
            if len(kept) < CACHED:
                kept.update([(w, n) for w, n in fresh.items() if len(w) <= CACHED_CHARS][: CACHED - len(kept)])
            known = kept | fresh
            out = [sum(map(known.__getitem__, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, by the model file at ``model``.

    A null or empty text has 0 bytes and 0 tokens. Rows that repeat are counted each. Other columns
    are left out.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as file:
        raw = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", as_text().alias("text")).mapInArrow(_rows(raw), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
