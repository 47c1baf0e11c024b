"""Quality: ridge regression on random Fourier features of document statistics, then calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations, the
parts are summed by row of the matrix, and the driver solves a system of fixed size. A part
of the training rows is kept aside to fit an isotonic curve from ridge scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, as_text, lower_table, slices, small_batches, spill, space_words, squeeze
from .labelled import FIT_ROWS, sample

FREQUENCIES = 384
BINS = 1000
RIDGE = 1e-3
_SEED = 11
STATISTICS = ("bytes", "words", "word length", "word length spread", "capitals", "digits", "marks", "symbols", "exclamations", "bars", "lines", "distinct words", "commonest word", "same as word before", "short words", "distinct lines", "other bytes")
_CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b".,;:?'\"()-", "symbols": b"#*$%&<>", "exclamations": b"!", "bars": b"|", "lines": b"\n", "other bytes": bytes(range(128, 256))}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document; an empty text has all zero."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    put = {name: i for i, name in enumerate(STATISTICS)}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        out[:, put[name]] = np.diff(np.r_[0, np.cumsum(table[data])][offsets]) / np.maximum(size, 1)
    joined, starts, ends, first = squeeze(lower_table()[data], offsets, space_words())
    words = np.diff(first)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n), words)
    each = np.maximum(words, 1)
    mean = np.bincount(owner, length, minlength=n) / each
    hashes = RangeHash(joined).of(starts, ends)
    order = np.lexsort((hashes, owner))
    heads = np.flatnonzero(np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(order) else order
    times = np.diff(np.r_[heads, len(order)])
    commonest = np.zeros(n)
    np.maximum.at(commonest, owner[order[heads]], times)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.empty(0, bool)
    # lines by their bytes
    feed = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][size > 0], feed + 1])
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    line = RangeHash(data).of(line_start, line_end)
    order = np.lexsort((line, line_owner))
    new = np.r_[True, (line[order][1:] != line[order][:-1]) | (line_owner[order][1:] != line_owner[order][:-1])] if len(order) else np.empty(0, bool)
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    out[:, put["bytes"]] = np.log1p(size)
    out[:, put["words"]] = np.log1p(words)
    out[:, put["word length"]] = np.log1p(mean)
    out[:, put["word length spread"]] = np.log1p(np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=n) / each - mean**2, 0)))
    out[:, put["distinct words"]] = np.bincount(owner[order_heads(heads, owner, hashes)], minlength=n) / each if len(owner) else 0
    out[:, put["commonest word"]] = commonest / each
    out[:, put["same as word before"]] = np.bincount(owner, same, minlength=n) / each
    out[:, put["short words"]] = np.bincount(owner, length <= 3, minlength=n) / each
    out[:, put["distinct lines"]] = np.where(size > 0, np.bincount(line_owner[order[new]], minlength=n) / lines, 0)
    return out


def order_heads(heads: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One place of each distinct (document, word)."""
    return np.lexsort((hashes, owner))[heads]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.directions + self.shifts), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; the raw score moves it a little where the curve is flat, so that ties keep an order."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-8 * (raw - 0.5))), 0, 1)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        x = statistics(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*(c for c, k in zip(batch.columns, batch.schema.names, strict=True) if k != "text"), lists], [*(k for k in batch.schema.names if k != "text"), "x"])


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _normal_equations(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            z = model.features(_matrix(batch))
            y = batch.column(batch.schema.get_field_index("y")).to_numpy().astype(float)
            total = total + z.T @ np.c_[z, y]
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["row", "part"])

    return run


def _sum_parts(row: tuple, parts: pa.Table) -> pa.Table:
    total = np.sum(np.stack([x.values.to_numpy() for x in parts.column("part")]), axis=0)
    return pa.table({"row": pa.array([row[0].as_py()], pa.int64()), "part": pa.array([total], pa.list_(pa.float64()))})


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing levels closest to y, with weights n, for x in order: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), n.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, c = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + c
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(stats: DataFrame, frequencies: int = FREQUENCIES) -> Model | None:
    """Fit on rows (doc_id, y, x); None without both labels. The driver gets sums of fixed size only."""
    dims = len(STATISTICS)
    moments = [f(F.col("x")[i]) for i in range(dims) for f in (F.avg, F.stddev_pop)]
    got = stats.agg(F.min("y"), F.max("y"), *moments).first()
    if got[0] is None or got[0] == got[1]:
        return None
    values = np.array(got[2:], float).reshape(dims, 2)
    random = np.random.default_rng(_SEED)
    model = Model(values[:, 0], np.maximum(values[:, 1], 1e-3), random.normal(0, 1 / np.sqrt(dims), (dims, frequencies)), random.uniform(0, 2 * np.pi, frequencies))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    parts = stats.where(~aside).mapInArrow(_normal_equations(model), "row long, part array<double>").groupBy("row").applyInArrow(_sum_parts, "row long, part array<double>").orderBy("row").collect()
    if not parts:
        return None
    sums = np.array([r["part"] for r in parts])
    model.weights = np.linalg.solve(sums[:, :-1] + RIDGE * max(1.0, sums[-1, -2]) / 100 * np.eye(len(sums)), sums[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(np.clip(np.round(model.raw(_matrix(batch)) * BINS), -BINS, 2 * BINS).astype(np.int64))], ["y", "bin"])

    curve = stats.where(aside).mapInArrow(raw, "y int, bin long").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(curve) > 1:
        model.knots, n = curve["bin"].to_numpy() / BINS, curve["n"].to_numpy()
        model.levels = isotonic(model.knots, curve["y"].to_numpy(), n)
    return model


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, repeated rows each.

    A null text counts as empty, and an empty one is scored from its statistics, all zero. Fitted on
    at most ``most`` labelled rows; without both labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(spill(sample(docs, labels, label, most).select("doc_id", "y", "text").mapInArrow(_stat_rows, f"doc_id {kind}, y int, x array<double>"), "quality-sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            score = model.score(statistics(data, offsets)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", as_text().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
