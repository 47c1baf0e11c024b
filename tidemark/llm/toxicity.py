"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (code points) of the lower-cased text, its white space as one space
and one space at either end. n-grams are hashed into a fixed space of ``2 ** BITS`` features; none is selected or left out.
Counts of documents with each feature, toxic and not, are summed by partition; the smoothed log ratio scales the feature.
A logistic regression on the scaled features follows: each step is one job in which partitions sum their
gradients, so that the driver holds vectors of the fixed space and no rows. A quarter of the training rows is kept
aside; a logistic curve over their margins makes the score a probability at even classes.
Presence makes the score of a long text no sum of its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, as_text, byte_view, free_name, give_back, mix, slices, small_batches, spill
from .labelled import FIT_ROWS, sample

GRAMS = (4, 6, 8)
BITS = 19
THRESHOLD = 0.7
PENALTY = 1e-5
#: Documents added to the counts of both labels, so that a feature met once or twice says little.
SMOOTHING = 5
ASIDE = 4
#: Parts of the sample of at most FIT_ROWS rows, so of what a step sends to the driver.
PARTS = 6
_STEPS, _MEMORY = 25, 4
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray  # by feature
    bias: float


class Features:
    """The features present in each text of a batch."""

    def __init__(self) -> None:
        self._seen = np.zeros(1 << BITS, np.int32)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Per document its distinct features, in no order."""
        raw = data.tobytes()
        texts = [" " + " ".join(raw[a:b].decode("utf-8", "replace").lower().split()) + " " for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        edges = np.r_[0, np.cumsum([len(t) for t in texts])].tolist()
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        value, hashes = code, []
        for n in range(2, GRAMS[-1] + 1):
            value = value[: max(0, len(code) - n + 1)] * _FACTOR + code[n - 1 :]
            if n in GRAMS:
                hashes.append((mix(value + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            found = np.concatenate([h[low : max(low, high - n + 1)] for h, n in zip(hashes, GRAMS, strict=True)])
            number = np.arange(len(found), dtype=np.int32)
            self._seen[found] = number  # of equal features the last is left
            yield found[self._seen[found] == number]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, aside, text) to (y, aside, sizes, features): sorted features in 16-bit halves, ``sizes`` counting each upper half's."""
    features = Features()
    for batch, data, offsets in slices(batches):
        sizes, lows = [], []
        for found in features.of(data, offsets):
            found.sort()
            sizes.append(np.bincount(found >> 16, minlength=1 << (BITS - 16)).astype("<u4").tobytes())
            lows.append(found.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(lows, pa.binary())], ["y", "aside", "sizes", "features"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, the features of all rows, and the ends of each row's."""
    uppers = 1 << (BITS - 16)
    sizes = np.frombuffer(byte_view(batch.column(2))[0].tobytes(), "<u4").astype(np.int64)
    low = np.frombuffer(byte_view(batch.column(3))[0].tobytes(), "<u2")
    feature = np.repeat(np.tile(np.arange(uppers, dtype=np.int32) << 16, batch.num_rows), sizes) + low
    return batch.column(0).to_numpy().astype(float), feature, sizes.reshape(-1, uppers).sum(axis=1)


def _vector(*parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).astype("<f4").tobytes()], pa.binary())], ["sums"])


def _margins(weights: np.ndarray, bias: float, feature: np.ndarray, many: np.ndarray) -> np.ndarray:
    ends = np.cumsum(many)
    sums = np.r_[0, np.cumsum(weights[feature], dtype=np.float64)]
    return sums[ends] - sums[ends - many] + bias


def _margin_rows(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, feature, many = _unpacked(batch)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(_margins(model.weights, model.bias, feature, many))], ["y", "margin"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: rows with each feature, toxic and not, and the two numbers of rows."""
    total = np.zeros((2, 1 << BITS))
    rows = np.zeros(2)
    give_back()
    for batch in batches:
        y, feature, many = _unpacked(batch)
        for label in (0, 1):
            total[label] += np.bincount(feature[np.repeat(y == label, many)], minlength=1 << BITS)
            rows[label] += (y == label).sum()
    yield _vector(total[0], total[1], rows)


def _slopes(state: tuple[np.ndarray, float, np.ndarray]) -> Callable:
    """One row per partition: its part of the loss's slope by weight of feature, by bias, and of the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, share = state
        slope, by_bias, loss = np.zeros(1 << BITS), 0.0, 0.0
        give_back()
        for batch in batches:
            y, feature, many = _unpacked(batch)
            margin = _margins(weights, bias, feature, many)
            part = np.where(y > 0, share[1], share[0])
            loss += part @ np.logaddexp(0, np.where(y > 0, -margin, margin))
            error = part * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
            by_bias += error.sum()
            slope += np.bincount(feature, np.repeat(error, many), minlength=1 << BITS)
        yield _vector(slope, np.array([by_bias, loss]))

    return run


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of one vector per partition of the sample, of which there are PARTS, in the vectors' own order."""
    out = None
    for raw in sorted(bytes(r[0]) for r in parts.collect()):
        vector = np.frombuffer(raw, "<f4").astype(float)
        out = vector if out is None else out + vector
    return out


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = _STEPS, memory: int = _MEMORY) -> np.ndarray:
    """Limited-memory quasi-Newton steps from ``start``, until the loss falls by under half a thousandth."""
    w = start
    loss, slope = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = slope.copy(), []
        for s, g in reversed(past):
            a = (s @ q) / (s @ g)
            used.append(a)
            q -= a * g
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.linalg.norm(q))
        for (s, g), a in zip(past, reversed(used), strict=True):
            q += (a - (g @ q) / (s @ g)) * s
        size = 1.0
        while size > 1e-4:
            new_loss, new_slope = at(w - size * q)
            if new_loss <= loss - 1e-4 * size * (slope @ q):
                break
            size /= 4
        else:
            break
        moved, turned = -size * q, new_slope - slope
        if moved @ turned > 1e-18:
            past = [*past[1 - memory :], (moved.astype(np.float32), turned.astype(np.float32))]
        done = loss - new_loss < 5e-4
        w, slope, loss = w + moved, new_slope, new_loss
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS, penalty: float = PENALTY) -> Model:
    """Fit on at most ``most`` labelled rows. Without rows of both labels the score is their smoothed rate."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = sample(docs, labels, label, most).select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(ASIDE)) == 0).alias("aside"), "text").repartition(PARTS)
    whole = spill(rows.mapInArrow(_featured, "y int, aside boolean, sizes binary, features binary"), "toxicity-sample").coalesce(PARTS)
    packed, aside = whole.where("not aside"), whole.where("aside")
    sums = _summed(packed.mapInArrow(_counts, "sums binary"))
    size = 1 << BITS
    no, yes = sums[-2:] if sums is not None else (0.0, 0.0)
    if not yes or not no:
        return Model(np.zeros(size, np.float32), float(np.log((yes + 0.5) / (no + 0.5))))
    even = SMOOTHING / yes
    ratio = np.log((sums[size : 2 * size] / yes + even) / (sums[:size] / no + even))
    share = np.array([0.5 / no, 0.5 / yes])  # both labels weigh the same

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(((w[:size] * ratio).astype(np.float32), float(w[size]), share))
        got = _summed(packed.mapInArrow(Shared(shared, _slopes), "sums binary"))
        shared.destroy()
        slope = np.r_[got[:size] * ratio + penalty * w[:size], got[size]]
        return got[size + 1] + penalty / 2 * (w[:size] @ w[:size]), slope

    w = minimise(at, np.zeros(size + 1))
    model = Model((w[:size] * ratio).astype(np.float32), float(w[size]))
    # at most FIT_ROWS / ASIDE pairs of numbers, more or less
    margins = aside.mapInArrow(Shared(spark.sparkContext.broadcast(model), _margin_rows), "y double, margin double").toPandas().sort_values(["margin", "y"])
    slope, bias = _curve(margins["margin"].to_numpy(), margins["y"].to_numpy())
    return Model((slope * model.weights).astype(np.float32), slope * model.bias + bias)


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, over zero, and bias of the logistic curve over margins, both labels weighing the same; the straight one without both."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def at(u: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.exp(u[0]) * margin + u[1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        return share @ np.logaddexp(0, np.where(y > 0, -z, z)) + u @ u / len(y), np.array([error @ margin * np.exp(u[0]), error.sum()]) + 2 * u / len(y)

    u = minimise(at, np.zeros(2), 100)
    return float(np.exp(u[0])), float(u[1])


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch, data, offsets in slices(batches):
            margin = np.array([model.weights[found].sum(dtype=np.float64) for found in features.of(data, offsets)]) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], [*batch.schema.names, "_"])

    return run


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the column ``name``, the probability of toxicity; null and empty texts get what no n-gram tells."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(Shared(shared, _score), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, repeated rows each; see ``with_score``.

    Without labels of both classes the score is their smoothed rate. Other columns, whatever their names, are
    left out. A very long text is one step, in memory of some fifty times its size.
    """
    model = fit(docs, labels, most=most)
    return with_score(docs.select("doc_id", as_text().alias("text")), model, "score").select("doc_id", "score")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; all columns stay as they are, and may have any names."""
    name = free_name(docs, "toxic_score")
    return with_score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
