"""SimHash near-duplicates, searched with a hierarchical index in Gray order.

All distinct fingerprints make one index. Sorted by Gray rank they are cut into ranges, the index's
subtrees, each of which a task builds by itself. The nodes above are a small table: one mask and one
pattern of shared bits for each range, at most ``MOST_RANGES`` of them. Every fingerprint goes down
that table, and on to each later range whose accumulated differences it does not exceed; there, and in its own range, it
goes down the subtree. All links come from these two walks. A task keeps the links that span its
clusters, not all pairs, and leaves out groups that a fingerprint is already connected with, so a
crowd of near-equal fingerprints costs no square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, as_text, free_name, lower_table, mix, run_numbers, shuffle_width, slices, small_batches, space_words, spill, squeeze
from .components import components

MOST_BITS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in a range, and how few and how many ranges there are: fewer would leave machines idle, and beyond the most ranges grow.
RANGE, FEWEST_RANGES, MOST_RANGES = 1 << 17, 64, 1 << 16
FAN_OUT = 8
_FRONTIER = 1 << 20


def fingerprints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp): for each bit a majority over XXH64 of all word shingles, repeats included."""
    lower = lower_table()
    for batch, data, offsets in slices(rows):
        joined, starts, ends, first = squeeze(lower[data], offsets, space_words())
        n = np.diff(first)
        many = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
        low = np.repeat(first[:-1], many) + run_numbers(many)
        high = np.minimum(low + SHINGLE, np.repeat(first[1:], many)) - 1
        text = joined.tobytes()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[low].tolist(), ends[high].tolist(), strict=True)), np.uint64, len(low))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_majority(hashes, many).view(np.int64))], ["doc_id", "fp"])


def _majority(hashes: np.ndarray, many: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Per document, the bits set in over half of its hashes."""
    ends = np.cumsum(many)
    totals = np.zeros((len(many), 64), np.int64)
    for low in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[low : low + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = np.searchsorted(ends, np.arange(low, low + len(bits)), "right")
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        totals[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > many[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def wide_fingerprints(hashes: np.ndarray, many: np.ndarray, words: int) -> np.ndarray:
    """Per document the majority bits of ``words`` independent 64-bit hashes of its features, as 0/1 bytes.

    ``hashes`` lie one document after the other, ``many`` (1 at least) of each. Eight bits are counted in
    one addition, in runs of at most 255 features.
    """
    place = run_numbers(many)
    runs = np.flatnonzero(place % 255 == 0)
    own = np.searchsorted(runs, np.cumsum(many) - many)
    out = np.empty((len(many), words, 8, 8), np.uint8)
    for word in range(words):
        x = mix(mix(hashes + np.uint64(word + 1)) + np.uint64(word + 1))
        for k in range(8):
            part = np.add.reduceat((x >> np.uint64(k)) & np.uint64(0x0101010101010101), runs).view(np.uint8).reshape(-1, 8)
            out[:, word, k] = 2 * np.add.reduceat(part, own, axis=0, dtype=np.int64) > many[:, None]
    return out.reshape(len(many), words * 64)


# --- the index ------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code's order: neighbours differ in one bit."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Hamming search over leaves in Gray order, under nodes that hold their shared bits.

    A leaf is a value, or a range of values known by the bits that all of it have (``every``) and
    that any of it has (``some``). A node keeps a mask of the bits on which all below it agree and did not agree
    higher up, and their pattern. Going down, a query's differences under the masks add up,
    and a whole group is left out once they pass the limit.
    """

    def __init__(self, every: np.ndarray, some: np.ndarray | None = None, fan_out: int = FAN_OUT) -> None:
        some = every if some is None else some
        self.fan_out, self.size = fan_out, len(every)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        agreed = []
        while len(every):
            agreed.append((~(every ^ some), every))
            if len(every) == 1:
                break
            heads = np.arange(0, len(every), fan_out)
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
        above = np.zeros(1, np.uint64)
        for mask, pattern in reversed(agreed):
            parent = np.arange(len(mask)) // fan_out if self.levels else np.zeros(1, np.int64)
            self.levels.append((mask & ~above[parent], pattern))
            above = mask

    def within(self, queries: np.ndarray, most: int, skip: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, leaf number) pairs whose accumulated differences are at most ``most``, in parts.

        ``skip(level, node, query)`` may leave out more. The front of a part is halved where it grows large,
        so memory is bounded.
        """
        if not self.size or not len(queries):
            return
        open_ = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64))]
        while open_:
            level, query, node, spent = open_.pop()
            if len(query) > _FRONTIER:
                half = len(query) // 2
                open_ += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
                continue
            mask, pattern = self.levels[level]
            spent = spent + np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
            kept = spent <= most
            if skip is not None:
                kept &= ~skip(level, node, query)
            query, node, spent = query[kept], node[kept], spent[kept]
            if level + 1 == len(self.levels):
                yield query, node
                continue
            low = node * self.fan_out
            many = np.minimum(low + self.fan_out, len(self.levels[level + 1][0])) - low
            open_.append((level + 1, np.repeat(query, many), np.repeat(low, many) + run_numbers(many), np.repeat(spent, many)))


class _Subtree:
    """The index of one range, and which of its values are connected so far."""

    def __init__(self, values: np.ndarray, most: int) -> None:
        self.values, self.most = values[np.argsort(gray_rank(values), kind="stable")], most
        self.index = GrayIndex(self.values)
        self.root = np.arange(len(values))
        self._relabel()

    def _relabel(self) -> None:
        """Per node the cluster that all below it are in, or -1."""
        low = high = self.root[: len(self.values)]
        labels = [low]
        while len(low) > 1:
            heads = np.arange(0, len(low), self.index.fan_out)
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            labels.append(np.where(low == high, low, -1))
        self.labels = labels[::-1]

    def own_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, step = 0, 64
        while at < len(self.values):
            yield from self._links(np.arange(at, min(at + step, len(self.values))), self.values[at : at + step])
            at, step = at + step, min(1024, 2 * step)

    def visit(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links with values of other ranges; those are forgotten afterwards, what they connect is not."""
        n = len(self.values)
        for at in range(0, len(queries), 1024):
            part = queries[at : at + 1024]
            self.root = np.r_[self.root, n + np.arange(len(part))]
            yield from self._links(n + np.arange(len(part)), part)
            # a cluster is named by its smallest member, so no value of this range is named by a visitor
            self.root = self.root[:n]

    def _links(self, place: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def connected(level: int, node: np.ndarray, query: np.ndarray) -> np.ndarray:
            return self.labels[level][node] == self.root[place[query]]

        for query, found in self.index.within(part, self.most, connected):
            i, j = self._unite(place[query], found)
            if len(i):
                self._relabel()
                yield part[i - place[0]], self.values[j]

    def _unite(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connects i with j; the pairs that were needed for it."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while True:
            p, q = self.root[i], self.root[j]
            new = p != q
            if not new.any():
                return np.concatenate(a), np.concatenate(b)
            i, j, p, q = i[new], j[new], p[new], q[new]
            hung, first = np.unique(np.maximum(p, q), return_index=True)
            self.root[hung] = np.minimum(p, q)[first]
            a.append(i[first])
            b.append(j[first])
            while True:
                again = self.root[self.root]
                if (again == self.root).all():
                    break
                self.root = again


# --- the index over a cluster of machines ----------------------------------------------------


def _visits(upper: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> Callable:
    """Rows (range, fp) to (range, guest, fp): itself, and as a guest in the later ranges it may have links in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, every, some, most = upper
        index = GrayIndex(every, some)
        for batch in batches:
            home, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            to, who = [home], [np.arange(len(fp))]
            for query, leaf in index.within(fp, most):
                later = numbers[leaf] > home[query]
                to.append(numbers[leaf[later]])
                who.append(query[later])
            who = np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), pa.array(np.arange(len(who)) >= len(fp)), pa.array(fp[who].view(np.int64))], ["range", "guest", "fp"])

    return run


def _range_links(most: int) -> Callable:
    """Over rows (range, guest, fp) sorted by range and guest: links (a, b) found in the subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, tree = None, [], None

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def planted() -> _Subtree:
            return _Subtree(np.concatenate(members) if members else np.empty(0, np.uint64), most)

        for batch in batches:
            where, guest, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (guest[1:] != guest[:-1])]) if len(where) else []
            for low, high in zip(cuts, [*cuts[1:], len(where)], strict=True):
                if where[low] != now:
                    if now is not None and tree is None:
                        yield from out(planted().own_links())
                    now, members, tree = where[low], [], None
                if not guest[low]:
                    members.append(fp[low:high])
                    continue
                if tree is None:
                    tree = planted()
                    yield from out(tree.own_links())
                yield from out(tree.visit(fp[low:high]))
        if now is not None and tree is None:
            yield from out(planted().own_links())

    return run


def _ranged(bounds: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = gray_rank(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, rank, "left").astype(np.int32)), batch.column(0)], ["range", "fp"])

    return run


def near_links(fps: DataFrame, most: int = MOST_BITS, range_size: int = RANGE, fewest: int = FEWEST_RANGES) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that keep every cluster connected, for any ``most``."""
    spark, n = fps.sparkSession, shuffle_width(fps.sparkSession)
    ranges = min(MOST_RANGES, max(fewest, -(-fps.count() // range_size)))
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # the ranks that part the ranges, about; as signed numbers of the same order
    shares = [k / ranges for k in range(1, ranges)]
    signed = fps.agg(F.percentile_approx(rank.bitwiseXOR(F.lit(-(1 << 63))), shares, max(10_000, 20 * ranges))).first()[0] if shares else []
    bounds = np.array(signed or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    ranged = spill(fps.select("fp").mapInArrow(Shared(spark.sparkContext.broadcast(bounds), _ranged), "range int, fp long"), "simhash-ranges")
    upper = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.bit_and("fp"), F.bit_or("fp")).collect())  # at most MOST_RANGES rows
    numbers, every, some = (np.array([r[k] for r in upper], np.int64) for k in range(3))
    shared = spark.sparkContext.broadcast((numbers, every.view(np.uint64), some.view(np.uint64), most))
    dealt = ranged.mapInArrow(Shared(shared, _visits), "range int, guest boolean, fp long")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "guest").mapInArrow(_range_links(most), "a long, b long")


def simhash(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``docs`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links of at most ``most`` bits; doc_id may be of any type
    that has an order. Null and empty texts, and those of white space, have fingerprint zero and link like
    any other. Rows with equal texts share a component; repeated rows come back as often. A null doc_id counts
    in no minimum, and its component is null only if every member's is. Other columns, whatever their names,
    are left out. A very long text is a step of its own, in memory of some ten times its size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    fps = spill(docs.select("doc_id", as_text().alias("text")).mapInArrow(fingerprints, f"doc_id {kind}, fp long"), "simhash")
    distinct = spill(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    whole = components(near_links(distinct.select("fp"), most))
    member = distinct.join(whole.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest doc_id.

    All columns stay. Of rows that repeat a doc_id the one whose text is smallest, null as empty, stays; if
    texts are equal too, so are the rows as far as this operator goes, and any stays. A null doc_id stays
    only in a component that has no other.
    """
    keep = free_name(docs, "keep")
    found = simhash(docs, most).select("component_id").distinct().withColumnRenamed("component_id", keep)
    stay = docs.join(found, docs["doc_id"].eqNullSafe(found[keep]), "left_semi")
    return stay.groupBy(F.col("doc_id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), as_text()).alias(keep)).select(f"{keep}.*")
