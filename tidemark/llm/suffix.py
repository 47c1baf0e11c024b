"""Removal of repeated passages: each byte of a ``length``-byte string that also starts earlier.

Every window of ``length`` bytes is filed under the smallest hash among its grams, the leftmost if several are
equal. Equal windows have equal smallest grams, so windows under different grams need no comparison.
Neighbouring windows under one gram make a *unit* of about forty windows. Hashes only file and leave out; which
windows repeat is read from sorted suffixes. A round goes like this:

1. Each slice of documents gives its units as rows of numbers, no text. A unit alone under its gram cannot repeat
   and goes no further. What a task has met twice is known not to be alone: it gives one row under its gram, so that a
   gram in very many documents gives a row for each task.
2. The text of the other units is cut out of their documents and dealt by gram. A two-stage suffix sort and the
   common prefixes of neighbours find equal windows of one gram, and all but the first of each are repeats.
3. A gram with over ``PART`` bytes is dealt in that many parts, so no task gathers a crowd, whether its texts are equal or not.
   Windows that are first in their part, but may have equals in another, have a round of their own under longer
   grams, in the end under whole windows, until none is crowded.

Order is by doc_id, then by start. Results don't depend on slices or partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, as_text, byte_view, free_name, lookup, mix, run_numbers, shuffle_width, slices, small_batches, spill

LENGTH = 100
#: Bytes of one key that are sorted together.
PART = 1 << 19
#: Grams that a task remembers to have met twice.
REMEMBERED = 1 << 20
_PIECE, _CUT = 1 << 21, 1 << 19
_PLACE_BITS = np.uint64(28)

# --- suffix sorting -------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number."""
    out = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        out |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def _sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their suffixes' first ``depth`` bytes; eight at a time, and only ties that differ."""
    key = words[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    head = np.r_[True, key[1:] != key[:-1]][: len(key)]
    slots, mine = np.arange(len(places)), places
    for at in range(8, depth + 8, 8):
        tied = ~(head & np.r_[head[1:], True][: len(head)])
        slots, mine, head = slots[tied], mine[tied], head[tied]
        if at >= depth or not len(mine):
            break
        key, heads, group = words[mine + at], np.flatnonzero(head), np.cumsum(head) - 1
        odd = np.zeros(len(heads), bool)
        odd[group[key != key[heads][group]]] = True
        if odd.any():
            unsorted = np.flatnonzero(odd[group])
            mixed = (np.cumsum(odd) - 1)[group[unsorted]]
            order = np.argsort(key[unsorted])
            mixed = mixed[order]
            order = order[np.argsort(mixed.astype(np.uint16) if odd.sum() < 1 << 16 else mixed, kind="stable")]
            mine[unsorted], key[unsorted] = mine[unsorted[order]], key[unsorted[order]]
            places[slots] = mine
            head[1:] |= key[1:] != key[:-1]
    return places


def suffix_order(data: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """All places of ``data``, or the ``wanted`` ones, in the order of their suffixes' first ``depth`` bytes at least.

    Two-stage: suffixes smaller than their successors are sorted directly; a scan of the buckets
    of first bytes, from the left, puts every other suffix in its bucket when its successor is
    met. A bucket is scanned as whole arrays, again for what it adds to itself. Of the places not wanted
    only those take part that a wanted one is induced from.
    """
    n = len(data)
    text = np.r_[data, np.zeros(depth + 16, np.uint8)]
    size = n + 1  # one end mark, smaller than all: it only starts the scan
    # smaller than the successor: the next different byte is larger
    change = np.flatnonzero(np.r_[text[1:size] != text[: size - 1], True])
    at = np.repeat(change, np.diff(np.r_[-1, change]))[:n]
    smaller = (text[np.minimum(at + 1, size - 1)] > text[:n]) & (at < n - 1)
    needed = np.ones(n, bool)
    if wanted is not None and n:
        ends = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
        first = np.flatnonzero(wanted & ~smaller)
        needed = wanted | (np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(ends[first] + 1, minlength=n + 1))[:n] > 0)
    direct = _sort_directly(np.flatnonzero(smaller & needed), _words(text), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced = needed & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(now: np.ndarray, byte: int) -> np.ndarray:
        before = now[now > 0] - 1
        before = before[induced[before]]
        first = text[before]
        own = before[first == byte]
        before, first = before[first != byte], first[first != byte]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                waiting[first[low]].append(before[low:high])
        return own

    if n and induced[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    for byte in range(256):
        now = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        waiting[byte] = []
        while len(now):
            out.append(now)
            now = scan(now, byte)
        now = direct[edges[byte] : edges[byte + 1]]
        if len(now):
            out.append(now)
            scan(now, byte)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each of ``order`` but the first, how many bytes, ``most`` at most, its suffix shares with the one before."""
    words = _words(np.r_[data, np.zeros(most + 16, np.uint8)])
    out = np.full(max(0, len(order) - 1), most)
    live, a, b = np.arange(len(out)), order[:-1], order[1:]
    for at in range(0, most, 8):
        differ = words[a + at] ^ words[b + at]
        odd = differ != 0
        if odd.any():
            value = differ[odd]
            out[live[odd]] = at + sum((value < np.uint64(1 << (8 * shift))).astype(np.int64) for shift in range(1, 8))
            live, a, b = live[~odd], a[~odd], b[~odd]
    return np.minimum(out, most)


# --- units ----------------------------------------------------------------------------------


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(keys) - width + 1
    padded = np.r_[keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def grams(length: int) -> tuple[int, int, int]:
    """Bytes in the grams that windows are filed under at first, in crowds, and in crowds among those."""
    return max(1, length // 5), max(1, 3 * length // 5), length


def units(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, gram hash) of each unit."""
    whole = np.maximum(np.diff(offsets) - length + 1, 0)
    if not whole.any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    every = RangeHash(data).every(gram)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    best = (_smallest((every & ~mask) | np.arange(len(every), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
    window = np.repeat(offsets[:-1], whole) + run_numbers(whole)
    owner = np.repeat(np.arange(len(whole)), whole)
    anchor = best[window]
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    return owner[heads], window[heads], np.diff(np.r_[heads, len(window)]), every[anchor[heads]]


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """Slices of documents; a very long one in pieces that share ``length - 1`` bytes."""
    for batch, data, offsets in slices(batches):
        for low in range(0, max(1, len(data) - length + 1), _PIECE) if len(offsets) == 2 else (0,):
            high = min(len(data), low + _PIECE + length - 1) if len(offsets) == 2 else len(data)
            yield batch, data[low:high], np.clip(offsets, low, high) - low, low


_UNIT = "route long, gram long, met int, _id long, _tie long, base int, start int, windows int"


def unit_rows(length: int, gram: int) -> Callable:
    """Rows (_id, _tie, base, text) to units; start counts from base, where text starts in its document.

    A unit met once goes under its gram. The others go each under a number of their own, with their gram and ``met`` 2,
    and for them one row without windows goes under the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.empty(0, np.uint64)
        for batch, data, offsets, low in _pieces(batches, length):
            owner, first, count, key = units(data, offsets, length, gram)
            start = first - offsets[owner] + (low if len(offsets) == 2 else 0)
            found, many = np.unique(key, return_counts=True)
            new = np.setdiff1d(found[many > 1], twice, assume_unique=True)
            known = (lookup(key, twice) >= 0) | (lookup(key, new) >= 0)
            if len(twice) + len(new) <= REMEMBERED:
                twice = np.union1d(twice, new)
            none = np.zeros(len(new), np.int64)
            route = np.r_[np.where(known, mix(key + mix(start.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32)))), key), new]
            met, starts, windows = (pa.array(np.r_[x, y].astype(np.int32)) for x, y in ((known + 1, none + 2), (start, none), (count, none)))
            ids = pa.array(np.r_[owner, none])
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(np.r_[key, new].view(np.int64), mask=np.r_[~known, none == 0]), met, *(batch.column(i).take(ids) for i in range(3)), starts, windows], ["route", "gram", "met", "_id", "_tie", "base", "start", "windows"])

    return run


def _ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Ranges of bytes as binary values."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[np.repeat(start, size) + run_numbers(size)])])


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """List lengths, and all items of a list column."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def cut_units(length: int) -> Callable:
    """Rows (_id, _tie, base, open, text, ...) to (gram, part, _id, _tie, start, windows, piece), start counting in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            many, items = _flat(batch.column(3))
            start, windows = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "windows"))
            owner = np.repeat(np.arange(len(many)), many)
            base = batch.column(2).to_numpy(zero_copy_only=False)[owner]
            # some text at a time: units overlap, so that all may be many times the slice
            size = windows + length - 1
            cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + _CUT, _CUT), "right"))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part, own = slice(low, high), pa.array(owner[low:high])
                piece = _ranges(data, offsets[owner[part]] + start[part], size[part])
                yield pa.RecordBatch.from_arrays([items.field("gram")[part], items.field("part")[part], batch.column(0).take(own), batch.column(1).take(own), pa.array((base + start)[part].astype(np.int32)), pa.array(windows[part].astype(np.int32)), piece], ["gram", "part", "_id", "_tie", "start", "windows", "piece"])

    return run


def _spans(repeat: np.ndarray, owner: np.ndarray, offset: np.ndarray, length: int):
    """Runs of repeated windows: (unit, first window, bytes covered)."""
    at = np.flatnonzero(repeat)
    new = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])] if len(at) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(at)])
    return owner[at[heads]], offset[at[heads]], size + length - 1


_FOUND = "kind string, _id long, _tie long, start int, size int, piece binary"


def compare_units(length: int, crowded: bool) -> Callable:
    """Rows (gram, part, _id, _tie, start, windows, piece) sorted by gram and part to found runs of windows.

    Kind ``repeat`` is a span of bytes to remove. Where ``crowded``, ``first`` is a run of the windows that come first
    in their part, with its text.
    """

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, ties, start = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        order = np.lexsort((start, ties, ids))  # so that a window's number tells which comes first
        rows, start = rows.take(pa.array(order)), start[order]
        windows = rows.column(5).to_numpy().astype(np.int64)
        data, offsets = byte_view(rows.column(6))
        offset = run_numbers(windows)
        place = np.repeat(offsets[:-1], windows) + offset
        owner = np.repeat(np.arange(len(windows)), windows)
        back = np.zeros(len(data), np.int64)
        back[place] = np.arange(len(place))
        wanted = np.zeros(len(data), bool)
        wanted[place] = True
        order = suffix_order(data, length, wanted)
        heads = np.flatnonzero(np.r_[True, common_prefixes(data, order, length) < length][: len(order)])
        repeat = np.ones(len(place), bool)
        if len(heads):
            repeat[np.minimum.reduceat(back[order], heads)] = False
        again, first = _spans(repeat, owner, offset, length), _spans(~repeat & crowded, owner, offset, length)
        unit, at, size = (np.concatenate(x) for x in zip(again, first, strict=True))
        kinds = pa.array(np.repeat(["repeat", "first"], [len(again[0]), len(first[0])]), pa.string())
        piece = pa.concat_arrays([pa.nulls(len(again[0]), pa.binary()), _ranges(data, offsets[first[0]] + first[1], first[2])])
        take = pa.array(unit)
        return pa.RecordBatch.from_arrays([kinds, rows.column(2).take(take), rows.column(3).take(take), pa.array((start[unit] + at).astype(np.int32)), pa.array(size.astype(np.int32)), piece], ["kind", "_id", "_tie", "start", "size", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            sizes = byte_view(batch.column(6))[1]
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + PART, "right")) - 1)
                held.append(batch.slice(low, high - low))
                low = high
                if sum(x.column(6).nbytes for x in held) >= PART:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    gram, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                    last = int(np.argmax((gram == gram[-1]) & (part == part[-1])))
                    if last:
                        yield solve(rows.slice(0, last))
                    held = [pa.RecordBatch.from_arrays([x.slice(last) for x in rows.columns], rows.schema.names)]
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


_FOUND = "kind string, _id long, _tie long, start int, size int, piece binary"


def _round(texts: DataFrame, place: list[str], length: int, gram: int, part_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs found among the windows of ``texts``, which ``place`` tells apart, filed under grams of ``gram`` bytes.

    The second is what crowded grams give, already written, None without any.
    """
    n = shuffle_width(texts.sparkSession)
    own = [free_name(texts, f"cut_{k}") for k in ("id", "tie", "base", "open")]
    base = F.col(place[2]) if len(place) > 2 else F.lit(0)
    named = texts.select(F.col(place[0]).alias("_id"), F.col(place[1]).alias("_tie"), base.alias("base"), "text")
    rows = named.mapInArrow(unit_rows(length, gram), _UNIT).withColumn("n", F.sum("met").over(Window.partitionBy("route")))
    units_ = spill(rows.where("n > 1 and windows > 0").select(F.coalesce("gram", "route").alias("gram"), "_id", "_tie", "base", "start", "windows"), "units")
    size = F.sum(F.col("windows").cast("long") + (length - 1))
    crowds = spill(units_.groupBy("gram").agg(F.ceil(size / part_bytes).cast("int").alias("parts")).where("parts > 1"), "crowds")

    def found(some: DataFrame, crowded: bool) -> DataFrame:
        item = F.struct("gram", "part", "start", "windows")
        lists = some.groupBy(*[F.col(k).alias(p) for k, p in zip(("_id", "_tie", "base"), place)]).agg(F.collect_list(item).alias(own[3]))
        # all columns go along, though only the text is read, so that a later join of all of them uses this shuffle again
        with_text = lists.join(texts, place).select(F.col(place[0]).alias(own[0]), F.col(place[1]).alias(own[1]), base.alias(own[2]), own[3], "text", *[f"`{c}`" for c in texts.columns if c not in ("text", *place)])
        cut = with_text.mapInArrow(cut_units(length), "gram long, part int, _id long, _tie long, start int, windows int, piece binary")
        return cut.repartition(n, "gram", "part").sortWithinPartitions("gram", "part").mapInArrow(compare_units(length, crowded), _FOUND)

    if crowds.isEmpty():
        return found(units_.withColumn("part", F.lit(0)), False), None
    part = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("_id", "_tie", "base", "start"), F.col("parts"))).cast("int")
    dealt = units_.join(crowds, "gram", "left").withColumn("part", part)
    return found(dealt.where("part < 0"), False), spill(found(dealt.where("part >= 0"), True), "crowded")


def repeated_spans(texts: DataFrame, place: list[str], length: int = LENGTH, part_bytes: int = PART) -> DataFrame:
    """(_id, _tie, start, size) spans of bytes to remove from ``texts`` (text, and ``place``, which gives _id and _tie); they may overlap."""
    widths = iter(grams(length))
    out, crowd = _round(texts, place, length, next(widths), part_bytes)
    while crowd is not None:
        out = out.unionByName(crowd)
        firsts = crowd.where("kind = 'first'").select("_id", "_tie", F.col("start").alias("base"), F.col("piece").alias("text"))
        found, crowd = _round(firsts, ["_id", "_tie", "base"], length, next(widths, length), part_bytes)
        out = out.unionByName(spill(found, "uncrowded"))
    return out.where("kind = 'repeat'").select("_id", "_tie", "start", "size")


# --- applying -------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` with two more columns that tell documents apart and their order, the same with each document once, and the columns' names.

    _id is doc_id if that is a whole number, else its place among all; _tie is a hash of the text where a doc_id repeats.
    """
    names = [free_name(docs, "_id"), free_name(docs, "_tie")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.withColumn("text", as_text())
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # a null comes before all others, so before the smallest number too
        null = F.col("doc_id").isNull()
        out = out.withColumn(names[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(names[1], F.lit(0).cast("long"))
        repeats = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).count().where("count > 1").limit(1).count()
        tie = F.when(null, F.shiftrightunsigned(F.xxhash64("text"), 1) - (1 << 62) - (1 << 62)).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 1))
    else:
        order = spill(docs.select("doc_id").distinct().orderBy(F.col("doc_id").asc_nulls_first()).select(F.col("doc_id").alias(names[1]), F.monotonically_increasing_id().alias(names[0])), "places")
        out = out.join(order, F.col("doc_id").eqNullSafe(F.col(names[1]))).drop(names[1]).withColumn(names[1], F.lit(0).cast("long"))
        repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
        tie = F.xxhash64("text")
    if repeats:
        out = out.withColumn(names[1], tie)
    return out, out.dropDuplicates(names) if repeats else out, names


def with_spans(docs: DataFrame, name: str, length: int = LENGTH) -> DataFrame:
    """``docs`` (text never null) with the column ``name``, the list of (start, size) to remove, null if none."""
    small_batches(docs.sparkSession)
    named, once, place = keyed(docs)
    lists = repeated_spans(once, place, length).groupBy(F.col("_id").alias(place[0]), F.col("_tie").alias(place[1])).agg(F.collect_list(F.struct("start", "size")).alias(name))
    return named.join(lists, place, "left").select(*[f"`{c}`" for c in docs.columns], name)


def _merged(column: pa.Array, sizes: np.ndarray):
    """For each row the list's spans, merged: row numbers, starts, ends."""
    many, items = _flat(column)
    start = items.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + items.field("size").to_numpy(zero_copy_only=False)
    base = np.cumsum(sizes + 1) - sizes - 1  # a gap between rows keeps their spans apart
    owner = np.repeat(np.arange(len(many)), many)
    order = np.argsort(start + base[owner], kind="stable")
    owner, start, end = owner[order], start[order] + base[owner[order]], end[order] + base[owner[order]]
    reach = np.maximum.accumulate(end) if len(end) else end
    heads = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.empty(0, np.int64)
    owner, low = owner[heads], start[heads]
    high = reach[np.r_[heads[1:] - 1, len(reach) - 1]] if len(heads) else reach
    return owner, low - base[owner], high - base[owner]


def _removed(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    steps = np.zeros(len(data) + 1, np.int8)
    np.add.at(steps, offsets[owner] + low, 1)
    np.add.at(steps, offsets[owner] + high, -1)
    return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, _spans) to counts, spans and the SHA-256 of the bytes kept."""
    for batch, data, offsets in slices(batches):
        sizes = np.diff(offsets)
        owner, low, high = _merged(batch.column(2), sizes)
        kept = ~_removed(data, offsets, owner, low, high)
        left = np.r_[0, np.cumsum(kept)][offsets]
        raw = data[kept].tobytes()
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        count = np.bincount(owner, minlength=len(sizes))
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sizes - np.diff(left)), pa.array(count), pa.array(digests, pa.string()), spans], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs``.

    A null text is empty; texts under ``length`` bytes lose nothing. Rows that repeat both
    doc_id and text are one document, and each gets its result; rows with one doc_id and different
    texts are ordered by a hash of the text. doc_id may be of any type that has an order; null comes before all
    others. Other columns are left out. A very long text is sorted in pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs.select("doc_id", "text"), "_spans", length).mapInArrow(summary, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def _kept_text(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            names = batch.schema.names
            owner, low, high = _merged(batch.column(names.index(name)), np.diff(offsets))
            kept = ~_removed(data, offsets, owner, low, high)
            # a character stays whole if any of its bytes stays
            heads = np.flatnonzero((data & 0xC0) != 0x80)
            if len(heads):
                kept = np.repeat(np.logical_or.reduceat(kept, heads), np.diff(np.r_[heads, len(data)]))
            ends = np.r_[0, np.cumsum(kept)][offsets].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[kept])])
            yield pa.RecordBatch.from_arrays([text if k == "text" else batch.column(i) for i, k in enumerate(names) if k != name], [k for k in names if k != name])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; every row stays, all columns stay.

    As ``repeats``, but a character of which any byte is kept is kept whole, so that the text stays
    valid. A null text becomes empty. Columns may have any names.
    """
    name = free_name(docs, "_spans")
    return with_spans(docs, name, length).mapInArrow(_kept_text(name), docs.schema)
