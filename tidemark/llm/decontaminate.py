"""Benchmark passages in documents, by a prefix-filtered set join.

An item becomes windows of ``WINDOW`` consecutive words, a window the set of its ``SHINGLE``-word
shingles with their offsets. A document holds a window only if it holds all of its shingles, so one
necessary token is joined: the shingle rarest in the corpus. A match at a place gives the
one place where the window can start; length and position rule out starts before the document's first word
or ends after its last, and what is left is compared word for word.

The documents are read twice, however large the benchmark is: once to count the items' shingles, once to find the
prefixes. Either time a bit table of fixed size tells in the scan which shingles may be meant; only these, with the words around
them, are joined with the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, Shared, as_text, free_name, letter_words, lower_table, run_numbers, slices, small_batches, spill, squeeze

WINDOW = 10
SHINGLE = 5
#: Bits of the table that is sent to executors, as a power of two: its size does not grow with the benchmark.
TABLE_BITS = 24
_BLOCK = 1 << 15  # bits in Spark's bitmaps


def item_windows(window: int) -> Callable:
    """Rows (item_id, text) to (item_id, window, size, token, offset): one row for each shingle of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=1 << 17):
            joined, starts, ends, first = squeeze(lower_table()[data], offsets, letter_words())
            n = np.diff(first)
            many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
            low, size, owner = np.repeat(first[:-1], many) + run_numbers(many), np.repeat(np.minimum(n, window), many), np.repeat(np.arange(len(n)), many)
            shingle = np.minimum(size, SHINGLE)
            count = size - shingle + 1
            at, of = np.repeat(low, count) + run_numbers(count), np.repeat(np.arange(len(low)), count)
            token = RangeHash(joined).of(starts[at], ends[at + shingle[of] - 1])
            raw = joined.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[low].tolist(), ends[low + size - 1].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[of])), texts.take(pa.array(of)), pa.array(size[of].astype(np.int32)), pa.array(token.view(np.int64)), pa.array(run_numbers(count).astype(np.int32))], ["item_id", "window", "size", "token", "offset"])

    return run


def _bit(token):
    return F.shiftrightunsigned(token, 64 - TABLE_BITS)


def bit_table(tokens: DataFrame) -> np.ndarray:
    """Which upper bits ``tokens`` (token) have: at most 512 rows of 4096 bytes come to the driver, whatever is in them."""
    bits = tokens.select(_bit(F.col("token")).alias("bit"))
    blocks = bits.groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(_BLOCK - 1))).alias("bits")).collect()
    table = np.zeros(1 << TABLE_BITS, bool)
    for row in blocks:
        table[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
    return np.packbits(table)


class _Tokens:
    """Shingles of documents that the table has."""

    def __init__(self, packed: np.ndarray, lengths: list[int]) -> None:
        self.table, self.lengths = np.unpackbits(packed).view(bool), lengths

    def of(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each."""
        hashes, places, tokens = RangeHash(joined), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for size in self.lengths:
            many = np.maximum(np.diff(first) - size + 1, 0)
            at = np.repeat(first[:-1], many) + run_numbers(many)
            token = hashes.of(starts[at], ends[at + size - 1])
            met = np.flatnonzero(self.table[token >> np.uint64(64 - TABLE_BITS)])
            places.append(at[met])
            tokens.append(token[met])
        return np.concatenate(places), np.concatenate(tokens)


def _counted(shared: tuple[np.ndarray, list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(*shared)
        for _, data, offsets in slices(batches):
            _, token = tokens.of(*squeeze(lower_table()[data], offsets, letter_words()))
            token, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def _met(window: int) -> Callable:
    """Rows (doc_id, tie, text) to (doc_id, tie, n_words, met): per met token its word, how many words are shown before it, and these words."""

    def made(shared: tuple[np.ndarray, list[int]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _Tokens(*shared)
            for batch, data, offsets in slices(batches):
                joined, starts, ends, first = squeeze(lower_table()[data], offsets, letter_words())
                word, token = tokens.of(joined, starts, ends, first)
                order = np.argsort(word, kind="stable")
                word, token = word[order], token[order]
                doc = np.searchsorted(first, word, "right") - 1
                low, high = np.maximum(word - window + 1, first[doc]), np.minimum(word + window, first[doc + 1])
                raw = joined.tobytes()
                shown = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[low].tolist(), ends[high - 1].tolist(), strict=True)]
                items = pa.StructArray.from_arrays([pa.array(token.view(np.int64)), pa.array(word - first[doc]), pa.array((word - low).astype(np.int32)), pa.array(shown, pa.string())], ["token", "word", "before", "shown"])
                edges = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(edges), items)], ["doc_id", "tie", "n_words", "met"])

        return run

    return made


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, found) with found windows to (doc_id, tie, n_hit, spans) with spans of hit words."""
    for batch in batches:
        found = batch.column(2)
        many = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        low = found.flatten().field("start").to_numpy(zero_copy_only=False)
        high = low + found.flatten().field("size").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(many)), many)
        order = np.lexsort((low, owner))
        low, high, owner = low[order], high[order], owner[order]
        # a document's windows are put after the ends of those before it, so that one running maximum serves all
        shift = np.r_[0, np.cumsum(np.maximum.reduceat(high, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])) + 1)][owner] if len(owner) else owner
        reach = np.maximum.accumulate(high + shift) if len(owner) else high
        heads = np.flatnonzero(np.r_[True, (low + shift)[1:] > reach[:-1]]) if len(owner) else owner
        start, end = low[heads], (reach[np.r_[heads[1:] - 1, len(reach) - 1]] - shift[heads]) if len(heads) else reach
        edges = np.r_[0, np.cumsum(np.bincount(owner[heads], minlength=len(many)))].astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        n_hit = np.diff(np.r_[0, np.cumsum(end - start)][edges])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit), spans], ["doc_id", "tie", "n_hit", "spans"])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, n_words) of each row of ``docs`` (doc_id, tie, text), and (doc_id, tie, n_hit, spans, items) where a window is met."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.select(F.col("item_id").cast("string").alias("item_id"), as_text().alias("text")).where("text <> ''")
    windows = spill(items.mapInArrow(item_windows(window), "item_id string, window string, size int, token long, offset int"), "windows")
    # the few sizes there are: shingles of SHINGLE words, or of all words of shorter items
    lengths = sorted({min(r["size"], SHINGLE) for r in windows.select("size").distinct().collect()})
    shared = spark.sparkContext.broadcast((bit_table(windows.select("token").distinct()), lengths))
    counts = docs.select("text").mapInArrow(Shared(shared, _counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # a shingle that no document has rules its windows out; the rarest is the prefix
    rare = windows.select("window", "size", "token", "offset").distinct().join(counts, "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("least"))
    prefixes = spill(rare.where("least.n > 0").select("window", "size", "least.token", "least.offset"), "prefixes")
    found = spark.sparkContext.broadcast((bit_table(prefixes.select("token")), lengths))
    scanned = spill(docs.select("doc_id", "tie", "text").mapInArrow(Shared(found, _met(window)), f"doc_id {kind}, tie long, n_words long, met array<struct<token:long,word:long,before:int,shown:string>>"), "met")
    some = scanned.where("size(met) > 0").select("doc_id", "tie", "n_words", F.explode("met").alias("m")).select("doc_id", "tie", "n_words", "m.*").distinct()
    start = F.col("word") - F.col("offset")
    fits = (F.col("offset") <= F.col("before")) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("shown", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    matched = spill(some.join(prefixes, "token").where(fits).where(same).select("doc_id", "tie", start.alias("start"), "size", "window").distinct(), "matched")
    spans = matched.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "size")).alias("found")).mapInArrow(_merged, f"doc_id {kind}, tie long, n_hit long, spans array<struct<start:long,end:long>>")
    names = matched.select("doc_id", "tie", "window").distinct().join(windows.select("window", "item_id").distinct(), "window").groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "n_hit", "spans")
    joined = names.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "n_hit", "spans", "items")
    return scanned.select("doc_id", "tie", "n_words"), spill(joined, "hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of ``docs``.

    n_hit counts words in windows of items (item_id, text), items are their sorted names, spans runs of hit words.
    Null and empty texts have no words: such items are never met, such documents never hit. Items that
    share an item_id count once; one whose item_id is null marks words but has no name. Repeated documents are
    treated alike, row by row; doc_id may be null and of any type. Other columns, whatever their names, are left
    out. A very long text is one step.
    """
    whole, hit = hits(docs.select("doc_id", F.xxhash64(as_text()).alias("tie"), as_text().alias("text")), items, window)
    hit = hit.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "n_hit", "spans", "items")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>")}
    out = whole.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return out.select("doc_id", "n_words", *[F.coalesce(k, v).alias(k) for k, v in none.items()])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; all columns stay, and may have any names. See ``contamination``."""
    tie = free_name(docs, "hit_tie")
    keyed = docs.withColumn(tie, F.xxhash64(as_text()))
    _, hit = hits(keyed.select("doc_id", F.col(tie).alias("tie"), as_text().alias("text")), items, window)
    hit = hit.select(F.col("doc_id").alias(f"{tie}_id"), F.col("tie").alias(f"{tie}_of"))
    return keyed.join(hit, keyed["doc_id"].eqNullSafe(hit[f"{tie}_id"]) & (keyed[tie] == hit[f"{tie}_of"]), "left_anti").drop(tie)
