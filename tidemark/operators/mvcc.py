"""Multi-version key/value reads over a log of SET, CLEAR and CLEAR_RANGE (v, op, k, s, e, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import filled_forward, running


def points(log: DataFrame) -> DataFrame:
    return log.where("op <> 'CLEAR_RANGE'").select("k", "v", "op", "val")


def clears(log: DataFrame) -> DataFrame:
    """Non-empty half-open range clears."""
    return log.where("op = 'CLEAR_RANGE' and s < e").select("v", "s", "e")


def latest_points(log: DataFrame, at: int | Column) -> DataFrame:
    """The newest SET or CLEAR per key at version ``at``: (k, v, op, val)."""
    newest = points(log).where(F.col("v") <= at).groupBy("k").agg(F.max("v").alias("v"), F.max_by(F.struct("op", "val"), "v").alias("_x"))
    return newest.select("k", "v", "_x.op", "_x.val")


def latest_clear_by_key(log: DataFrame, at: int | Column) -> DataFrame:
    """(k, cleared_at) for integer keys: ranges are spelt out, so the join that follows is on equality.

    For ranges of bounded width; ``covered_by`` takes any.
    """
    return clears(log).where(F.col("v") <= at).select("v", F.explode(F.sequence("s", F.col("e") - 1)).alias("k")).groupBy("k").agg(F.max("v").alias("cleared_at"))


def inside(log: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """What of the log can change keys in [start, end): its points there, and its range clears cut to it."""
    point, out = F.col("op") != "CLEAR_RANGE", log
    if start is not None:
        out = out.where((point & (F.col("k") >= start)) | (~point & (F.col("e") > start))).withColumn("s", F.greatest("s", F.lit(start)))
    if end is not None:
        out = out.where((point & (F.col("k") < end)) | (~point & (F.col("s") < end))).withColumn("e", F.least("e", F.lit(end)))
    return out


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose key lies in the namespace ``prefix``; a literal prefix goes down to the scan."""
    return rows.where(F.col(column).startswith(prefix))


def meeting_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose namespace has keys in common with ``prefix``: one of both begins with the other."""
    return rows.where(F.col(column).startswith(prefix) | F.lit(prefix).startswith(F.col(column)))


def covered_by(keys: DataFrame, ranges: DataFrame, at: int | Column) -> DataFrame:
    """(k, cleared_at) for numeric keys and ranges of any width: the newest range (v, s, e) at ``at`` over each key.

    Range ends and keys become one sequence. The ranges are cut at every end into pieces that don't
    overlap, each with its newest version, and a key takes the piece that begins last before it. The
    only all-to-all step is over the ranges' own ends.
    """
    live = ranges.where(F.col("v") <= at)
    cuts = live.select(F.col("s").alias("p")).unionByName(live.select(F.col("e").alias("p"))).distinct()
    pieces = cuts.join(live, (F.col("s") <= F.col("p")) & (F.col("p") < F.col("e")), "left").groupBy("p").agg(F.max("v").alias("v"))
    marked = pieces.select(F.col("p").alias("k"), F.struct("v").alias("piece"), F.lit(0).alias("is_key")).unionByName(keys.select("k").distinct().select("k", F.lit(None).cast("struct<v:bigint>").alias("piece"), F.lit(1).alias("is_key")))
    return filled_forward(marked, "k", "is_key", "piece").where("is_key = 1").select("k", F.col("piece.v").alias("cleared_at")).where("cleared_at is not null")


def scan(log: DataFrame, at: int, start: int | None = None, end: int | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """(k, v, val) visible at version ``at`` for keys in [start, end), in key order if limited.

    A key is visible if its newest point is a SET that no newer range clear covers; at one version the
    point wins. Range clears make no rows. ``limit`` counts visible rows.
    """
    if start is not None and end is not None and start >= end:
        raise ValueError("an empty range")
    log = inside(log, start, end)
    newest = latest_points(log, at).where("op = 'SET'")
    out = newest.join(latest_clear_by_key(log, at), "k", "left").where("cleared_at is null or v >= cleared_at").select("k", "v", "val")
    if limit is not None:
        out = out.orderBy(F.col("k").desc() if reverse else F.col("k")).limit(limit)
    return out


def get(log: DataFrame, key: int, at: int) -> DataFrame:
    return scan(log, at, key, key + 1)


def view_scan(base: DataFrame, tail: DataFrame, covered: int, at: int, start: int | None = None, end: int | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """``scan`` over a base, complete through version ``covered``, and the tail of changes after it.

    The base is read at min(at, covered). A key that the tail sets or clears in (covered, at] is the tail's
    alone; what else the tail may hold, at or below ``covered``, does not count.
    """
    below = scan(base, min(at, covered), start, end)
    if at > covered:
        newer = inside(tail.where(F.col("v") > covered), start, end)
        touched = latest_points(newer, at).select("k").unionByName(latest_clear_by_key(newer, at).select("k"))
        below = below.join(touched, "k", "left_anti").unionByName(scan(newer, at))
    if limit is not None:
        below = below.orderBy(F.col("k").desc() if reverse else F.col("k")).limit(limit)
    return below


def view_get(base: DataFrame, tail: DataFrame, covered: int, key: int, at: int) -> DataFrame:
    return view_scan(base, tail, covered, at, key, key + 1)


def get_many(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, at, val) for each wanted (k, at): val is null where nothing is visible.

    One pass for any number of versions: points and clears of a key, and the reads of it, in version order.
    At one version a clear comes first, the point after it, reads last.
    """
    spelt = clears(log).select(F.explode(F.sequence("s", F.col("e") - 1)).alias("k"), "v").select("k", "v", F.lit(0).alias("kind"), F.lit("CLEAR").alias("op"), F.lit(None).cast("long").alias("val"))
    own = points(log).select("k", "v", F.lit(1).alias("kind"), "op", F.col("val").cast("long").alias("val"))
    reads = wanted.select("k", F.col("at").alias("v"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("val"))
    before = Window.partitionBy("k").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    effect = F.when(F.col("kind") < 2, F.struct("op", "val"))
    seen = spelt.unionByName(own).unionByName(reads).withColumn("seen", F.last(effect, True).over(before)).where("kind = 2")
    return seen.select("k", F.col("v").alias("at"), F.when(F.col("seen.op") == "SET", F.col("seen.val")).alias("val"))


def read_your_writes(log: DataFrame, at: int, pending: DataFrame) -> DataFrame:
    """The snapshot at ``at`` under a transaction's own changes (op_index, op, k, s, e, val), in call order."""
    own = pending.select(F.col("op_index").alias("v"), "op", "k", "s", "e", "val")
    point = latest_points(own, F.lit((1 << 62)))
    clear = latest_clear_by_key(own, F.lit((1 << 62)))
    below = scan(log, at).join(point.select("k"), "k", "left_anti").join(clear.select("k"), "k", "left_anti").select("k", "val")
    mine = point.where("op = 'SET'").join(clear, "k", "left").where("cleared_at is null or v > cleared_at").select("k", "val")
    return below.unionByName(mine)


def history_depth(log: DataFrame) -> DataFrame:
    """(k, versions) of stored points."""
    return points(log).groupBy("k").agg(F.count("*").alias("versions"))


def as_of(samples: DataFrame, wanted: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """For each wanted (key, at) the newest sample's value at or before it."""
    both = samples.select(*key, at, F.struct(F.col(value).alias("x")).alias("_s"), F.lit(0).alias("_r")).unionByName(wanted.select(*key, at, F.lit(None).cast(f"struct<x:{samples.schema[value].dataType.simpleString()}>").alias("_s"), F.lit(1).alias("_r")))
    before = Window.partitionBy(*key).orderBy(at, "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_s", F.last("_s", True).over(before)).where("_r = 1").select(*key, at, F.col("_s.x").alias(value))


def problems(log: DataFrame) -> DataFrame:
    """(v, k) with more than one distinct point change at one version: ambiguous, hence refused."""
    return points(log).distinct().groupBy("v", "k").count().where("count > 1").select("v", "k")


def canonical(log: DataFrame) -> DataFrame:
    """The log without repeated mutations."""
    return log.dropDuplicates(["v", "op", "k", "s", "e", "val"])


def admit(batches: DataFrame) -> DataFrame:
    """(v, outcome) of commit batches (seq, v, identity, fingerprint) offered in order of seq.

    Zero: invalid; again with the same identity and content: AlreadyApplied; other content: ConflictingReplay;
    not above all before: NonMonotonic.
    """
    same = Window.partitionBy("v").orderBy("seq")
    first = F.first(F.struct("identity", "fingerprint")).over(same)
    batches = running(batches, "seq", "above", F.max, F.col("v"), before=True)
    above = F.col("above")
    outcome = F.when(F.col("v") == 0, "Invalid").when(F.row_number().over(same) > 1, F.when(first == F.struct("identity", "fingerprint"), "AlreadyApplied").otherwise("ConflictingReplay")).when(above > F.col("v"), "NonMonotonic").otherwise("Applied")
    return batches.select("seq", "v", outcome.alias("outcome"))
