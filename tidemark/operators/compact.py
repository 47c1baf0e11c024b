"""History compaction, base rebuilds, delta segments and garbage collection."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import least_alive, running, with_previous
from ..functions.stats import ratio


def _classed(points: DataFrame, floor: int) -> DataFrame:
    below = F.col("v") <= floor
    newest = Window.partitionBy("k", below).orderBy(F.desc("v"))
    return points.withColumn("fate", F.when(~below, "kept_newer").when(F.row_number().over(newest) == 1, "floor_anchor").otherwise("dropped"))


def retained(points: DataFrame, floor: int) -> DataFrame:
    """Entries (k, v, ...) that reads at ``floor`` or later can need.

    All above the floor, and per key the newest at or below it, even a tombstone: without it an older value
    would come back.
    """
    return _classed(points, floor).where("fate <> 'dropped'").drop("fate")


def retention_counts(points: DataFrame, floor: int) -> DataFrame:
    """One row: inspected, kept_newer, floor_anchors, dropped."""
    fate = lambda name: F.count_if(F.col("fate") == name)
    return _classed(points, floor).agg(F.count("*").alias("inspected"), fate("kept_newer").alias("kept_newer"), fate("floor_anchor").alias("floor_anchors"), fate("dropped").alias("dropped"))


def retention_stats(entries: DataFrame, floor: int, metadata: Column) -> DataFrame:
    """One row of six counters over stored entries (k, v, op): those of ``retention_counts``, metadata and malformed.

    Entries under ``metadata`` are kept as they are and not inspected. Malformed ones have no key, no version or
    an unknown op; a compaction that finds one must not go on.
    """
    broken = F.col("k").isNull() | F.col("v").isNull() | ~F.coalesce(F.col("op").isin("SET", "CLEAR"), F.lit(False))
    kind = F.when(F.coalesce(metadata, F.lit(False)), "metadata").when(broken, "malformed").otherwise("user")
    marked = entries.withColumn("kind", kind)
    aside = marked.agg(F.count_if(F.col("kind") == "metadata").alias("metadata"), F.count_if(F.col("kind") == "malformed").alias("malformed"))
    return retention_counts(marked.where("kind = 'user'"), floor).crossJoin(aside)  # one row each


def amplification(stored: DataFrame, live: DataFrame) -> DataFrame:
    """One row: stored and live entries, and their ratio (0 without live ones)."""
    return stored.agg(F.count("*").alias("stored")).crossJoin(live.agg(F.count("*").alias("live"))).withColumn("amplification", ratio(F.col("stored"), F.col("live")))


def objectify(snapshot: DataFrame, watermark: int) -> DataFrame:
    """A snapshot as a new base complete through ``watermark``; nothing of the snapshot is lost."""
    return snapshot.select("id", "status", "part", "amount_cents", "priority", F.lit(2).alias("writer_schema"), F.lit(watermark).alias("base_watermark"))


def lineage_problems(segments: DataFrame) -> DataFrame:
    """Segments (after, through, prior_chain, chain) that don't continue the one before, or are empty."""
    reason = (
        F.when(F.col("after") >= F.col("through"), "empty")
        .when(F.col("previous.through") != F.col("after"), "not contiguous")
        .when(F.col("previous.chain") != F.col("prior_chain"), "other chain")
    )
    return with_previous(segments, "through", ["through", "chain"]).select("after", "through", reason.alias("reason")).where("reason is not null")


def segment(tail: DataFrame, after: int, through: int) -> DataFrame:
    """The changes of one delta segment; must end exactly at ``through``, which the caller checks with ``segment_ends``."""
    return tail.where((F.col("commit_version") > after) & (F.col("commit_version") <= through))


def segment_ends(rows: DataFrame, through: int) -> bool:
    return rows.agg(F.max("commit_version")).first()[0] == through


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth) of objects reachable from roots (id) over edges (parent, child), with their least depth.

    Only the newest ring of objects is joined in a round, and each ring is cut from its lineage, so a long
    or cyclic graph keeps small plans.
    """
    seen = ring = roots.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for depth in itertools.count(1):
        ring = ring.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if ring.isEmpty():
            return seen
        seen = seen.unionByName(ring)


def incomplete(marked: DataFrame, objects: DataFrame) -> DataFrame:
    """Marked ids without an object: while there is one, nothing may be deleted."""
    return marked.join(objects, "id", "left_anti").select("id")


def candidates(objects: DataFrame, marked: DataFrame) -> DataFrame:
    """Objects that nothing keeps alive."""
    return objects.join(marked.select("id"), "id", "left_anti")


def bytes_of(objects: DataFrame, marked: DataFrame) -> DataFrame:
    """One row: reachable_bytes and physical_bytes."""
    live = objects.join(marked.select("id").withColumn("m", F.lit(1)), "id", "left")
    return live.agg(F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("bytes"))), F.lit(0)).alias("reachable_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("physical_bytes"))


def read_floor(frontiers: DataFrame, leases: DataFrame, retained_window: int) -> DataFrame:
    """(step, floor): the oldest readable version after each step (step, frontier); never goes back.

    Policy is frontier - window; a lease (step, snapshot, until) that lives holds the floor at its snapshot.
    Steps and versions are integers; of rows that repeat a step the highest frontier counts.
    """
    steps = frontiers.groupBy("step").agg(F.max("frontier").alias("frontier"))
    alive = least_alive(steps.select(F.col("step").alias("at")), leases.select(F.col("step").alias("since"), "until", F.col("snapshot").alias("value")))
    held = steps.join(alive.select(F.col("at").alias("step"), F.col("least").alias("held")), "step")
    policy = running(held, "step", "policy", F.max, F.greatest(F.col("frontier") - retained_window, F.lit(0)))
    return running(policy, "step", "floor", F.max, F.least("policy", F.coalesce("held", "policy"))).select("step", "floor")
