"""Exact snapshots: a columnar base, complete through its watermarks, and the changes after them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from ..sources.schemas import SNAPSHOT, normalize, writer_of


def window(tail: DataFrame, after: int, through: int) -> DataFrame:
    """Changes with after < commit_version <= through."""
    return tail.where((F.col("commit_version") > after) & (F.col("commit_version") <= through))


def latest_effects(tail: DataFrame, key: str = "id", at: str = "commit_version") -> DataFrame:
    """The newest change per key; keys must not repeat at a version."""
    rest = [c for c in tail.columns if c not in (key, at)]
    return tail.groupBy(key).agg(F.max(at).alias(at), F.max_by(F.struct(*rest), at).alias("_e")).select(key, at, *[f"_e.{c}" for c in rest])


def overlay(base: DataFrame, tail: DataFrame, target: int, lower: int) -> DataFrame:
    """Snapshot rows at ``target``.

    Any change of an id in (lower, target] hides every base row of that id, in whatever partition; the
    newest change gives the row unless it is a DELETE. Filters on snapshot columns go down to the
    base scan, and stop above the newest change, so they cannot bring back a hidden row. Only the
    id and version are read of the tail on the hiding side.
    """
    changes = window(tail, lower, target)
    kept = normalize(base.join(changes.select("id"), "id", "left_anti"), writer_of(base))
    return kept.unionByName(normalize(latest_effects(changes).where("operation <> 'DELETE'"), 2))


def overlay_single_pass(base: DataFrame, tail: DataFrame, target: int, lower: int) -> DataFrame:
    """``overlay`` for a base with one row per id, by one aggregate over base and tail together.

    Reads the tail once, but filters don't reach the base; for tails about as large as the base.
    """
    old = normalize(base, writer_of(base)).withColumns({"operation": F.lit("BASE"), "commit_version": F.lit(lower)})
    new = window(tail, lower, target).select(*SNAPSHOT, "operation", "commit_version")
    return latest_effects(old.unionByName(new)).where("operation <> 'DELETE'").select(*SNAPSHOT)


def overlay_by_partition(base: DataFrame, tail: DataFrame, target: int, watermarks: dict[str, int]) -> DataFrame:
    """``overlay`` where each change counts only in partitions whose own watermark is older.

    A change takes its id out of the partition it was in and puts it in the one it goes to. Serves
    a tail already trimmed up to each partition's watermark.
    """
    marks = F.create_map(*[F.lit(x) for pair in watermarks.items() for x in pair])
    sides = F.array_distinct(F.array_compact(F.array("previous_part", "part")))
    touched = tail.where(F.col("commit_version") <= target).withColumn("side", F.explode(sides)).where(F.col("commit_version") > marks[F.col("side")])
    newest = latest_effects(touched.withColumn("key", F.struct("id", "side")).drop("id"), "key").select("key.*", "operation", "status", "part", "amount_cents", "priority")
    kept = base.join(newest.select("id", F.col("side").alias("part")), ["id", "part"], "left_anti")
    return normalize(kept, writer_of(base)).unionByName(newest.where("operation <> 'DELETE' and side = part").select(*SNAPSHOT))


def snapshot(spark: SparkSession, manifest: Manifest, target: int) -> DataFrame:
    """The manifest's table at ``target``; ``SnapshotUnavailable`` if it cannot be exact.

    Where no segment reaches into the window the base is returned as it is.
    """
    lower = manifest.check(target)
    if not manifest.needed(target):
        return normalize(manifest.base(spark), 1)
    return overlay(manifest.base(spark), manifest.tail(spark, target), target, lower)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two snapshots with one row per id: ADDED, REMOVED or CHANGED."""
    old, new = (df.select("id", F.struct(*[c for c in SNAPSHOT if c != "id"]).alias(name)) for df, name in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED")
    return old.join(new, "id", "full").select("id", change.alias("change")).where("change is not null")


@dataclass(frozen=True)
class Continuation:
    """Where a paged scan goes on, and the snapshot it is bound to."""

    table: str
    target_version: int
    schema_version: int
    partition_epoch: int
    last_id: int
    last_part: str


def page(rows: DataFrame, size: int, token: Continuation | None = None, **identity) -> DataFrame:
    """The next ``size`` rows in (id, part) order after ``token``, which must be of the same snapshot."""
    if token is not None:
        if any(getattr(token, k) != v for k, v in identity.items()):
            raise ValueError("the token belongs to another snapshot")
        rows = rows.where((F.col("id") > token.last_id) | ((F.col("id") == token.last_id) & (F.col("part") > token.last_part)))
    return rows.orderBy("id", "part").limit(size)


def large_groups(rows: DataFrame, most: int = 16) -> DataFrame:
    """Ids with more than ``most`` changes: the guard for a consumer that holds a group in memory."""
    return rows.groupBy("id").count().where(F.col("count") > most)


def tokens_hold(certificates: DataFrame, current: DataFrame) -> DataFrame:
    """(certificate, verdict): Approve if every dependency (certificate, resource, token, used) is unchanged and in its limit."""
    sound = F.coalesce((F.col("token") == F.col("current_token")) & (F.col("used") <= F.col("most")), F.lit(False))
    return certificates.join(current, "resource", "left").groupBy("certificate").agg(F.when(F.bool_and(sound), "Approve").otherwise("Retry").alias("verdict"))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Each row as text: name=value fields in column order."""
    return rows.select(F.concat_ws(chr(124), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in rows.columns]).alias("row"))
