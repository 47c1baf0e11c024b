"""Reads over ranges: routes [start, end) with gaps, and scans that cross them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import filled_forward


def lookup(keys: DataFrame, routes: DataFrame) -> DataFrame:
    """(k, range_id): the route of each key, null in a gap. Routes don't overlap, so the last start before a key decides."""
    starts = routes.select(F.col("start").alias("k"), F.struct("end", "range_id").alias("route"), F.lit(0).alias("is_key"))
    none = F.lit(None).cast(starts.schema["route"].dataType)
    both = starts.unionByName(keys.select("k", none.alias("route"), F.lit(1).alias("is_key")))
    return filled_forward(both, "k", "is_key", "route").where("is_key = 1").select("k", F.when(F.col("k") < F.col("route.end"), F.col("route.range_id")).alias("range_id"))


def split(scans: DataFrame, routes: DataFrame) -> DataFrame:
    """(scan, range_id, s, e): the parts of scans (scan, s, e) by route, ready to be read in order."""
    met = scans.join(routes, (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    return met.select("scan", "range_id", F.greatest("s", "start").alias("s"), F.least("e", "end").alias("e"))


def uncovered(scans: DataFrame, routes: DataFrame) -> DataFrame:
    """Scans that meet a gap, for which a read must fail rather than skip keys."""
    parts = split(scans, routes).groupBy("scan").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    return scans.join(parts, "scan", "left").where(F.coalesce("covered", F.lit(0)) < F.col("e") - F.col("s")).select("scan")


def fence(requests: DataFrame, cell: str, tenant: str, epoch: int, start: int, end: int, most_rows: int) -> DataFrame:
    """(request, status) of reads as the owner of [start, end) at ``epoch`` answers them."""
    status = (
        F.when(F.col("cell") != cell, "WrongCell")
        .when(F.col("tenant") != tenant, "WrongTenant")
        .when(F.col("epoch") != epoch, "StaleEpoch")
        .when((F.col("s") < start) | (F.col("s") >= end), "KeyOutsideRange")
        .when(F.col("e") > end, "CrossesSplit")
        .when(F.col("row_limit") > most_rows, "TooManyRows")
        .otherwise("Ok")
    )
    return requests.select("request", status.alias("status"))
