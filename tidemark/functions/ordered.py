"""Window functions over one global order, without gathering all rows in one task.

The order column is a number. Rows are dealt by stretches of it; inside a stretch an ordinary window
works, and what passes from stretch to stretch is one row for each, of which there are few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20
#: Stretches of ``least_alive``, whose rows are passed one by one.
SWEEP_WIDTH = 1 << 17


def _stretched(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(order) / width))


def with_previous(df: DataFrame, order: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """``df`` with struct ``previous`` of ``columns`` in the row before in order; null in the first."""
    rows = _stretched(df, order, width)
    wanted = F.struct(*columns)
    inside = F.lag(wanted).over(Window.partitionBy("_stretch").orderBy(order))
    ends = rows.groupBy("_stretch").agg(F.max_by(wanted, order).alias("_end"))
    carried = ends.select("_stretch", F.lag("_end").over(Window.orderBy("_stretch")).alias("_carried"))
    return rows.withColumn("_inside", inside).join(carried, "_stretch").withColumn("previous", F.coalesce("_inside", "_carried")).drop("_stretch", "_inside", "_carried")


def unsorted(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows (order, columns) that are less than the row before in ``order``: input that is not sorted by ``columns``."""
    return with_previous(df, order, columns).where(F.col("previous") > F.struct(*columns)).select(order, *columns)


def filled_forward(df: DataFrame, order: str, then: str, column: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``column`` replaced by its last value that is not null, up to each row, by (order, then)."""
    rows = _stretched(df, order, width)
    so_far = Window.partitionBy("_stretch").orderBy(order, then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(F.col(column).isNotNull(), F.struct(order, then))
    ends = rows.groupBy("_stretch").agg(F.max_by(column, place).alias("_end"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_stretch", F.last("_end", True).over(before).alias("_carried"))
    return rows.withColumn(column, F.last(column, True).over(so_far)).join(carried, "_stretch").withColumn(column, F.coalesce(column, "_carried")).drop("_stretch", "_carried")


def running(df: DataFrame, order: str, name: str, summary, value: Column, before: bool = False, width: int = WIDTH) -> DataFrame:
    """``df`` with ``name``: max, min or the like of ``value`` over all rows up to each, or before it.

    ``summary`` is a function such as ``F.max`` that may be applied to its own results; orders must not repeat.
    """
    rows = _stretched(df, order, width).withColumn("_value", value)
    end = -1 if before else Window.currentRow
    inside = summary("_value").over(Window.partitionBy("_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, end))
    totals = rows.groupBy("_stretch").agg(summary("_value").alias("_total"))
    carried = totals.select("_stretch", summary("_total").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    out = rows.withColumn("_inside", inside).join(carried, "_stretch")
    both = F.array_compact(F.array("_inside", "_carried"))
    best = F.array_max(both) if summary is F.max else F.array_min(both)
    return out.withColumn(name, best).drop("_stretch", "_value", "_inside", "_carried")


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows (grp, at, is_point, until, value) sorted by the first three: (grp, at, least) of the points."""
    last, alive = None, []
    for rows in batches:
        out = []
        for grp, at, is_point, until, value in zip(*(rows[c].tolist() for c in ("grp", "at", "is_point", "until", "value")), strict=True):
            if grp != last:
                last, alive = grp, []
            if not is_point:
                heapq.heappush(alive, (value, until))
                continue
            while alive and alive[0][1] <= at:
                heapq.heappop(alive)
            out.append((grp, at, alive[0][0] if alive else None))
        yield pd.DataFrame(out, columns=["grp", "at", "least"]).astype({"least": object})


def _sweep(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(grp, at, least) of points (grp, at) under the spans (grp, since, until, value) of their group."""
    marked = points.select("grp", "at", F.lit(1).alias("is_point"), F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("value"))
    rows = spans.select("grp", F.col("since").alias("at"), F.lit(0).alias("is_point"), "until", "value").unionByName(marked)
    return rows.repartition("grp").sortWithinPartitions("grp", "at", "is_point").mapInPandas(_swept, "grp long, at long, least long")


def least_alive(points: DataFrame, spans: DataFrame, width: int = SWEEP_WIDTH) -> DataFrame:
    """(at, least) for each row of integer ``points`` (at): the least value of the spans (since, until, value) with since <= at < until.

    A span goes to the stretches it begins and ends in, where a sweep keeps the living ones in a heap. Stretches in
    between are wholly inside it: of equal pairs of ends one span, the least, goes on to a sweep over stretches. So no
    row is met by all others, however long spans live.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    live = spans.where("since < until and value is not null").select(*[F.col(c).cast("long").alias(c) for c in ("since", "until", "value")], stretch("since").alias("first"), stretch("until").alias("last"))
    placed = points.where("at is not null").select(F.col("at").cast("long").alias("at"), stretch("at").alias("grp"))
    inside = _sweep(placed, live.withColumn("grp", F.explode(F.array_distinct(F.array("first", "last")))))
    over = live.where("last - first > 1").groupBy("first", "last").agg(F.min("value").alias("value")).select(F.lit(0).cast("long").alias("grp"), (F.col("first") + 1).alias("since"), F.col("last").alias("until"), "value")
    whole = _sweep(placed.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at")).distinct(), over).select(F.col("at").alias("grp"), F.col("least").alias("over"))
    return inside.join(whole, "grp").select("at", F.least("least", "over").alias("least"))
