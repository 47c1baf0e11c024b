"""Equality of sets and multisets, by grouped aggregates: nothing is gathered into arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_sets(left: DataFrame, right: DataFrame, by: str, member: str) -> DataFrame:
    """(by, same, inside) per group of either side: equal sets of members, and left's a subset of right's.

    Repeated members count once; null is a member like any other.
    """
    sides = left.select(by, member, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(by, member, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    each = sides.groupBy(by, member).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return each.groupBy(by).agg(F.bool_and(F.col("_l") == F.col("_r")).alias("same"), F.bool_and(F.col("_l") <= F.col("_r")).alias("inside"))


def same_multisets(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (same, left_only, right_only): whether both hold each row equally often, and the rows in excess on either side."""
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    excess = signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n"))
    over = lambda sign: F.coalesce(F.sum(F.greatest(F.col("_n") * sign, F.lit(0))), F.lit(0))
    return excess.agg(over(1).alias("left_only"), over(-1).alias("right_only")).select((F.col("left_only") + F.col("right_only") == 0).alias("same"), "left_only", "right_only")
