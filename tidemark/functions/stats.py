"""Summary statistics of measurements, grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median (midpoint for even counts) and median absolute deviation per group."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(middle, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    by = Window.partitionBy(*keys)
    return df.where(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(by.orderBy(value)) - 1).withColumn("_n", F.count("*").over(by))


def nearest_rank_ceil(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50 at place floor((n-1)/2), p99 at place ceil((n-1)*99/100)."""
    last = F.col("_n") - 1
    return _ranked(df, keys, value).groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == at, F.col(value))).alias(name) for name, at in (("p50", F.floor(last / 2)), ("p99", F.ceil(last * 99 / 100)))])


def nearest_rank_floor(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 99)) -> DataFrame:
    """Each percentile p at place floor((n-1)*p/100)."""
    return _ranked(df, keys, value).groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * p / 100), F.col(value))).alias(f"p{p}") for p in percents])


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def hotspot_ratio(loads: DataFrame, load: str) -> DataFrame:
    """Largest load over mean load; 0 without any."""
    return loads.agg(F.coalesce(F.max(load) / F.avg(load), F.lit(0.0)).alias("hotspot_ratio"))


def pressure(ranges: DataFrame, ram_limit: int, debt_limit: int) -> DataFrame:
    """Admission from fixed memory and compaction debt summed over ranges (fixed_ram, debt, cache).

    Caches are clamped to the memory that is left; actions come in the order in which they are taken.
    """
    sums = ranges.agg(F.sum("fixed_ram").alias("fixed_ram"), F.sum("debt").alias("debt"), F.sum("cache").alias("wanted_cache"))
    left = F.greatest(F.lit(ram_limit) - F.col("fixed_ram"), F.lit(0))
    out = sums.withColumn("cache", F.least("wanted_cache", left))
    over_ram, over_debt, clamped = F.col("fixed_ram") > ram_limit, F.col("debt") > debt_limit, F.col("cache") < F.col("wanted_cache")
    actions = F.array_join(F.array_compact(F.array(F.when(clamped, "shrink_cache"), F.when(over_debt, "compact"), F.when(over_ram, "evict_range"))), ",")
    decision = F.when(over_ram, "Refuse").when(over_debt, "RateLimit").otherwise("Admit")
    return out.select("fixed_ram", "debt", "cache", actions.alias("actions"), decision.alias("decision"))
