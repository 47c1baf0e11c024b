"""Fixed-size pages of relations, versioned by log position, and relation extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PAGES = 128


def latest(pages: DataFrame, at: int, most_lsn: int | None = None) -> DataFrame:
    """(rel, block, page_lsn, v) of each page at version ``at``; a page beyond ``most_lsn`` is refused by raising."""
    out = pages.where(F.col("v") <= at).groupBy("rel", "block").agg(F.max("v").alias("v"), F.max_by("page_lsn", "v").alias("page_lsn"))
    if most_lsn is None:
        return out
    ahead = F.raise_error(F.lit("a page is ahead of the log")).cast("long")
    return out.withColumn("page_lsn", F.when(F.col("page_lsn") <= most_lsn, F.col("page_lsn")).otherwise(ahead))


def vector_problems(found: DataFrame, first: int, count: int) -> DataFrame:
    """Blocks of [first, first + count) that are missing from ``found`` (block), and those found beyond."""
    spark = found.sparkSession
    wanted = spark.range(first, first + count).select(F.col("id").alias("block"))
    return wanted.join(found, "block", "left_anti").select("block", F.lit("missing").alias("problem")).unionByName(found.join(wanted, "block", "left_anti").select("block", F.lit("extra").alias("problem")))


def extent(extents: DataFrame, at: int) -> DataFrame:
    """(rel, nblocks) at version ``at``."""
    return extents.where(F.col("v") <= at).groupBy("rel").agg(F.max_by("nblocks", "v").alias("nblocks"))


def write_admission(writes: DataFrame, flushed_lsn: int, most_pages: int = MOST_PAGES) -> DataFrame:
    """(batch, status) of page writes (batch, v, block, page_lsn)."""
    sums = writes.groupBy("batch").agg(F.min("v").alias("v"), F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.max("page_lsn").alias("lsn"))
    status = F.when(F.col("v") == 0, "ZeroVersion").when(F.col("n") > most_pages, "TooManyPages").when(F.col("blocks") < F.col("n"), "RepeatedBlock").when(F.col("lsn") > flushed_lsn, "AheadOfLog").otherwise("Ok")
    return sums.select("batch", status.alias("status"))


def commit_plan(writes: DataFrame, extents: DataFrame) -> DataFrame:
    """(batch, plan): WriteExisting inside the extent, Extend right at its end without holes, else Refused."""
    sums = writes.groupBy("batch", "rel").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count_distinct("block").alias("n"))
    known = sums.join(extents, "rel", "left").withColumn("nblocks", F.coalesce("nblocks", F.lit(0)))
    plan = F.when(F.col("high") < F.col("nblocks"), "WriteExisting").when((F.col("low") == F.col("nblocks")) & (F.col("high") - F.col("low") + 1 == F.col("n")), "Extend").otherwise("Refused")
    return known.select("batch", "rel", plan.alias("plan"))


def page_problems(pages: DataFrame) -> DataFrame:
    """Pages (rel, block, image, sha256) whose image is not 8 KiB or differs from its digest."""
    problem = F.when(F.octet_length("image") != 8192, "size").when(F.sha2("image", 256) != F.col("sha256"), "content")
    return pages.select("rel", "block", problem.alias("problem")).where("problem is not null")


def newest_block(pages: DataFrame) -> DataFrame:
    """(rel, block, v) with each relation's pages in block order and the running highest version."""
    return pages.withColumn("v_so_far", F.max("v").over(Window.partitionBy("rel").orderBy("block")))
