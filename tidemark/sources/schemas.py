"""Writer schemas, and what each is normalised to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_V1 = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("status", T.StringType(), False), T.StructField("part", T.StringType(), False), T.StructField("total_cents", T.LongType(), False), T.StructField("writer_schema", T.LongType(), False), T.StructField("base_watermark", T.LongType(), False)])
TAIL_V2 = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("commit_version", T.LongType(), False), T.StructField("operation", T.StringType(), False), T.StructField("previous_part", T.StringType()), T.StructField("status", T.StringType()), T.StructField("part", T.StringType()), T.StructField("amount_cents", T.LongType()), T.StructField("priority", T.IntegerType()), T.StructField("writer_schema", T.LongType(), False)])
SNAPSHOT = ["id", "status", "part", "amount_cents", "priority"]
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def writer_of(base: DataFrame) -> int:
    """A first base is of version 1; one rebuilt from a snapshot has what snapshots have."""
    return 1 if "total_cents" in base.columns else 2


def normalize(df: DataFrame, writer_schema: int) -> DataFrame:
    """Rows of a writer's schema as snapshot rows: version 1 has no priority and calls the amount total_cents."""
    if writer_schema == 1:
        return df.select("id", "status", "part", F.col("total_cents").alias("amount_cents"), F.lit(0).alias("priority"))
    if writer_schema == 2:
        return df.select(*SNAPSHOT)
    raise ValueError(f"unknown writer schema {writer_schema}")


def signed(df: DataFrame) -> DataFrame:
    """Unsigned 64-bit columns, which Parquet readers give as decimals, as long; too large values fail."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType) and (f.dataType.precision, f.dataType.scale) == (20, 0)]
    guard = lambda c: F.when(F.col(c) <= (1 << 63) - 1, F.col(c).cast("long")).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} is over 2^63 - 1")).cast("long"))
    return df.withColumns({c: guard(c) for c in wide})


def tail_problems(tail: DataFrame) -> DataFrame:
    """Rows of a tail that cannot be replayed, with the reason; empty for a valid one."""
    image = F.col("status").isNull() | F.col("part").isNull() | F.col("amount_cents").isNull() | F.col("priority").isNull()
    reason = (
        F.when(F.col("id").isNull(), "null id")
        .when(F.col("writer_schema") != 2, "unknown writer schema")
        .when(~F.col("operation").isin(*OPERATIONS), "unknown operation")
        .when((F.col("operation") != "DELETE") & image, "incomplete after-image")
    )
    single = tail.select("id", "commit_version", reason.alias("reason")).where("reason is not null")
    twice = tail.groupBy("id", "commit_version").count().where("count > 1").select("id", "commit_version", F.lit("two effects at one version").alias("reason"))
    return single.unionByName(twice)


def base_problems(base: DataFrame, watermarks: dict[str, int]) -> DataFrame:
    """Rows of a base that contradict the manifest, with the reason."""
    known = F.create_map(*[F.lit(x) for pair in watermarks.items() for x in pair])
    reason = F.when(F.col("id").isNull(), "null id").when(F.col("writer_schema") != 1, "unknown writer schema").when(~F.col("part").isin(*watermarks), "unknown partition").when(known[F.col("part")] != F.col("base_watermark"), "other watermark")
    single = base.select("id", "part", reason.alias("reason")).where("reason is not null")
    return single.unionByName(base.groupBy("id", "part").count().where("count > 1").select("id", "part", F.lit("two rows of one id in a partition").alias("reason")))
