"""Inputs of the engine derived from the star-schema tables, with the same derivations as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET, AVAILABLE = 12, 16
WATERMARKS = {"west": 5, "east": 8}
LOWER = min(WATERMARKS.values())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _side(number: Column) -> Column:
    return F.when(number % 2 == 0, "west").otherwise("east")


def base(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.where("o_orderkey % 10 <> 3").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"),
        _side(F.col("o_custkey")).alias("part"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"),
        F.lit(1).alias("writer_schema"),
        F.when(F.col("o_custkey") % 2 == 0, WATERMARKS["west"]).otherwise(WATERMARKS["east"]).alias("base_watermark"),
    )


def tail(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").where("o_orderkey % 10 = 3 or o_orderkey % 4 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    key, first = F.col("o_orderkey"), (F.col("o_orderkey") % 10 == 3) & (F.col("k") == 0)
    o = o.withColumn("operation", F.when(first, "INSERT").when((key + F.col("k")) % 5 == 0, "DELETE").otherwise("UPDATE"))
    image = lambda value: F.when(F.col("operation") != "DELETE", value)
    return o.select(
        key.alias("id"),
        (6 + (key * 7 + F.col("k") * 3) % 9).alias("commit_version"),
        "operation",
        F.when(~first, _side(F.col("o_custkey"))).alias("previous_part"),
        image(F.when((key + F.col("k")) % 3 == 0, "CLOSED").otherwise("OPEN")).alias("status"),
        image(_side(F.col("o_custkey") + F.when(key % 7 == 0, 1).otherwise(0))).alias("part"),
        image(F.round(F.col("o_totalprice") * 100).cast("long") + F.col("k")).alias("amount_cents"),
        image((key % 8).cast("int")).alias("priority"),
        F.lit(2).alias("writer_schema"),
    )


ACCOUNTS_LOWER = 7


def accounts_base(spark: SparkSession, folder: str) -> DataFrame:
    """A second table with a watermark of its own."""
    c = table(spark, folder, "customer").where("c_custkey % 6 <> 1")
    return c.select(F.col("c_custkey").alias("id"), F.lit("OPEN").alias("status"), _side(F.col("c_nationkey")).alias("part"), F.round(F.col("c_acctbal") * 100).cast("long").alias("amount_cents"), F.lit(0).alias("priority"), F.lit(2).alias("writer_schema"), F.lit(ACCOUNTS_LOWER).alias("base_watermark"))


def accounts_tail(spark: SparkSession, folder: str) -> DataFrame:
    """One change of each account that is new or a fifth of the others."""
    c, key = table(spark, folder, "customer").where("c_custkey % 6 = 1 or c_custkey % 5 = 0"), F.col("c_custkey")
    operation = F.when(key % 6 == 1, "INSERT").when(key % 10 == 0, "DELETE").otherwise("UPDATE")
    return c.select(key.alias("id"), (8 + key % 7).alias("commit_version"), operation.alias("operation"), F.lit("CLOSED").alias("status"), _side(F.col("c_nationkey")).alias("part"), (F.round(F.col("c_acctbal") * 100).cast("long") + 1).alias("amount_cents"), F.lit(1).alias("priority"), F.lit(2).alias("writer_schema"))


def accounts_sql(name: str, target: int) -> str:
    """A common table expression ``name``: the accounts at ``target``."""
    return f"""{name} AS (
  SELECT c_custkey AS id, CASE WHEN changed THEN 'CLOSED' ELSE 'OPEN' END AS status, CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN changed THEN 1 ELSE 0 END AS amount_cents
  FROM (SELECT *, (c_custkey % 6 = 1 OR c_custkey % 5 = 0) AND 8 + c_custkey % 7 <= {target} AS changed FROM customer) c
  WHERE CASE WHEN changed THEN c_custkey % 6 = 1 OR c_custkey % 10 <> 0 ELSE c_custkey % 6 <> 1 END)"""


SNAPSHOT_SQL = """
base AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status,
         CASE WHEN o_custkey % 2 = 0 THEN 'west' ELSE 'east' END AS part,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents
  FROM orders WHERE o_orderkey % 10 <> 3),
tail AS (
  SELECT id, commit_version, operation, previous_part,
         CASE WHEN operation <> 'DELETE' THEN status END AS status, CASE WHEN operation <> 'DELETE' THEN part END AS part,
         CASE WHEN operation <> 'DELETE' THEN amount_cents END AS amount_cents, CASE WHEN operation <> 'DELETE' THEN priority END AS priority
  FROM (SELECT o_orderkey AS id, 6 + (o_orderkey * 7 + k * 3) % 9 AS commit_version,
          CASE WHEN o_orderkey % 10 = 3 AND k = 0 THEN 'INSERT' WHEN (o_orderkey + k) % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation,
          CASE WHEN o_orderkey % 10 = 3 AND k = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'west' ELSE 'east' END AS previous_part,
          CASE WHEN (o_orderkey + k) % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
          CASE WHEN (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'west' ELSE 'east' END AS part,
          CAST(round(o_totalprice * 100) AS BIGINT) + k AS amount_cents, CAST(o_orderkey % 8 AS INT) AS priority
        FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) z WHERE o_orderkey % 10 = 3 OR o_orderkey % 4 = 0) q)"""


def snapshot_sql(name: str, target: int, lower: int = LOWER) -> str:
    """A common table expression ``name``: the snapshot at ``target``."""
    inside = f"commit_version > {lower} AND commit_version <= {target}"
    return f"""{name} AS (
  SELECT id, status, part, total_cents AS amount_cents, 0 AS priority FROM base WHERE id NOT IN (SELECT id FROM tail WHERE {inside})
  UNION ALL
  SELECT id, status, part, amount_cents, priority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_version DESC) AS rn FROM tail WHERE {inside}) x
  WHERE rn = 1 AND operation <> 'DELETE')"""


def log(spark: SparkSession, folder: str) -> DataFrame:
    """A multi-version log: one mutation per event."""
    kind = F.when(F.col("event_type") == "error", "CLEAR").when(F.col("event_type") == "signup", "CLEAR_RANGE").otherwise("SET")
    return table(spark, folder, "events").select((F.col("event_id") + 1).alias("v"), kind.alias("op"), F.col("user_id").alias("k"), F.col("user_id").alias("s"), (F.col("user_id") + 5).alias("e"), F.round(F.col("value") * 100).cast("long").alias("val"))


LOG_SQL = """
log AS (
  SELECT CAST(event_id + 1 AS BIGINT) AS v, CASE WHEN event_type = 'error' THEN 'CLEAR' WHEN event_type = 'signup' THEN 'CLEAR_RANGE' ELSE 'SET' END AS op,
         user_id AS k, user_id AS s, user_id + 5 AS e, CAST(round(value * 100) AS BIGINT) AS val FROM events)"""


def visible_sql(name: str, at: str, source: str = "log") -> str:
    return f"""{name} AS (
  SELECT p.k, p.v, p.val
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM {source} WHERE op <> 'CLEAR_RANGE' AND v <= {at}) x WHERE rn = 1 AND op = 'SET') p
  WHERE p.v >= coalesce((SELECT max(c.v) FROM {source} c WHERE c.op = 'CLEAR_RANGE' AND c.v <= {at} AND c.s <= p.k AND p.k < c.e), 0))"""


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One access (txn, k, read_version, commit_version) per event; four events make a transaction."""
    e = table(spark, folder, "events").select(F.floor(F.col("event_id") / 4).alias("txn"), F.col("user_id").alias("k"), "event_id")
    return e.withColumn("commit_version", F.col("txn") + 1).withColumn("read_version", F.greatest(F.col("commit_version") - 1 - (F.col("txn") * 4) % 7, F.lit(0))).select("txn", "k", "event_id", "read_version", "commit_version")


TRANSACTIONS_SQL = """
acc AS (
  SELECT event_id // 4 AS txn, user_id AS k, event_id, greatest(event_id // 4 - ((event_id // 4) * 4) % 7, 0) AS read_version, event_id // 4 + 1 AS commit_version FROM events)"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Replica frames (replica, idx, digest) with losses, torn ends and a few wrong payloads."""
    e = table(spark, folder, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replica"))
    n = e.agg(F.max("event_id").alias("last"))
    e = e.crossJoin(F.broadcast(n)).where("(event_id * 7 + replica * 3) % 11 <> 0 and event_id <= last - replica * 20 and not (event_id > last * 0.9 and replica > 0)")
    payload = F.concat(F.col("event_id").cast("string"), F.when((F.col("event_id") + F.col("replica")) % 97 == 0, "x").otherwise(""))
    return e.select("replica", F.col("event_id").alias("idx"), F.sha2(payload, 256).alias("digest"))


FRAMES_SQL = """
frames AS (
  SELECT r AS replica, event_id AS idx, sha256(CAST(event_id AS VARCHAR) || CASE WHEN (event_id + r) % 97 = 0 THEN 'x' ELSE '' END) AS digest
  FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS r) z CROSS JOIN (SELECT max(event_id) AS last FROM events) m
  WHERE (event_id * 7 + r * 3) % 11 <> 0 AND event_id <= last - r * 20 AND NOT (event_id > last * 0.9 AND r > 0))"""
