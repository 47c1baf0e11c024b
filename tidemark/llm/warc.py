"""A content-addressed WARC archive: payloads once by SHA-256, record headers apart.

``write`` makes a record for each page. Of pages with equal payloads the one with the largest page_id is the
response; the others are revisits that refer to it. Headers go to one table as their exact
text; each payload goes once to another, under its digest. ``read`` checks every payload against its
digest and puts records together again with a join.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_at_exit, scratch_dir

#: Payloads of fewer bytes are never referred to.
LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four letters for each five hexadecimal digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, least_bytes: int = LEAST_BYTES, where: str | None = None) -> Archive:
    """Write the records of ``pages`` (page_id, url, html) under ``where``, or in the shared folder until the session ends.

    A null html is the empty payload, a null url has no header line; line ends in a url are percent-encoded. Rows
    that repeat the response's page_id and payload are responses too, with the payload stored once.
    """
    if where is None:
        where = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
        remove_at_exit(pages.sparkSession, where)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows = full.select("page_id", "url", "sha256", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    owners = rows.groupBy("sha256").agg(F.max("page_id").alias("owner"))
    shared = F.col("size") >= least_bytes
    first = F.col("page_id").eqNullSafe(F.col("owner"))
    revisit = shared & ~first
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner")))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    archive = Archive(f"{where}/headers", f"{where}/payloads")
    rows.join(owners, "sha256").select("sha256", header.alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    held = full.join(owners.withColumnRenamed("sha256", "key"), (F.col("sha256") == F.col("key")) & F.col("page_id").eqNullSafe(F.col("owner")), "left_semi").select("sha256", "payload")
    if pages.groupBy("page_id").count().where("count > 1").limit(1).count():
        held = held.dropDuplicates(["sha256"])
    held.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def _payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    stored = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256")))
    return stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def _field(name: str) -> Column:
    found = F.regexp_extract("header", f"\\n{name}: ([^\\r\\n]*)\\r", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record.

    What is said of the payload is computed from the stored bytes, revisits' from those referred to.
    """
    facts = _payloads(spark, archive).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    headers = spark.read.schema("sha256 string, header string").parquet(archive.headers)
    number = lambda name: F.regexp_extract(_field(name), "(-?[0-9]+)>$", 1)
    digest = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    out = headers.join(facts, "sha256")
    agreed = F.when(digest == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest differs from its payload's")).cast("string"))
    return out.select(F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"), _field("WARC-Target-URI").alias("url"), "payload_bytes", agreed.alias("payload_digest"), _field("WARC-Type").alias("record_type"), F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"))


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(header, block): the original records' bytes; a revisit's block is empty."""
    headers = spark.read.schema("sha256 string, header string").parquet(archive.headers)
    full = headers.where(_field("WARC-Type") == "response").join(_payloads(spark, archive), "sha256").select("header", F.col("payload").alias("block"))
    return full.unionByName(headers.where(_field("WARC-Type") == "revisit").select("header", F.lit(b"").alias("block")))
