"""Content-checked objects in a folder, and an audit of many at once."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """The object is there with other content, or changed since it was read."""


class Corrupt(Exception):
    """Content differs from the digest or length that was expected."""


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def put_if_absent(path: str, data: bytes) -> bool:
    """Create the object whole; True if this call made it, False if the same content was there."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as file:
        file.write(data)
    try:
        os.link(temporary, path)
        return True
    except FileExistsError:
        if digest(get_verified(path)) != digest(data):
            raise Conflict(path) from None
        return False
    finally:
        os.unlink(temporary)


def compare_and_put(path: str, data: bytes, expected: str) -> None:
    """Replace the object if its content still has the expected digest."""
    if digest(get_verified(path)) != expected:
        raise Conflict(path)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as file:
        file.write(data)
    os.replace(temporary, path)


def get_verified(path: str, expected: str | None = None, length: int | None = None) -> bytes:
    with open(path, "rb") as file:
        data = file.read()
    if (length is not None and len(data) != length) or (expected is not None and digest(data) != expected):
        raise Corrupt(path)
    return data


def get_range_verified(path: str, start: int, end: int, expected: str) -> bytes:
    """Bytes [start, end) of an object whose whole content has the expected digest."""
    data = get_verified(path, expected)
    if not 0 <= start <= end <= len(data):
        raise ValueError("range outside the object")
    return data[start:end]


def delete_reserved(path: str, reserved: set[str]) -> bool:
    """Delete an object that a collection reserved; others are refused."""
    if path not in reserved:
        raise Conflict(path)
    if not os.path.exists(path):
        return False
    os.unlink(path)
    return True


def audit(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(path, problem) of ``expected`` (path, sha256, length) that are missing or differ, and of strangers."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("path"), F.sha2("content", 256).alias("found"), F.col("length").alias("size"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("size") != F.col("length"), "length").when(F.col("found") != F.col("sha256"), "content")
    return expected.join(files, "path", "full").select("path", problem.alias("problem")).where("problem is not null")
