"""Byte encodings as column expressions; all order-preserving ones sort as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the value envelope: its first byte.
TOMBSTONE_TAG, SET_TAG = 0, 1
#: Fixed values of the key escape: prefix, escaped zero, terminator.
KEY_PREFIX, ZERO, TERMINATOR = "01", "00FF", "0000"


def u64(value: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def u64_descending(value: Column) -> Column:
    """Eight bytes that sort from the largest value to the smallest."""
    return F.unhex(F.lpad(F.hex(F.bitwise_not(value)), 16, "0"))


def from_u64(raw: Column) -> Column:
    """The number in eight big-endian bytes, which must be under 2^63."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def version(generation: Column, sequence: Column) -> Column:
    """Sixteen bytes that sort by generation, then by sequence."""
    return F.concat(u64(generation), u64(sequence))


def escape_key(key: Column) -> Column:
    """A binary key as a byte string that no other key's is a prefix of, in key order."""
    pairs = F.regexp_replace(F.hex(key), "(..)", "$1 ")
    escaped = F.replace(F.replace(pairs, F.lit("00 "), F.lit(ZERO + " ")), F.lit(" "), F.lit(""))
    return F.unhex(F.concat(F.lit(KEY_PREFIX), escaped, F.lit(TERMINATOR)))


def unescape_key(raw: Column) -> Column:
    """The key in what ``escape_key`` made; null for anything else."""
    digits = F.hex(raw)
    inner = F.substring(digits, F.lit(3), F.length(digits) - 6)
    spaced = F.regexp_replace(inner, "(..)", "$1 ")
    plain = F.replace(F.replace(spaced, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit(""))
    return F.when(digits.startswith(KEY_PREFIX) & digits.endswith(TERMINATOR), F.unhex(plain))


def physical_key(key: Column, at: Column) -> Column:
    """Key ascending, version descending."""
    return F.concat(escape_key(key), u64_descending(at))


def envelope(value: Column) -> Column:
    """A stored value: tagged bytes, or the tombstone's tag alone for null."""
    return F.when(value.isNull(), F.unhex(F.lit(f"{TOMBSTONE_TAG:02X}"))).otherwise(F.concat(F.unhex(F.lit(f"{SET_TAG:02X}")), value))


def envelope_kind(raw: Column) -> Column:
    """SET, TOMBSTONE or CORRUPT: empty, trailing bytes after a tombstone, or an unknown tag."""
    tag = F.hex(F.substring(raw, 1, 1))
    return (
        F.when(tag == f"{SET_TAG:02X}", "SET")
        .when((tag == f"{TOMBSTONE_TAG:02X}") & (F.octet_length(raw) == 1), "TOMBSTONE")
        .otherwise("CORRUPT")
    )


def point_range(key: Column) -> tuple[Column, Column]:
    """The half-open range that holds just ``key``."""
    return key, F.concat(key, F.unhex(F.lit("00")))


def page_key(*numbers: Column) -> Column:
    """Fixed-width numbers one after the other: byte order is tuple order."""
    return F.concat(*[u64(n) for n in numbers])
