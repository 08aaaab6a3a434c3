"""FNV-1a hashes of bytes, as Columns; halves of 32 bits keep every product within a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: offset and prime of 32 bits, offset and prime of 64 bits (2**40 + 435).
OFFSET_32, PRIME_32 = 2166136261, 16777619
OFFSET_64, PRIME_64 = 14695981039346656037, 1099511628211
_LOW = 0xFFFFFFFF


def bytes_of(value: Column) -> Column:
    """The bytes of a string or binary as an array of numbers; null counts as empty."""
    h = F.hex(F.coalesce(value.cast("binary"), F.lit(b"")))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("long"))


def combine32(a: Column, b: Column) -> Column:
    """(a xor b) x prime, as 32 unsigned bits; also one step of the hash."""
    return (a.bitwiseXOR(b) * F.lit(PRIME_32).cast("long")).bitwiseAND(F.lit(_LOW))


def hash32(value: Column) -> Column:
    return F.aggregate(bytes_of(value), F.lit(OFFSET_32).cast("long"), combine32)


def _times_prime(high: Column, low: Column) -> Column:
    product = low * 435
    top = high * 435 + F.shiftrightunsigned(product, 32) + low * 256
    return F.struct(top.bitwiseAND(F.lit(_LOW)).alias("high"), product.bitwiseAND(F.lit(_LOW)).alias("low"))


def hash64(value: Column) -> Column:
    """16 lowercase hex digits: a BIGINT has no room for the sign-free value."""
    start = F.struct(F.lit(OFFSET_64 >> 32).cast("long").alias("high"), F.lit(OFFSET_64 & _LOW).cast("long").alias("low"))
    end = lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))
    return F.aggregate(bytes_of(value), start, lambda h, b: _times_prime(h["high"], h["low"].bitwiseXOR(b)), end)
