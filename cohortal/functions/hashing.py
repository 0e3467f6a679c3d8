"""Stable hashes: the same value for the same text in every engine and on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(namespace: str, *parts: Column) -> Column:
    """sha-256 hex of the namespace and the parts, joined by colon and space."""
    return F.sha2(F.concat_ws(": ", F.lit(namespace), *(p.cast("string") for p in parts)), 256)


def keyed_hash(namespace: str, *parts: Column) -> Column:
    """sha-256 hex of the namespace and the parts, joined by a bare colon."""
    return F.sha2(F.concat_ws(":", F.lit(namespace), *(p.cast("string") for p in parts)), 256)


def hex_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as decimal(20,0)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def hash_fraction(digest: Column) -> Column:
    """The first 16 hex digits over 2^64: a double from 0 to 1."""
    return hex_number(digest, 16).cast("double") / F.lit(float(2**64))


def hash_bucket(namespace: str, key: Column, n: int) -> Column:
    """The first eight hex digits of the sha-256 of namespace:key, modulo n."""
    return (hex_number(keyed_hash(namespace, key), 8).cast("long") % n).cast("int")


def item_seed(key: Column) -> Column:
    """The same digits of the bare key, modulo 2^31 - 1."""
    return hex_number(F.sha2(key.cast("string"), 256), 8).cast("long") % (2**31 - 1)


def record_fraction(key: Column) -> Column:
    """The first eight hex digits over 2^32 - 1 (both ends included)."""
    return hex_number(F.sha2(key.cast("string"), 256), 8).cast("double") / F.lit(4294967295.0)


def signed_bin(signature: Column, bins: int) -> tuple[Column, Column]:
    """(bin, sign) of a signature: the first eight bytes modulo bins, and the low bit of the ninth byte."""
    digest = F.sha2(signature, 256)
    number = hex_number(digest, 16)
    place = (number - F.floor(number / F.lit(bins).cast("decimal(20,0)")) * bins).cast("int")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return place, sign
