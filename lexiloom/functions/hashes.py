"""Hashes of byte strings and their prefixes (FN9 to FN12). Equal bytes have equal hashes; the values are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.byte_strings import byte_at, prefix_bytes


def modulo(h: Column, m: int | None) -> Column:
    return h if m is None else F.pmod(h, F.lit(m))


def prefix_hash(b: Column, depth: Column | int, m: int | None = None) -> Column:
    """64 bits of the first `depth` bytes, or their remainder by m (FN9)."""
    return modulo(F.xxhash64(prefix_bytes(b, depth)), m)


def extended_hash(old: Column, b: Column, start: int, stop: int, m: int | None = None) -> Column:
    """The hash of `stop` bytes from that of `start` bytes: the hash of the bytes between is added by exclusive or (FN10)."""
    return modulo(old.bitwiseXOR(F.xxhash64(F.substring(b, start + 1, stop - start))), m)


def keyed_hash(b: Column, m: int, key: int = 0) -> Column:
    """A hash that differs with a key, as a remainder by m (FN11)."""
    return F.pmod(F.xxhash64(F.lit(key), b), F.lit(m))


def multiplied_hash(b: Column, depth: int, m: int) -> Column:
    """From 5381 on, times 33 and plus 33 times each of the first `depth` bytes up to a zero, in 64 bits, by m (FN12)."""
    number = "decimal(38,0)"
    start, size = F.lit(5381).cast(number), F.lit(str(2**64)).cast(number)
    zero = F.locate("00", F.hex(b))  # may stand between two bytes: looked for again byte by byte
    n = F.least(F.octet_length(b), F.lit(depth))
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: byte_at(b, i))).otherwise(F.array().cast("array<int>"))
    ends = F.array_position(codes, F.lit(0))
    codes = F.when((zero > 0) & (ends > 0), F.slice(codes, 1, ends.cast("int") - 1)).otherwise(codes)
    out = F.aggregate(codes, start, lambda h, c: (((h * 33 + c * 33).cast(number)) % size).cast(number))
    return (out % F.lit(m)).cast("long")
