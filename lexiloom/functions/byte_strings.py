"""Byte-string functions as built-in expressions, so that they stay in the JVM (FN1 to FN8, FN13, FN14).

Lengths and prefixes count bytes of UTF-8; comparison is by unsigned bytes, a proper prefix first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest common prefix that lcp_bytes can count: 2**LCP_BITS - 1 bytes.
LCP_BITS = 31


def as_bytes(col: Column | str) -> Column:
    """A string as its bytes; binary columns pass through (S1 to S3)."""
    return F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary")


def byte_length(b: Column) -> Column:
    return F.octet_length(b).cast("long")


def prefix_bytes(b: Column, n: Column | int) -> Column:
    """The first n bytes (FN6, PRJ2)."""
    return F.substring(b, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def suffix_bytes(b: Column, skip: Column) -> Column:
    """What follows the first `skip` bytes (PRJ3)."""
    return F.substring(b, skip.cast("int") + 1, F.octet_length(b))


def lcp_bytes(a: Column, b: Column) -> Column:
    """Length of the longest common prefix (FN4); null if either is null.

    Equality of prefixes is monotone, so the length is found bit by bit from the highest: 31 comparisons at most, each
    of no more bytes than are left.
    """
    pair = F.struct(a.alias("a"), b.alias("b"), F.least(F.octet_length(a), F.octet_length(b)).alias("most"))
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(LCP_BITS - 1, -1, -1)])

    def of(p: Column) -> Column:
        def step(at: Column, bit: Column) -> Column:
            cut = lambda x: F.substring(x, (at + 1).cast("int"), bit.cast("int"))
            return F.when((at + bit <= p["most"]) & (cut(p["a"]) == cut(p["b"])), at + bit).otherwise(at)

        return F.aggregate(bits, F.lit(0).cast("long"), step)

    return F.when(a.isNotNull() & b.isNotNull(), F.transform(F.array(pair), of)[0])


def byte_at(b: Column, i: Column) -> Column:
    """The byte at place i (from 0) as a number; past the end it is 0, the end of a string."""
    return F.coalesce(F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def compare_bytes(a: Column, b: Column, known: Column | None = None) -> Column:
    """How much the first byte that differs is greater in a than in b, the end counting as 0: below, at or above 0 (FN2).

    known: bytes that both share surely, which aren't looked at again.
    """
    skip = F.lit(0) if known is None else known
    at = (skip + lcp_bytes(suffix_bytes(a, skip), suffix_bytes(b, skip))).cast("int")
    return byte_at(a, at) - byte_at(b, at)


def not_above(a: Column, b: Column) -> Column:
    """(leq, lcp): whether a comes before b or equals it, and the bytes that they share (FN3)."""
    return F.struct((a <= b).alias("leq"), lcp_bytes(a, b).alias("lcp"))


def same_byte(a: Column, b: Column, depth: Column) -> Column:
    """Whether both have the same byte at a depth; past the end there is none (FN5)."""
    return (byte_at(a, depth) == byte_at(b, depth)) & (byte_at(a, depth) != 0)


def lower_byte(a: Column, b: Column, depth: Column, or_equal: bool = False) -> Column:
    """Whether a's byte at a depth is below b's, or equal to it; the end counts as 0 (FN5)."""
    return byte_at(a, depth) <= byte_at(b, depth) if or_equal else byte_at(a, depth) < byte_at(b, depth)


def leading_uint(b: Column, n: int) -> Column:
    """The first n bytes as a big-endian number, short strings padded by zeros (FN7).

    Up to 7 bytes a long; 8 a decimal without sign; 16 a struct (high, low) of two such.
    """
    if n > 8:
        return F.struct(leading_uint(b, 8).alias("high"), leading_uint(suffix_bytes(b, F.lit(8)), n - 8).alias("low"))
    number = F.conv(F.rpad(F.hex(prefix_bytes(b, n)), 2 * n, "0"), 16, 10)
    return number.cast("long" if n < 8 else "decimal(20,0)")


def leading_zeros(v: Column) -> Column:
    """Zero bits of a 64-bit number before its first one; 64 for 0 (FN8)."""
    return F.when(v == 0, F.lit(64)).otherwise(64 - F.length(F.bin(v)))


def trailing_zeros(v: Column) -> Column:
    """Zero bits of a 64-bit number after its last one; 64 for 0 (FN8)."""
    return F.when(v == 0, F.lit(64)).otherwise(F.length(F.bin(v)) - F.length(F.rtrim(F.bin(v), F.lit("0"))))


def varint_size(v: Column) -> Column:
    """Bytes of a non-negative number in groups of seven bits (FN16)."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(F.bin(v)) / F.lit(7.0)).cast("long"))


def golomb_parameter(largest: Column, count: Column) -> Column:
    """The power of two not above largest / count, 1 at least (FN14)."""
    ratio = F.floor(largest / F.greatest(count, F.lit(1)))
    return F.when(ratio < 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), F.length(F.bin(ratio.cast("long"))) - 1).cast("long"))


def next_power_of_two(v: Column) -> Column:
    """The least power of two not below v (FN13)."""
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), F.length(F.bin((v - 1).cast("long")))).cast("long"))
