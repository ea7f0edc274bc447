"""Generated strings (SRC9 to SRC15). All are functions of the row number and a seed, so any task can make any row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digits(i: Column, count: int) -> Column:
    """The last `count` digits of i in base 26, as letters from A, most significant first; those from the 14th on are A."""
    low = [F.chr(65 + F.pmod(F.floor(i / F.lit(26**k)), F.lit(26))) for k in range(min(count, 13) - 1, -1, -1)]
    return F.concat(F.lit("A" * (count - len(low))), *low)


def ratio_shape(n: int, length: int, ratio: float) -> tuple[int, int]:
    """(digits, length) of strings of which about `ratio` is distinguishing: enough digits for n different ones."""
    least = math.ceil(math.log(n) / math.log(26)) if n > 1 else 1
    while 26**least < n:  # logarithms may fall short by rounding
        least += 1
    count = max(int(length * ratio), least)
    return count, max(length, count)


def ratio_strings(spark: SparkSession, n: int, length: int = 40, ratio: float = 0.5, filler: str = "A", skewed: bool = False) -> DataFrame:
    """(id, b): distinguishing digits, then one filler letter; the first fifth is longer by 3 * length if skewed (SRC9, SRC11)."""
    count, total = ratio_shape(n, length, ratio)
    body = F.rpad(digits(F.col("id"), count), total, filler)
    if skewed:
        body = F.when(F.col("id") < F.lit(0.2 * n), F.concat(body, F.lit(filler * (3 * total)))).otherwise(body)
    return spark.range(n).select("id", body.cast("binary").alias("b"))


def counter_shape(n: int, length: int, ratio: float) -> tuple[int, int, int]:
    """(prefix, digits of each counter, padding) of counter_strings()."""
    half = math.ceil(0.5 * math.log(n) / math.log(26)) if n > 1 else 0
    prefix = max(0, int(length * ratio) - 2 * half)
    return prefix, half, max(0, length - prefix - 2 * half)


def counter_strings(spark: SparkSession, n: int, length: int = 40, ratio: float = 0.5) -> DataFrame:
    """(id, b): the older layout: Z up to the ratio, a slow and a fast counter in base 26, Z up to the length (SRC10)."""
    prefix, half, padding = counter_shape(n, length, ratio)
    fast = F.pmod(F.col("id"), F.lit(26**half))
    slow = F.floor(F.col("id") / F.lit(26**half))
    body = F.concat(F.lit("Z" * prefix), digits(slow, half), digits(fast, half), F.lit("Z" * padding))
    return spark.range(n).select("id", body.cast("binary").alias("b"))


def drawn(seed: int, what: Column, start: Column | int = 1, digits_used: int = 13) -> Column:
    """A number from hex digits of the MD5 of seed, row and what: any engine draws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), what.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, start, F.lit(digits_used)), 16, 10).cast("long")


def random_strings(spark: SparkSession, n: int, shortest: int = 10, longest: int = 20, letters: int = 26, seed: int = 0) -> DataFrame:
    """(id, b): letters from A on by a hash of seed, row and place; lengths even over the range (SRC12, SRC13)."""
    size = (shortest + drawn(seed, F.lit("n")) % (longest - shortest + 1)).cast("int")
    letter = lambda k: F.chr(65 + drawn(seed, F.floor(k / 8), (4 * (k % 8) + 1).cast("int"), 4) % letters)  # noqa: E731  eight of a digest
    body = F.when(size < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), letter), ""))
    return spark.range(n).select("id", body.cast("binary").alias("b"))


def skewed_random_strings(spark: SparkSession, n: int, shortest: int = 100, longest: int = 200, seed: int = 0) -> DataFrame:
    """(id, b): a quarter of longer strings over six letters, the rest over all (SRC12)."""
    few = random_strings(spark, n // 4, shortest + 100, longest + 100, 6, seed)
    rest = random_strings(spark, n - n // 4, shortest, longest, 26, seed + 7).withColumn("id", F.col("id") + n // 4)
    return few.unionByName(rest)


def prefixed_numbers(spark: SparkSession, n: int, prefix: str = "a") -> DataFrame:
    """(id, b): a prefix and the digits of 1 to n from the lowest on (SRC14)."""
    return spark.range(1, n + 1).select("id", F.concat(F.lit(prefix), F.reverse(F.col("id").cast("string"))).cast("binary").alias("b"))


def weighted_draws(spark: SparkSession, n: int, weights: list[float], seed: int = 0) -> DataFrame:
    """(id, drawn): n draws with replacement from positions with these weights (SRC15)."""
    total, run, cuts = sum(weights), 0.0, []
    for w in weights[:-1]:
        run += w
        cuts.append(run / total)
    u = drawn(seed, F.lit("u")) / F.lit(float(16**13))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= u)) if cuts else F.lit(0)
    return spark.range(n).select("id", at.cast("long").alias("drawn"))
