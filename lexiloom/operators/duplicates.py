"""Duplicates of strings and prefixes, and checks of results (AGG7 to AGG10, FLT1, SET1 to SET4, CHK1 to CHK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.hashes import prefix_hash
from lexiloom.operators.order import is_sorted, ranked


def groups(df: DataFrame) -> DataFrame:
    """(b, copies, first_id) of the strings that occur more than once; partial counts go over the network (AGG7, AGG8)."""
    return df.groupBy("b").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def any_repeated(df: DataFrame) -> DataFrame:
    """One row: whether any string occurs more than once (AGG10)."""
    return groups(df).agg((F.count(F.lit(1)) > 0).alias("repeated"))


def ranges(df: DataFrame) -> DataFrame:
    """(b, begin, end): the ranks of equal strings in the sorted order (AGG9)."""
    return ranked(df).groupBy("b").agg(F.min("rank").alias("begin"), F.max("rank").alias("end")).filter("end > begin")


def prefix_hashes(df: DataFrame, depth: int, m: int | None = None) -> DataFrame:
    """(id, p): hashes, of 64 bits or below m, of the prefixes of strings with `depth` bytes or more; the strings stay where they are (EXC12)."""
    return df.filter(F.octet_length("b") >= depth).select("id", prefix_hash(F.col("b"), depth, m).alias("p"))


def prefix_candidates(df: DataFrame, depth: int) -> DataFrame:
    """(id): strings of at least `depth` bytes whose first `depth` bytes occur more than once (FLT1).

    Prefixes are compared by 64-bit hashes: a candidate may be one too many, never one too few.
    """
    own = prefix_hashes(df, depth)
    many = own.groupBy("p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return own.join(many, "p", "left_semi").select("id")


def witnesses(df: DataFrame, depth: int) -> DataFrame:
    """(id, witness): for each such string another one with the same prefix: the first, or the last for the first (CHK5)."""
    own = prefix_hashes(df, depth)
    two = own.groupBy("p").agg(F.min("id").alias("one"), F.max("id").alias("other"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return own.join(two, "p").select("id", F.when(F.col("id") == F.col("one"), F.col("other")).otherwise(F.col("one")).alias("witness"))


def complete_and_sorted(source: DataFrame, result: DataFrame) -> DataFrame:
    """One row: complete (as many strings and bytes as the source) and sorted (CHK2, S14)."""
    total = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"n{s}"), F.coalesce(F.sum(F.octet_length("b")), F.lit(0)).alias(f"c{s}"))
    sums = total(source, 1).join(total(result, 2))
    return sums.select(((F.col("n1") == F.col("n2")) & (F.col("c1") == F.col("c2"))).alias("complete")).join(is_sorted(result))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in one of two tables, as multisets (CHK3, SET3)."""
    lost = a.exceptAll(b).agg(F.count(F.lit(1)).alias("lost"))
    return lost.join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("added")))
