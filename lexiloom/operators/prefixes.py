"""Common and distinguishing prefixes (WIN1, WIN2, FLT1 to FLT3, AGG3 to AGG6, PRJ3 to PRJ5, SRT2, JN1, JN2, EXC8, EXC12)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import byte_length, prefix_bytes, suffix_bytes
from lexiloom.operators.order import ranked, with_common
from lexiloom.plans.scratch import materialise


def lcp_array(df: DataFrame) -> DataFrame:
    """(id, b, bucket, head, rank, lcp): bytes shared with the string before; 0 for the first (S4)."""
    return with_common(df).drop("next_lcp")


def distinguishing_prefix(df: DataFrame) -> DataFrame:
    """(id, b, rank, lcp, dp): dp is one byte more than is shared with either neighbour; a copy counts its end, too (S6)."""
    return with_common(df).withColumn("dp", F.greatest("lcp", "next_lcp") + 1).drop("next_lcp", "bucket", "head")


def payload(df: DataFrame) -> DataFrame:
    """distinguishing_prefix() with part: the bytes from lcp to dp, which a sorter has to move for a string (PRJ4)."""
    return distinguishing_prefix(df).withColumn("part", F.substring("b", F.col("lcp").cast("int") + 1, (F.col("dp") - F.col("lcp")).cast("int")))


def depths(longest: int) -> list[int]:
    """The tested depths: 8, then 8 + 16, 8 + 32, 8 + 64 ... up to the first above the longest string (S7)."""
    out, step = [8], 16
    while out[-1] <= longest:
        out.append(8 + step)
        step *= 2
    return out


def text_key() -> Column:
    """A hash of the whole string: with it, rows that share an id are told apart."""
    return F.xxhash64("b")


def _doubled(df: DataFrame) -> DataFrame:
    """(id, k, dp): prefix_doubling() with text_key()."""
    longest = df.agg(F.max(F.octet_length("b")).alias("n")).first()["n"]
    if longest is None:
        return df.select("id", text_key().alias("k"), F.lit(0).cast("long").alias("dp"))
    tested = depths(longest)
    n = byte_length(F.col("b"))
    hashes = F.array_compact(F.array(*[F.when(n >= d, F.xxhash64(prefix_bytes(F.col("b"), d))) for d in tested]))
    open_rows, done = materialise(df.select("id", text_key().alias("k"), n.alias("n"), hashes.alias("hashes")), "prefix-hashes"), []
    for level, d in enumerate(tested):
        done.append(open_rows.filter(F.col("n") < d).select("id", "k", F.col("n").alias("dp")))
        own = open_rows.filter(F.col("n") >= d).withColumn("h", F.get("hashes", F.lit(level)))
        many = own.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", F.lit(True).alias("again"))
        told = materialise(own.join(many, "h", "left").drop("h"), "prefix-round")
        done.append(told.filter("again is null").select("id", "k", F.lit(d).cast("long").alias("dp")))
        open_rows = told.filter("again").drop("again")
        if open_rows.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def prefix_doubling(df: DataFrame) -> DataFrame:
    """(id, dp): the first tested depth at which a string's prefix occurs once, or its length where it ends before (S8).

    One pass over the strings hashes their prefixes of all tested depths, about twice as many bytes as they have; the
    rounds move hashes only. Each counts those of one depth, and the strings whose hash occurs again go on to the next.
    Two prefixes with the same 64-bit hash can only make dp larger.
    """
    return _doubled(df).select("id", "dp")


def front_coded(df: DataFrame) -> DataFrame:
    """lcp_array() with rest: each string without the bytes it shares with the one before (PRJ3, EXC5)."""
    return lcp_array(df).withColumn("rest", suffix_bytes(F.col("b"), F.col("lcp")))


def front_decoded(coded: DataFrame) -> DataFrame:
    """(rank, b) from (bucket, rank, lcp, rest): strings rebuilt along each bucket (PRJ5).

    A bucket's first string is stored whole, so buckets decode on their own, in the order of their ranks.
    """

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = b"", None
        for chunk in chunks:
            out = []
            for k, lcp, rest in zip(*(chunk.column(c).to_pylist() for c in ("bucket", "lcp", "rest")), strict=True):
                last = (b"" if k != bucket else last[:lcp]) + rest
                bucket = k
                out.append(last)
            yield pa.RecordBatch.from_arrays([chunk.column("rank"), pa.array(out, pa.binary())], names=["rank", "b"])

    return coded.select("bucket", "rank", "lcp", "rest").repartition("bucket").sortWithinPartitions("bucket", "rank").mapInArrow(task, "rank long, b binary")


def runs_for_decoding(df: DataFrame) -> DataFrame:
    """front_coded() with each bucket's first string whole: the form that front_decoded() reads."""
    coded, head = front_coded(df), F.col("head")
    return coded.withColumns({"lcp": F.when(head, F.lit(0).cast("long")).otherwise(F.col("lcp")), "rest": F.when(head, F.col("b")).otherwise(F.col("rest"))}).drop("head")


def short_strings(df: DataFrame) -> DataFrame:
    """(id, k, b): each string cut to its distinguishing prefix, with text_key(): what a sort has to move (EXC8)."""
    dp = _doubled(df).dropDuplicates(["id", "k"])
    return df.withColumn("k", text_key()).join(dp, ["id", "k"]).select("id", "k", prefix_bytes(F.col("b"), F.col("dp").cast("int")).alias("b"))


def sort_by_prefixes(df: DataFrame) -> DataFrame:
    """(rank, id, k): the permutation of the sort, made from distinguishing prefixes alone (SRT2, S10).

    Strings differ within these prefixes unless they are equal, so the prefixes' order is the strings'; ids break ties.
    k tells rows with the same id apart.
    """
    return ranked(short_strings(df)).select("rank", "id", "k")


def fetched(permutation: DataFrame, df: DataFrame) -> DataFrame:
    """(rank, id, b): the strings in the order of a permutation (rank, id, k) (JN1, JN2)."""
    once = df.withColumn("k", text_key()).dropDuplicates(["id", "k"])
    return permutation.join(once, ["id", "k"]).select("rank", "id", "b")


def statistics(df: DataFrame) -> DataFrame:
    """One row: strings, bytes, sums of lcp and dp, the mean lcp as a whole number, dp's share of the bytes (AGG3 to AGG6)."""
    n, d = F.count(F.lit(1)), F.sum("dp")
    size = F.sum(F.octet_length("b").cast("long"))
    return distinguishing_prefix(df).agg(n.alias("strings"), size.alias("bytes"), F.sum("lcp").alias("sum_lcp"), d.alias("sum_dp"), F.floor(F.sum("lcp") / n).cast("long").alias("avg_lcp"), F.round(d / size, 6).alias("dp_ratio"))
