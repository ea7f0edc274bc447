"""Lines, whole files and suffixes (SRC1 to SRC8), and their sinks (SNK1, SNK2, SNK7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators.order import global_index


def lines(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """(value): one row for each line ended by a line feed; empty lines stay, carriage returns too (SRC1, S11)."""
    out = spark.read.option("lineSep", "\n").text(path)
    return out if keep_empty else out.filter(F.length("value") > 0)


def counted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): how many lines each file has (SRC5)."""
    return lines(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines"))


def write_lines(df: DataFrame, path: str, value: str = "value") -> None:
    """One text file for each partition, a string a line (SNK1, SNK2)."""
    df.select(F.col(value).cast("string").alias("value")).write.text(path, lineSep="\n")


def drop_empty_lines(spark: SparkSession, source: str, target: str) -> None:
    """Copies files of lines without the empty ones (SNK7)."""
    write_lines(lines(spark, source, keep_empty=False), target)


def first_bytes(df: DataFrame, limit: int, order: str) -> DataFrame:
    """The rows (value) whose bytes, each with its line feed, lie within the first `limit` of the order (SRC1 max_size)."""
    sized = df.withColumn("size", F.octet_length("value").cast("long") + 1).withColumn("part", F.floor(F.col(order) / 10_000))
    sums = sized.groupBy("part").agg(F.sum("size").alias("s"))
    starts = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    run = F.sum("size").over(Window.partitionBy("part").orderBy(order))
    return sized.join(starts, "part").withColumn("upto", F.col("start") + run).filter(F.col("upto") <= limit).drop("size", "part", "start", "upto")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, value): whole files as they are (SRC6, SRC7)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")


def equal_parts(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Lines dealt in order into parts of equal counts, the last takes the rest (SRC4)."""
    n = df.count()
    each = max(1, n // parts)
    indexed = global_index(df.withColumn("_p", F.floor(F.col(order) / 10_000)), "_p", order).drop("_p")
    return indexed.withColumn("part", F.least(F.floor(F.col("idx") / each), F.lit(parts - 1)).cast("long"))


#: Bytes of suffixes that a task writes out, on average, and what a row takes besides its suffix.
SUFFIX_BYTES, SUFFIX_ROW = 64 << 20, 64


def suffixes(texts: DataFrame, text: str = "value", key: str = "id", with_empty: bool = False) -> DataFrame:
    """(key, pos, b): every suffix of each text by bytes, line feeds removed before; pos from 1 (SRC8, SNK2, S12).

    This writes out O(n^2) bytes for a text of n bytes: for short texts only. The texts are dealt to tasks by what they
    will take, as a file of short texts that one task reads can be some thousand times smaller than its suffixes.
    """
    clean = texts.select(key, F.replace(F.col(text), F.lit("\n"), F.lit("")).cast("binary").alias("t"))
    last = F.octet_length("t") + (1 if with_empty else 0)
    n = F.octet_length("t").cast("double")
    total = clean.agg(F.sum(n * (n + 1) / 2 + SUFFIX_ROW * (n + 1))).first()[0] or 0
    parts = math.ceil(total / SUFFIX_BYTES)
    dealt = clean.repartition(parts, F.xxhash64(key, "t")) if parts > 1 else clean
    at = dealt.filter(last > 0).withColumn("pos", F.explode(F.sequence(F.lit(1), last)))
    return at.select(key, F.col("pos").cast("long").alias("pos"), F.substring(F.col("t"), F.col("pos"), F.octet_length("t")).alias("b"))
