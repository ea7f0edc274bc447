"""Sort runs with their metrics, as a function and from a shell: python -m lexiloom.run --generator ratio --size 100000"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import varint_size
from lexiloom.operators import duplicates, order, prefixes
from lexiloom.plans.scratch import materialise
from lexiloom.sources import generators, metrics, text

GENERATORS = ("random", "ratio", "lines", "skewed", "suffixes")
#: What goes over the network for a string: all of it, with lcp, without the lcp, or from lcp to distinguishing prefix.
CODINGS = ("plain", "lcps", "front", "payload")


def generated(spark: SparkSession, generator: str, size: int, length: int, ratio: float, path: str) -> DataFrame:
    """(id, b) by one of GENERATORS; lines and suffixes come from the files of a path."""
    if generator in ("lines", "suffixes"):
        rows = text.lines(spark, path).select(F.monotonically_increasing_id().alias("id"), "value")
        if generator == "suffixes":
            rows = text.suffixes(rows).select(F.xxhash64("id", "pos").alias("id"), "b")
        return rows.select("id", F.col("b" if generator == "suffixes" else "value").cast("binary").alias("b"))
    if generator == "random":
        return generators.skewed_random_strings(spark, size)
    return generators.ratio_strings(spark, size, length, ratio, skewed=generator == "skewed")


def moved_bytes(rows: DataFrame, coding: str, compress: bool) -> DataFrame:
    """One row (value): bytes that a coding moves for distinguishing_prefix(), an end byte for each string, lcps as varints if compress."""
    n, lcp = F.octet_length("b").cast("long") + 1, varint_size(F.col("lcp")) if compress else F.lit(8)
    each = {"plain": n, "lcps": n + lcp, "front": n - F.col("lcp") + lcp, "payload": F.col("dp") - F.col("lcp") + 1 + lcp}
    return rows.agg(F.sum(each[coding]).cast("long").alias("value"))


def run(spark: SparkSession, generator: str = "ratio", size: int = 100_000, length: int = 50, ratio: float = 0.5, path: str = "", by_prefixes: bool = False, policy: str = "strings", indexed: bool = True, parts: int = 8, coding: str = "plain", compress: bool = False, iterations: int = 5, check: bool = False, exhaustive: bool = False, strong: bool = False, processes: int = 1) -> DataFrame:
    """(iteration, phase, operation, type, value): times in ns, counts, and 1 or 0 for checks, of each iteration.

    size counts strings of each process unless strong. Iteration 0 is a warm-up. policy and indexed cut the order into
    parts, whose greatest share of the strings is reported in millionths. by_prefixes sorts distinguishing prefixes only.
    """
    out = []
    for i in range(iterations):
        def note(phase: str, kind: str, value: int, i: int = i) -> None:
            out.append((i, phase, "sorting", kind, int(value)))

        rows = materialise(generated(spark, generator, size if strong else size * processes, length, ratio, path), "run-input")
        begin = time.perf_counter_ns()
        if by_prefixes:
            done = prefixes.fetched(prefixes.sort_by_prefixes(rows), rows)
        else:
            done = order.ranked(rows)
        done = materialise(done.select("rank", "id", "b"), "run-output")
        note("sorting_overall", "time", time.perf_counter_ns() - begin)
        near = materialise(prefixes.distinguishing_prefix(rows), "run-prefixes")
        for name, value in near.agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("b")).alias("chars"), F.sum("lcp").alias("lcps"), F.sum("dp").alias("prefixes")).first().asDict().items():
            note("statistics", name, value or 0)
        note("exchange", "bytes", moved_bytes(near, coding, compress).first()["value"] or 0)
        sizes = order.partitioned(near, parts, policy, indexed).groupBy("bucket").count()
        share = sizes.agg((F.max("count") * 1_000_000 / F.sum("count")).cast("long").alias("share")).first()["share"]
        note("partition", "largest", share or 0)
        if check:
            found = duplicates.complete_and_sorted(rows, done.select("rank", "b")).first()
            note("check", "complete_and_sorted", found["complete"] and found["sorted"])
        if exhaustive:
            found = duplicates.same_multiset(rows.select("b"), done.select("b")).first()
            note("check", "exhaustive", found["lost"] == found["added"] == 0)
    return spark.createDataFrame(out, "iteration long, phase string, operation string, type string, value long")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--generator", choices=GENERATORS, default="ratio")
    p.add_argument("--policy", choices=list(order.POLICIES), default="strings")
    p.add_argument("--coding", choices=CODINGS, default="plain")
    for name, kind, default in (("size", int, 100_000), ("length", int, 50), ("ratio", float, 0.5), ("path", str, ""), ("parts", int, 8), ("iterations", int, 5), ("processes", int, 1)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("by-prefixes", "compress", "check", "exhaustive", "strong"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--not-indexed", dest="indexed", action="store_false")
    spark = SparkSession.builder.getOrCreate()
    for row in metrics.result_text(run(spark, **vars(p.parse_args()))).collect():  # a few rows for each iteration
        print(row["value"])


if __name__ == "__main__":
    main()
