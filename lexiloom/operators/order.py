"""Global order: splitters, buckets, ranks, neighbours (SRT1, SRT2, SRT7, SRT8, SRT13, SRT14, PAR1 to PAR9, SEL1 to SEL3).

A global rank by row_number() over everything would gather all rows in one task. Here splitters are drawn from a sample,
each row finds its bucket by binary search among them, and one shuffle by bucket and one local sort give the place of
each row in its bucket. That table is written once; the buckets' sizes, read from it, give the offsets. Order is by
(b, id): equal strings spread over buckets, however frequent they are, in either direction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import lcp_bytes, prefix_bytes
from lexiloom.plans.scratch import materialise

#: Rows of a bucket on average, sampled rows for each splitter, most buckets, bytes of all splitters together.
BUCKET_ROWS, OVERSAMPLING, MOST, SPLITTER_BYTES = 50_000, 32, 16_384, 16 << 20


def strings(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """(id, b): the canonical input; null strings are left out."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("binary").alias("b")).filter("b is not null")


def sample_size(parts: int, rows: int, least: int = 1, together: bool = False) -> int:
    """Rows that a task of `parts` samples of `rows` rows in all: by log2(parts) and by its own rows, odd (SEL3).

    together adds the two counts up instead of taking the greater. 0 without rows.
    """
    if rows == 0:
        return 0
    by_parts, by_rows = int(16 * math.log2(parts)), rows // parts // 50
    n = max(by_parts + by_rows if together else max(by_parts, by_rows), least)
    return n + 1 - n % 2


def sample_length(mean_lcp: int, twice: bool = True) -> int:
    """Bytes that sampled strings are cut to, from the mean common prefix of neighbours (PAR9)."""
    return (2 if twice else 1) * 100 * (mean_lcp + 5)


def splitters(df: DataFrame, parts: int, weight: Column | None = None, rows: int | None = None, descending: bool = False, longest: int | None = None, oversampling: int | None = OVERSAMPLING) -> list[tuple[bytes, int]]:
    """Up to parts - 1 places (b, id) that cut df (id, b) into about equal parts, by rows or by the sum of a weight.

    A hash of (id, b) samples oversampling * parts of the rows, or takes all if that is None: the cuts are then exact.
    Splitters are cut to `longest` bytes, and to SPLITTER_BYTES together; only they reach the driver. The sample is
    sorted in one task, oversampling * MOST rows at most.
    """
    if parts <= 1:
        return []
    room = SPLITTER_BYTES // parts
    own = df.select(prefix_bytes(F.col("b"), min(room, longest or room)).alias("b"), "id", (weight if weight is not None else F.lit(1)).cast("long").alias("w"), F.xxhash64(F.lit(5), "id", "b").alias("h"))
    if oversampling is not None:
        n = df.count() if rows is None else rows
        own = own.filter(F.shiftrightunsigned("h", 11) < F.lit(int(min(1.0, oversampling * parts / max(1, n)) * 2**53)))
    order = Window.orderBy(F.desc("b") if descending else F.col("b"), "id")
    run = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    total = F.greatest(F.sum("w").over(Window.partitionBy()), F.lit(1))
    part = own.withColumn("part", F.floor(run * parts / total))
    first = part.withColumn("new", F.coalesce(F.lag("part").over(order) < F.col("part"), F.lit(False))).filter("new")
    return _in_order([(bytes(r["b"]), r["id"]) for r in first.select("b", "id").collect()], descending)


def _in_order(cuts: list[tuple[bytes, int]], descending: bool) -> list[tuple[bytes, int]]:
    """Places in the order of (b, id): strings that were cut to the same bytes may stand in another one."""
    return sorted(sorted(cuts, key=lambda c: c[1]), key=lambda c: c[0], reverse=descending)


def bucket_of(cuts: list[tuple[bytes, int]], descending: bool = False, indexed: bool = True) -> Column:
    """How many splitters are not above a row's (b, id), by binary search (JN3 to JN5); by b alone if not indexed."""
    if not cuts:
        return F.lit(0)
    array = F.expr("array(" + ", ".join(f"named_struct('b', X'{b.hex()}', 'id', bigint('{i}'))" for b, i in cuts) + ")")

    def not_above(c: Column) -> Column:
        if not indexed:
            return c["b"] >= F.col("b") if descending else c["b"] <= F.col("b")
        before = c["b"] > F.col("b") if descending else c["b"] < F.col("b")
        return before | ((c["b"] == F.col("b")) & (c["id"] <= F.col("id")))

    bits = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(bits, F.lit(0), lambda at, bit: F.when((at + bit <= len(cuts)) & not_above(F.get(array, at + bit - 1)), at + bit).otherwise(at))


def bucketed(df: DataFrame, bucket_rows: int = BUCKET_ROWS, descending: bool = False) -> DataFrame:
    """df (id, b ...) with its bucket in the global order; a bucket's rows come together in one partition."""
    n = df.count()
    parts = min(MOST, max(1, math.ceil(n / bucket_rows)))
    cut = df.withColumn("bucket", bucket_of(splitters(df, parts, rows=n, descending=descending), descending))
    return cut.repartition(parts, "bucket") if parts > 1 else cut


def _starts(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """(bucket, start): what the buckets before hold; a row for each bucket."""
    sizes = rows.groupBy("bucket").agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def _within(descending: bool = False):
    return Window.partitionBy("bucket").orderBy(F.desc("b") if descending else F.col("b"), "id")


def ranked(df: DataFrame, bucket_rows: int = BUCKET_ROWS, descending: bool = False) -> DataFrame:
    """df with bucket and rank: the place of each row in the order of (b, id), from 1; ids ascend among equal strings.

    descending turns the order of b, not that among equal strings. Rows that are equal in both come in any order.
    """
    rows = materialise(bucketed(df, bucket_rows, descending).withColumn("_at", F.row_number().over(_within(descending))), "order")
    return rows.join(F.broadcast(_starts(rows)), "bucket").withColumn("rank", (F.col("start") + F.col("_at")).cast("long")).drop("start", "_at")


def with_common(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """ranked() with lcp and next_lcp: the bytes that a string shares with the one before and after, 0 at the ends.

    Both come from one pass over sorted buckets (WIN1 to WIN4); head tells a bucket's first row. Over the edge of a
    bucket they come from a table of the buckets' first and last strings, of which the numbers are broadcast.
    """
    cut = bucketed(df, bucket_rows).withColumn("_at", F.row_number().over(_within()))
    cut = cut.withColumn("lcp", lcp_bytes(F.lag("b").over(_within()), F.col("b")))
    rows = materialise(cut.withColumn("next_lcp", F.lead("lcp").over(_within())), "order-common")
    edges = rows.groupBy("bucket").agg(F.min_by("b", "_at").alias("first"), F.max_by("b", "_at").alias("last"))
    across = Window.orderBy("bucket")
    edges = edges.select("bucket", lcp_bytes(F.lag("last").over(across), F.col("first")).alias("edge"))
    edges = edges.withColumn("next_edge", F.lead("edge").over(across))
    joined = rows.join(F.broadcast(_starts(rows).join(edges, "bucket")), "bucket")
    zero = F.lit(0).cast("long")
    numbers = {"rank": (F.col("start") + F.col("_at")).cast("long"), "lcp": F.coalesce("lcp", "edge", zero), "next_lcp": F.coalesce("next_lcp", "next_edge", zero), "head": F.col("_at") == 1}
    return joined.withColumns(numbers).drop("start", "_at", "edge", "next_edge")


def global_index(df: DataFrame, part: str, order: str) -> DataFrame:
    """Rows numbered from 0 over parts in their order: position in the part plus the sizes of the parts before (WIN5)."""
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return df.join(starts, part).withColumn("idx", (F.col("start") + local).cast("long")).drop("start")


def middle(df: DataFrame, k: int) -> DataFrame:
    """The k rows in the middle of the order, the lower ones of two choices (PRJ7); all if there are fewer."""
    rows = ranked(df)
    begin = F.greatest(F.floor((F.count(F.lit(1)) - k) / 2), F.lit(0)).cast("long")
    return rows.join(F.broadcast(rows.agg(begin.alias("begin"))), (F.col("rank") > F.col("begin")) & (F.col("rank") <= F.col("begin") + k)).drop("begin")


def median(df: DataFrame) -> DataFrame:
    """The row in the middle of the order, the lower of two (SEL1)."""
    return middle(df, 1)


def split_positions(df: DataFrame, values: list[bytes]) -> DataFrame:
    """(k, rows, below, upto, position) for each value: where the order is split by it, as near to the middle as the
    rows that equal it allow (SEL2). One pass over df for all values."""
    counts = [F.count(F.lit(1)).alias("rows")]
    for k, v in enumerate(values):
        counts += [F.count(F.when(F.col("b") < F.lit(bytearray(v)), 1)).alias(f"below{k}"), F.count(F.when(F.col("b") <= F.lit(bytearray(v)), 1)).alias(f"upto{k}")]
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"below{k}").alias("below"), F.col(f"upto{k}").alias("upto")) for k in range(len(values))])
    at = df.agg(*counts).select("rows", F.explode(each).alias("x")).select("x.k", "rows", "x.below", "x.upto")
    half = F.floor(F.col("rows") / 2)
    return at.withColumn("position", F.when(F.col("below") < half, F.least(half, F.col("upto"))).otherwise(F.col("below")).cast("long"))


#: What the parts of partitioned() are equal in (PAR2 to PAR5); dp: the length of the distinguishing prefix.
POLICIES = {"strings": lambda: F.lit(1), "chars": lambda: F.octet_length("b"), "prefixes": lambda: F.col("dp")}


def partitioned(df: DataFrame, parts: int, policy: str = "strings", indexed: bool = True, longest: int | None = None, oversampling: int | None = OVERSAMPLING) -> DataFrame:
    """df with bucket: its part in the order, parts being about equal by the policy (PAR1 to PAR8).

    indexed: equal strings are dealt by id, else they stay together. longest cuts the splitters; oversampling=None takes
    all rows as the sample, which one task sorts: for tables of a known size.
    """
    return df.withColumn("bucket", bucket_of(splitters(df, parts, POLICIES[policy](), longest=longest, oversampling=oversampling), indexed=indexed))


def balanced_buckets(df: DataFrame, parts: int) -> DataFrame:
    """Buckets of the order whose sizes differ by one at most (SRT13)."""
    n = df.count()
    return ranked(df).withColumn("bucket", F.floor((F.col("rank") - 1) * parts / F.lit(max(1, n))).cast("long"))


def weighted_buckets(df: DataFrame, parts: int) -> DataFrame:
    """Buckets of the order with about equal bytes: exact running totals decide, by row of the order (PAR3, PAR5)."""
    rows = ranked(df).withColumn("w", F.octet_length("b").cast("long"))
    total = rows.agg(F.greatest(F.sum("w"), F.lit(1)).alias("total"))
    local = F.coalesce(F.sum("w").over(Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.join(F.broadcast(_starts(rows, F.col("w"))), "bucket").join(F.broadcast(total))
    return at.withColumn("bucket", F.floor((F.col("start") + local) * parts / F.col("total")).cast("long")).drop("start", "total")


def is_sorted(df: DataFrame, by: str = "rank") -> DataFrame:
    """One row: whether b never falls along `by` (WIN10, CHK1). An empty table is sorted."""
    along = bucketed(df.select(F.col(by).cast("long").alias("id"), F.col("b").alias("v"), F.lit(b"").alias("b")))
    rising = along.withColumn("ok", F.coalesce(F.lag("v").over(_within()) <= F.col("v"), F.lit(True)))
    edges = rising.groupBy("bucket").agg(F.every("ok").alias("ok"), F.min_by("v", "id").alias("first"), F.max_by("v", "id").alias("last"))
    across = F.coalesce(F.lag("last").over(Window.orderBy("bucket")) <= F.col("first"), F.lit(True))  # a row for each bucket
    return edges.select((F.col("ok") & across).alias("ok")).agg(F.coalesce(F.every("ok"), F.lit(True)).alias("sorted"))
