"""Operator 9, a uniform shuffle into shards of exact sizes [native: DataFrame functions only].

Rows lie in source partitions. How many rows of each go to each shard is drawn first, exactly as a uniform
permutation of all rows would make it: a matrix with the given row sums (partition sizes) and column sums (shard
sizes), drawn cell by cell from hypergeometric laws. Then each partition is permuted and cut by its row of the matrix,
the rows are exchanged, and each shard is permuted again. No row needs a global sort or a global counter.

The matrix is drawn in two levels, so that no single row of the plan holds more than FAN partitions: partitions form
FAN groups at most, groups are drawn first, then every group draws its own partitions on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.shared import cell_of, materialise, seeded, text_or_empty, unit, unsigned

FAN = 1024
#: Rows that a source partition, and a block of a shard, hold on average.
PARTITION_ROWS = 5_000


def hypergeometric(whole: Column, good: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric variate (drawn of whole, good marked) by inversion from the uniform u.

    The weights are counted from the mode outwards by their exact ratios, over 12 standard deviations either way,
    beyond which they vanish in double precision.
    """
    n, k, m = (c.cast("double") for c in (whole, good, drawn))
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")
    mode = F.greatest(F.lit(0.0), m - (n - k), F.least(mode, m, k))
    part = k / F.greatest(n, F.lit(1.0))
    width = F.ceil(12 * F.sqrt(F.greatest(m * part * (1 - part), F.lit(0.0))) + 30).cast("int")
    steps = F.sequence(F.lit(1), width)
    seen = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), mode.alias("mode"), u.alias("u"), steps.alias("steps"))

    def draw(s: Column) -> Column:
        def up(w: Column, x: Column) -> Column:  # the weight of x + 1
            return w * (s["k"] - x) * (s["m"] - x) / ((x + 1) * F.greatest(s["n"] - s["k"] - s["m"] + x + 1, F.lit(1.0)))

        def down(w: Column, x: Column) -> Column:  # the weight of x - 1
            return w * x * (s["n"] - s["k"] - s["m"] + x) / (F.greatest(s["k"] - x + 1, F.lit(1.0)) * F.greatest(s["m"] - x + 1, F.lit(1.0)))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("got"))

        def walk(weight, sign: int, before: Column, target: Column) -> Column:
            def step(a: Column, i: Column) -> Column:
                at = s["mode"] + sign * (i - 1)
                w = weight(a["w"], at)
                total = a["sum"] + w
                hit = a["got"].isNull() & (w > 0) & (before + total > target)
                return F.struct(w.alias("w"), total.alias("sum"), F.when(hit, at + sign).otherwise(a["got"]).alias("got"))

            return F.aggregate(s["steps"], start, step)

        none = F.lit(float("inf"))
        one = F.lit(1.0)
        sums = F.struct(walk(up, 1, one, none)["sum"].alias("up"), walk(down, -1, one, none)["sum"].alias("down"))

        def pick(t: Column) -> Column:
            target = s["u"] * (t["up"] + t["down"] + 1)
            above = walk(up, 1, one, target)["got"]
            below = walk(down, -1, one + t["up"], target)["got"]
            return F.when(target < 1, s["mode"]).otherwise(F.coalesce(above, below, s["mode"]))

        return F.transform(F.array(sums), pick)[0]

    return F.transform(F.array(seen), draw)[0].cast("long")


def matrix(rows: Column, columns: Column, seed: Column) -> Column:
    """array<array<long>> with row sums `rows` and column sums `columns` (arrays of long with equal totals)."""

    def row(state: Column, r: Column) -> Column:
        left = state["left"]
        start = F.struct(r.alias("n"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("whole"), F.array().cast("array<bigint>").alias("out"))

        def cell(a: Column, c: Column) -> Column:
            u = unit(F.xxhash64(seed, F.size(state["done"]), F.size(a["out"])))
            x = F.when(c == 0, F.lit(0).cast("long")).when(a["whole"] == c, a["n"]).otherwise(hypergeometric(a["whole"], c, a["n"], u))
            return F.transform(F.array(x), lambda y: F.struct((a["n"] - y).alias("n"), (a["whole"] - c).alias("whole"), F.concat(a["out"], F.array(y)).alias("out")))[0]

        drawn = F.aggregate(left, start, cell)["out"]
        return F.transform(F.array(drawn), lambda d: F.struct(F.zip_with(left, d, lambda a, b: a - b).alias("left"), F.concat(state["done"], F.array(d)).alias("done")))[0]

    return F.aggregate(rows, F.struct(columns.alias("left"), F.array().cast("array<array<bigint>>").alias("done")), row)["done"]


def communication(counts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(part, bounds): for each partition of counts (part, fan, n) the running totals of its rows over the shards."""
    groups = counts.groupBy("fan").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))  # FAN rows of FAN parts at most
    groups = groups.withColumn("total", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    top = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("fan", "total"))).alias("fans"))
    drawn = top.select("fans", matrix(F.col("fans.total"), F.array(*[F.lit(x).cast("long") for x in sizes]), F.lit(seed)).alias("m"))
    drawn = drawn.select(F.explode(F.arrays_zip(F.col("fans.fan").alias("fan"), F.col("m").alias("m"))).alias("x")).select("x.fan", "x.m")
    own = groups.join(drawn, "fan").select("parts", matrix(F.col("parts.n"), F.col("m"), F.xxhash64(F.lit(seed), "fan")).alias("rows"))
    cells = own.select(F.explode(F.arrays_zip(F.col("parts.part").alias("part"), F.col("rows").alias("counts"))).alias("x")).select("x.part", "x.counts")
    running = F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")))))
    return cells.select("part", running.alias("bounds"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """docs with two more columns: shard (0 to shards - 1) and slot (its place there, gapless from 0).

    Shard sizes differ by one at most; every assignment with these sizes is equally likely over the seeds. The hash of
    id and text orders the rows, so nulls, empty and repeated rows need no care: repeated rows are placed one by one,
    and which of two equal rows gets which place is open. An empty table gives no rows. Columns of docs named shard or
    slot are replaced.
    """
    rest = docs.drop("shard", "slot")
    h = lambda s: seeded(seed + s, rest[id_col], rest[text_col])
    keys = materialise(rest.select(h(1).alias("_lx_a"), h(2).alias("_lx_b"), h(3).alias("_lx_c")), "shard-keys")
    n = keys.count()
    parts = max(1, math.ceil(n / partition_rows))
    blocks = max(1, math.ceil(n / shards / partition_rows))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    part = cell_of(F.col("_lx_a"), F.lit(parts))
    counts = keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("fan", F.col("part") % F.lit(min(FAN, math.ceil(parts / FAN))))
    bounds = materialise(communication(counts, sizes, seed), "shard-matrix").withColumnRenamed("part", "_lx_part")

    def dealt(rows: DataFrame) -> DataFrame:
        """Permutes each partition, cuts it by its row of the matrix: adds shard and the block of the shard."""
        local = Window.partitionBy("_lx_part").orderBy("_lx_b")
        ranked = rows.withColumn("_lx_part", part).withColumn("_lx_rank", F.row_number().over(local) - 1)
        own = F.size(F.filter("bounds", lambda b: b <= F.col("_lx_rank"))).cast("int")
        return ranked.join(bounds, "_lx_part").withColumn("shard", own).withColumn("_lx_block", cell_of(F.col("_lx_c"), F.lit(blocks))).drop("bounds", "_lx_part", "_lx_rank", "_lx_a", "_lx_b")

    sums = dealt(keys).groupBy("shard", "_lx_block").agg(F.count(F.lit(1)).alias("n"))  # shards * blocks rows
    before = Window.partitionBy("shard").orderBy("_lx_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select("shard", "_lx_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lx_start")), "shard-starts")
    full = dealt(rest.select("*", h(1).alias("_lx_a"), h(2).alias("_lx_b"), h(3).alias("_lx_c")))
    again = Window.partitionBy("shard", "_lx_block").orderBy(unsigned(F.col("_lx_c")))
    placed = full.withColumn("_lx_at", F.row_number().over(again) - 1).join(starts, ["shard", "_lx_block"])
    return placed.select(*rest.columns, "shard", (F.col("_lx_start") + F.col("_lx_at")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns, taken from the rows as shard() places them."""
    placed = shard(docs.select("doc_id", "text"), shards)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty(F.col("text"))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
