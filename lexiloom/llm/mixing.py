"""Operator 7, mixing sources to target weights by Pfair scheduling [native: DataFrame functions only].

Each source is a task with rate w = weight / total; its blocks are subtasks. Block j (from 0) is released at slot
floor(j / w) and due at slot ceil((j + 1) / w). Earliest deadline first among the released blocks fills every slot and
meets every deadline, so after any number of slots a source has had less than one block more or less than its share.

Weights are integers, so the schedule repeats after `total` slots: one period is computed, blocks are placed in it by
arithmetic. When a source has no blocks left, a new phase begins with the sources that have, at the same relative
weights, so that all rows are placed. A phase needs a schedule of as many slots as its weights add up to. The phases
are a small table with a row for each source, joined to the rows.
"""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.shared import cell_of, materialise, seeded, unsigned

#: Rows of a block, and rows that one task numbers on average.
BLOCK_ROWS, TASK_ROWS = 32, 5_000
#: The production mix of the queries; the sources that aren't listed share one weight equally.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2}
OTHER = "(other)"


def period(weights: dict[str, int]) -> list[str]:
    """The source of each of the sum(weights) slots of a period, by earliest deadline first."""
    total = sum(weights.values())
    later = [(0, -(-total // w), s, 0) for s, w in sorted(weights.items())]  # release, deadline, source, block
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(later)
    slots = []
    for t in range(total):
        while later and later[0][0] <= t:
            _, due, s, j = heapq.heappop(later)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        assert due > t, "a full schedule of weights that add up meets every deadline"
        slots.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(later, ((j + 1) * total // weights[s], -(-(j + 2) * total // weights[s]), s, j + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """The phases of a mix: each with its period, first slot, and blocks that each source had had before it."""
    had, start, out = dict.fromkeys(blocks, 0), 0, []
    while live := {s: weights[s] for s, n in blocks.items() if n > had[s]}:
        live = {s: w // math.gcd(*live.values()) for s, w in live.items()}
        slots = period(live)
        at = {s: [i for i, x in enumerate(slots) if x == s] for s in live}
        left = {s: blocks[s] - had[s] for s in live}
        end = min((left[s] - 1) // live[s] * len(slots) + at[s][(left[s] - 1) % live[s]] + 1 for s in live)
        out.append({"at": at, "len": len(slots), "start": start, "had": {s: had[s] for s in live}})
        for s in live:
            had[s] += end // len(slots) * live[s] + sum(i < end % len(slots) for i in at[s])
        start += end
    return out


def plan_table(spark: SparkSession, total: dict[str, int], plan: list[dict]) -> DataFrame:
    """A row for each source: its rows, and its phases of phases() in order."""
    rows = [{"_lx_key": s, "_lx_n": n, "_lx_phases": [{"had": p["had"][s], "start": p["start"], "len": p["len"], "at": p["at"][s]} for p in plan if s in p["at"]]} for s, n in total.items()]
    phase = pa.struct([("had", pa.int64()), ("start", pa.int64()), ("len", pa.int64()), ("at", pa.list_(pa.int64()))])
    # from Arrow: lists would start Python workers of their own on the executors, which stay for a minute
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("_lx_key", pa.string()), ("_lx_n", pa.int64()), ("_lx_phases", pa.list_(phase))])))


def slot_of(block: Column, phases_of: Column) -> Column:
    """The slot of a block, from the phases of its source in plan_table()."""
    p = F.element_at(F.filter(phases_of, lambda x: x["had"] <= block), -1)
    j, w = block - p["had"], F.size(p["at"])
    return (p["start"] + F.floor(j / w) * p["len"] + F.element_at(p["at"], (j % w + 1).cast("int"))).cast("long")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, other_weight: int = 6, block_rows: int = BLOCK_ROWS, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns stream, block, slot and position (gapless from 0 over all rows): the order of the mix.

    weights: positive integers by source. The sources that aren't listed, null being one, share other_weight equally:
    each has blocks, releases and deadlines of its own, and `stream` names them OTHER together. A block is numbered
    within its source and holds rows of it alone. Within a source rows come in the order of a seeded hash of id and
    text: equal rows are placed one by one, in any order. No row is dropped; the last block of a source may be short. An
    empty table gives no rows. Columns of docs with the new names are replaced.
    """
    weights = WEIGHTS if weights is None else weights
    if any(w != int(w) or w < 1 for w in [*weights.values(), other_weight]) or OTHER in weights:
        raise ValueError("weights are positive integers")
    rest = docs.drop("stream", "block", "slot", "position")
    source = rest[source_col].cast("string")
    key = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))
    stream = F.when(source.isin(*weights), source).otherwise(F.lit(OTHER)) if weights else F.lit(OTHER)
    keyed = rest.withColumns({"stream": stream, "_lx_key": key, "_lx_h": seeded(seed, rest[id_col], rest[text_col])})
    total = {r["_lx_key"]: r["n"] for r in keyed.groupBy("_lx_key").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
    if not total:
        none = F.lit(None).cast("long")
        return rest.withColumns({"stream": F.lit(OTHER), "block": none, "slot": none, "position": none})
    listed = {f"={s}": w for s, w in weights.items()}
    others = max(1, sum(k not in listed for k in total))
    full = {k: listed[k] * others if k in listed else other_weight for k in total}
    plan = phases({s: -(-n // block_rows) for s, n in total.items()}, full)
    known = plan_table(docs.sparkSession, total, plan)
    keyed = keyed.join(F.broadcast(known.select("_lx_key", "_lx_n")), "_lx_key")
    cells = F.ceil(F.col("_lx_n") / TASK_ROWS).cast("long")
    keyed = keyed.withColumn("_lx_cell", cell_of(F.col("_lx_h"), cells))
    sums = keyed.groupBy("_lx_key", "_lx_cell").agg(F.count(F.lit(1)).alias("n"))  # a row for TASK_ROWS rows of input
    before = Window.partitionBy("_lx_key").orderBy("_lx_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select("_lx_key", "_lx_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lx_start")), "mix-starts")
    order = Window.partitionBy("_lx_key", "_lx_cell").orderBy(unsigned(F.col("_lx_h")))
    numbered = keyed.withColumn("_lx_at", F.row_number().over(order) - 1).join(starts, ["_lx_key", "_lx_cell"])
    index = F.col("_lx_start") + F.col("_lx_at")
    placed = numbered.withColumn("block", F.floor(index / block_rows).cast("long")).join(F.broadcast(known.select("_lx_key", "_lx_phases")), "_lx_key")
    placed = placed.withColumn("slot", slot_of(F.col("block"), F.col("_lx_phases")))
    # a short last block closes the gap that it would leave behind it
    gaps = [(slot_value(s, -(-n // block_rows) - 1, plan), -n % block_rows) for s, n in total.items() if n % block_rows]
    position = F.col("slot") * block_rows + index % block_rows
    if gaps:
        short = F.from_json(F.lit(json.dumps([{"last": a, "gap": g} for a, g in gaps])), "array<struct<last: long, gap: long>>")
        position = position - F.aggregate(short, F.lit(0).cast("long"), lambda a, x: a + F.when(F.col("slot") > x["last"], x["gap"]).otherwise(0))
    return placed.withColumn("position", position.cast("long")).select(*rest.columns, "stream", "block", "slot", "position")


def slot_value(stream: str, block: int, plan: list[dict]) -> int:
    """slot_of() for one block, as a number."""
    p = [p for p in plan if stream in p["at"] and block >= p["had"][stream]][-1]
    at, j = p["at"][stream], block - p["had"][stream]
    return p["start"] + j // len(at) * p["len"] + at[j % len(at)]


def in_mix_order(mixed: DataFrame, part_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of mix() dealt by position, so that a writer's files, in the order of their names, hold the mix."""
    n = mixed.agg((F.max("position") + 1).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(n / part_rows))
    return mixed.repartitionById(parts, F.least(F.floor(F.col("position") / part_rows), F.lit(parts - 1)).cast("int")).sortWithinPartitions("position")
