"""Similarity groups without pair tables: buckets, bounded blocks of pairs, and connected components.

Both near-duplicate operators work in the same steps. (1) Items get bucket keys (bands, tables). (2) Within a bucket,
sketches or codes are compared, and a spanning forest of the pairs that may be similar is kept: a bucket of m items
gives less than m edges. (3) Components of these edges are clusters: whatever is linked lies in one cluster. (4) Within
a cluster all pairs are checked on full data.

Steps 2 and 4 meet groups of any size: a group is cut into blocks of BLOCK items at random, and each pair of blocks is
a unit of work of its own, so no task holds more than two blocks, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import materialise

BLOCK = 1024


def block_pairs(items: DataFrame, key: str, size: str, item: str, block: int = BLOCK) -> DataFrame:
    """items once for each pair of blocks that they are in: adds bi <= bj, and side (0 in bi, 1 in bj only).

    The rows of a unit of work (key, bi, bj) come together, in one partition, sorted.
    """
    blocks = F.ceil(F.col(size) / F.lit(float(block))).cast("long")
    own = F.when(blocks > 1, F.pmod(F.xxhash64(F.lit(11), item), blocks)).otherwise(F.lit(0).cast("long"))
    pairs = items.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = pairs.withColumns({"bi": F.least("_own", "_other"), "bj": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_own", "_other")
    return pairs.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", "side", item)


def units(chunks: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables with the bounds of the whole units in them; a unit that runs on into the next batch waits for it."""
    rest: list[pa.RecordBatch] = []
    for chunk in chunks:
        if not chunk.num_rows:
            continue
        if rest and all(rest[-1].column(k)[-1].equals(chunk.column(k)[0]) and chunk.column(k)[0].equals(chunk.column(k)[-1]) for k in keys):
            rest.append(chunk)  # the same unit goes on through the whole batch
            continue
        table = pa.Table.from_batches([*rest, chunk])
        edges = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            edges |= v[1:] != v[:-1]
        starts = [0, *(np.flatnonzero(edges) + 1).tolist()]
        if len(starts) > 1:
            yield table, list(zip(starts, starts[1:]))
        rest = table.slice(starts[-1]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, [(0, table.num_rows)]


def fixed_rows(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class Forest:
    """Union-find over 0 .. n-1 by labels: cheap whole-row tests, few unions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Links i with others; the links that were new."""
        new = []
        for j in others.tolist():
            a, b = self.label[i], self.label[j]
            if a != b:
                self.label[self.label == b] = a
                new.append((i, j))
        return new


def forest_of(n: int, cross: np.ndarray | None, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs among n items; similar(i, js) tells which of js are similar to i.

    cross: the side of each item if only pairs across the sides are meant. Pairs that are connected already aren't
    compared; what remains decides the components exactly.
    """
    forest, edges = Forest(n), []
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        js = js[forest.label[js] != forest.label[i]]
        if cross is not None:
            js = js[cross[js] != cross[i]]
        if len(js):
            edges += forest.join(i, js[similar(i, js)])
    return edges


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def repeated(keyed: DataFrame) -> DataFrame:
    """(key, id, size) of the buckets of more than one item in keyed (key, id)."""
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "key")


def forest(dealt: DataFrame, passes: Callable, key: str) -> DataFrame:
    """(a, b): for each unit of block_pairs() a spanning forest of the pairs that pass.

    passes(table) gives, for the rows of a table, a function (i, js) -> which rows js pass with row i.
    """
    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in units(chunks, (key, "bi", "bj")):
            ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
            bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
            similar, out = passes(table), []
            for a, b in bounds:
                if b - a > 1:
                    cross = side[a:b] if bi[a] != bj[a] else None
                    own = forest_of(b - a, cross, lambda i, js, a=a: similar(a + i, a + js))
                    out += [(ids[a + i], ids[a + j]) for i, j in own]
            if out:
                yield edge_batch(out)

    return dealt.mapInArrow(task, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id with an edge (a, b).

    Large-star and small-star steps in turn (every node links its neighbours to the smallest one it knows) until the
    edges stay the same; each round is written to the shared folder. Hubs are joined, never gathered.
    """
    now = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        last, state = state, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
