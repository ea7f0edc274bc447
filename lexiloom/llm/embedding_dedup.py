"""Operator 6, embedding near-dedup by iterative quantisation (ITQ) and multi-index Hamming tables.

A bounded sample of FIT_ROWS vectors, chosen by a hash of their ids, fits the codes: vectors are centred and turned to
their principal axes, and each rotation is learned by alternating signs and a Procrustes step, so that the axes cut the
cloud into balanced halves. Several rotations give a long code. It is cut into substrings, a table each; vectors that
agree in a substring are candidates. How many tables are needed is measured on the sample: pairs made at exactly the
threshold must miss all tables with a probability of MISS at most.

A pair belongs to the first table in which it agrees. A bucket's entries hold whole codes: those without another one
within the Hamming distance that a link may have, in a pair of this table, are dropped. The rest fetch the original
vectors and are compared in their bucket by the exact cosine in double precision, so link counts add up over the
tables. Buckets of any size are cut into blocks (groups.py). Every row is indexed. Equal vectors are one item that
counts as often as it occurs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.groups import BLOCK, block_pairs, components, edge_batch, fixed_rows, units
from lexiloom.llm.shared import clear_worker, materialise, small_batches

FIT_ROWS, ITERATIONS, MISS = 20_000, 30, 1e-5
#: Of the items, one in HOT_SAMPLE shows which buckets are large; standard deviations that a code may stray.
HOT_SAMPLE, SLACK = 64, 6


class Codes:
    """Binary codes of unit vectors: `tables` substrings of `bits` bits."""

    def __init__(self, sample: np.ndarray, threshold: float, bits: int, miss: float = MISS, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.dim, self.bits = sample.shape[1], bits
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        turned = (sample - self.mean) @ self.axes
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        moved = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.maximum(length, 1e-12)
        moved_turned = (moved - self.mean) @ self.axes
        self.rotations: list[np.ndarray] = []
        self.tables, agree = 0, []
        while not self.tables:
            r = self._rotation(turned, rng)
            self.rotations.append(r)
            a, b = turned @ r >= 0, moved_turned @ r >= 0
            agree.append(a == b)
            same = np.concatenate(agree, axis=1)
            got = same.shape[1] // bits
            if got:
                hit = same[:, : got * bits].reshape(len(sample), got, bits).all(axis=2)
                p = min(0.999, max(float(hit.mean()), 1e-3))
                need = math.ceil(math.log(miss) / math.log(1 - p))
                if need <= got:
                    self.tables = need
        self.width = len(self.rotations) * self.dim
        differ = (~same).sum(axis=1)
        self.near = math.ceil(differ.mean() + SLACK * max(1.0, differ.std()))  # bits in which linked codes may differ

    @staticmethod
    def _rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        return r

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """bool (vectors, width)."""
        turned = (unit - self.mean) @ self.axes
        return np.concatenate([turned @ r >= 0 for r in self.rotations], axis=1)

    def keys(self, code: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each table."""
        cut = code[:, : self.tables * self.bits].reshape(len(code), self.tables, self.bits)
        value = (cut * (np.int64(1) << np.arange(self.bits, dtype=np.int64))).sum(axis=2)
        return value + (np.arange(self.tables, dtype=np.int64) << 40)

    @staticmethod
    def packed(code: np.ndarray) -> np.ndarray:
        """The code as 64-bit words, padded by zeros."""
        return np.ascontiguousarray(np.packbits(np.pad(code, ((0, 0), (0, -code.shape[1] % 64))), axis=1)).view(np.uint64)

    def first_table(self, differ: np.ndarray) -> np.ndarray:
        """The first table in which each of some pairs agrees, from the words in which they differ; 0 if there is none."""
        out = []
        for a in range(0, len(differ), 16_384):
            part = np.ascontiguousarray(differ[a : a + 16_384]).view(np.uint8)
            bits = np.unpackbits(part, axis=1, count=self.tables * self.bits).reshape(len(part), self.tables, self.bits)
            out.append(bits.any(axis=2).argmin(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.itemsize * rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double precision) of the rows that have `dim` components and a direction."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
    rows = np.flatnonzero(lengths == dim)
    x = flat[(np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(dim)]
    top = np.abs(x).max(axis=1, initial=0)
    fine = np.isfinite(top) & (top > 0)
    x = x[fine] / top[fine, None]
    return rows[fine], x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, threshold: float, fit_rows: int = FIT_ROWS) -> Codes | None:
    """Codes from a sample of at most fit_rows usable vectors; None if there are none."""
    usable = vectors.filter(F.size("embedding") > 0)
    n = usable.count()
    length = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return None
    dim = length[0]["d"]
    sample = usable.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").toArrow()
    _, unit = unit_rows(sample.column("embedding").combine_chunks(), dim)
    if not len(unit):
        return None
    return Codes(unit, threshold, min(28, max(8, round(math.log2(n)) - 2)))


def near_entries(keyed: DataFrame, codes: Codes) -> DataFrame:
    """(key, item) of the entries of keyed (key, item, code) in a pair of their table whose codes are near.

    Buckets that a sample of the items finds large are cut into blocks; one that it doesn't find is only slower.
    """
    sampled = keyed.filter(F.pmod(F.xxhash64(F.lit(64), "item"), F.lit(HOT_SAMPLE)) == 0)
    hot = materialise(sampled.groupBy("key").agg((F.count(F.lit(1)) * HOT_SAMPLE).alias("size")).filter(F.col("size") > BLOCK), "embedding-hot")
    sized = keyed.withColumn("size", F.lit(1).cast("long"))
    if not hot.isEmpty():
        sized = keyed.join(hot, "key", "left").withColumn("size", F.coalesce("size", F.lit(1)))

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in units(chunks, ("key", "bi", "bj")):
            key, items, bi, bj, side = (table.column(c).to_numpy() for c in ("key", "item", "bi", "bj", "side"))
            code = fixed_rows(table.column("code"), np.uint64)
            on, i, d = np.zeros(len(key), bool), np.arange(len(key)), 1
            while len(i := i[: np.searchsorted(i, len(key) - d)]):
                j = i + d
                i = i[(key[i] == key[j]) & (bi[i] == bi[j]) & (bj[i] == bj[j])]
                pair = i[(bi[i] == bj[i]) | (side[i] != side[i + d])]
                pair = pair[np.bitwise_count(code[pair] ^ code[pair + d]).sum(axis=1) <= codes.near]
                pair = pair[codes.first_table(code[pair] ^ code[pair + d]) == key[pair] >> 40]
                on[pair] = on[pair + d] = True
                d += 1
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(items[on])], names=["key", "item"])

    return block_pairs(sized, "key", "size", "item").mapInArrow(task, "key long, item long").distinct()


def links_in(dealt: DataFrame, codes: Codes, threshold: float) -> DataFrame:
    """(a, b, n): for each unit a spanning forest of its links as ids (a, b, null), and (item, null, n): vectors linked with it."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in units(chunks, ("key", "bi", "bj")):
            items, ids, side, times, bi, bj = (table.column(c).to_numpy() for c in ("item", "id", "side", "times", "bi", "bj"))
            at = table.column("key").to_numpy() >> 40
            unit, code = fixed_rows(table.column("unit"), np.float64), fixed_rows(table.column("code"), np.uint64)
            edges, who, n = [], [], []
            for a, b in bounds:
                i, j = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= threshold, 1))
                if bi[a] != bj[a]:
                    across = side[a + i] != side[a + j]
                    i, j = i[across], j[across]
                own = codes.first_table(code[a + i] ^ code[a + j]) == at[a]
                i, j = i[own], j[own]
                who += [items[a + i], items[a + j]]
                n += [times[a + j], times[a + i]]
                label = np.arange(b - a)
                while len(i):  # the first of the pairs that aren't connected yet
                    edges.append((ids[a + i[0]], ids[a + j[0]]))
                    label[label == label[j[0]]] = label[i[0]]
                    apart = label[i] != label[j]
                    i, j = i[apart], j[apart]
            e = edge_batch(edges)
            yield pa.RecordBatch.from_arrays([e.column("a"), e.column("b"), pa.nulls(e.num_rows, pa.int64())], names=["a", "b", "n"])
            one, back = np.unique(np.concatenate(who), return_inverse=True)
            total = np.zeros(len(one), np.int64)
            np.add.at(total, back, np.concatenate(n))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.nulls(len(one), pa.int64()), pa.array(total)], names=["a", "b", "n"])

    return dealt.mapInArrow(task, "a long, b long, n long")


def embedding_links(vectors: DataFrame, threshold: float = 0.95, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors that are null, empty, zero, hold null or non-finite components, or have another length than most, link with
    nothing. Rows with the same vec_id count as one node: their links go together, n_links adds up. Rows without id have no links,
    component_id null, and are kept. An empty table gives no rows; extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    codes = fit(rows, threshold, fit_rows)
    if codes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def encode(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for chunk in chunks:
            at, unit = unit_rows(chunk.column("embedding"), codes.dim)
            if len(at):
                code = codes.encode(unit)
                digests = pa.array([hashlib.blake2b(u, digest_size=16).digest() for u in unit], pa.binary())
                keys = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * codes.tables, codes.keys(code).ravel())
                columns = [chunk.column("vec_id").take(pa.array(at)), digests, keys, fixed_binary(codes.packed(code)), fixed_binary(unit)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "digest", "keys", "code", "unit"])

    small_batches(vectors.sparkSession)
    coded = materialise(rows.filter("vec_id is not null").mapInArrow(encode, "vec_id long, digest binary, keys array<long>, code binary, unit binary"), "embedding-codes")
    classes = materialise(coded.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times")), "embedding-classes")
    lead = materialise(coded.join(classes, "digest").filter("vec_id = id").dropDuplicates(["digest"]).select("id", "digest", "times", "keys", "code", "unit"), "embedding-leads")
    # of two vectors that share an id, each is an item
    lead = materialise(lead.withColumn("item", F.monotonically_increasing_id()), "embedding-items")
    active = materialise(near_entries(lead.select(F.explode("keys").alias("key"), "item", "code"), codes), "embedding-near")
    sizes = active.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    members = active.join(sizes, "key").join(lead.select("item", "id", "times", "code", "unit"), "item")
    links = materialise(links_in(block_pairs(members, "key", "size", "item"), codes, threshold), "embedding-links")
    counts = links.filter("b is null").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("others"))
    # all members of a class share its links; rows that share an id tie their classes together
    ties = coded.join(classes, "digest").filter("vec_id != id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    whole = components(links.filter("b is not null").select("a", "b").unionByName(ties), "embedding-components")
    own = coded.select("vec_id", "digest").join(lead.select("digest", "item", "times"), "digest").join(counts, "item", "left")
    own = own.groupBy("vec_id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.select("vec_id").join(own, "vec_id", "left").join(whole.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
