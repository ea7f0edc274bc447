"""Operator 8, MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one from the start.
MinHash values in bands give the buckets; within a bucket, candidates are compared by odd sketches: each of SAMPLES
minima (the least hash of each cell of one permutation) flips one bit of a bitmap of SKETCH_BITS, so that the bits in
which two bitmaps differ count the minima that they don't share, the more exactly the more similar the sets are. What
may reach the threshold is confirmed on the full sets (groups.py tells how, without pair tables).

The number of bands follows from the threshold: a pair at it shares no bucket with a probability of MISS at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.groups import block_pairs, components, fixed_rows, forest, repeated
from lexiloom.llm.shared import clear_worker, give_back, materialise, small_batches
from lexiloom.llm.texts import batches, mixed

ROWS, MISS = 4, 1e-6
SAMPLES, SKETCH_BITS = 512, 1024
#: Standard deviations that the sketch's estimate may fall short of the threshold.
SLACK = 6
#: Ids that may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The bytes of text turned into sets at a time.
BATCH_BYTES = 1_000_000

_PLACE = np.random.default_rng(8).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 16


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of bytes data, A-Z as a-z; words end at 0x20 and 0x09 to 0x0D.

    A word of LONG_WORD bytes or less is two numbers, which are mixed; a longer one has 64 bits of its BLAKE2b digest.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    at = starts[:, None] + np.arange(LONG_WORD)
    cells = np.concatenate([lower, np.zeros(LONG_WORD, np.uint8)])[at]
    cells[np.arange(LONG_WORD) >= size[:, None]] = 0
    halves = cells.view("<u8")
    hashes = mixed(mixed(halves[:, 0] + size.astype(np.uint64) * _STEP) + halves[:, 1])
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        raw = lower.tobytes()
        digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        hashes[long] = np.frombuffer(digests, "<u8")
    return starts, hashes


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    starts, hashes = word_hashes(data)
    cut = np.searchsorted(starts, [*begin.tolist(), len(data) + 1])
    runs = hashes[: max(0, len(hashes) - words + 1)] * _PLACE[0]
    for k in range(1, words):
        runs = runs + hashes[k : k + len(runs)] * _PLACE[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([np.bitwise_xor.reduce(mixed(hashes[a:b] * _PLACE[: b - a] + np.uint64(b - a)))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    return batches(map(len, texts), BATCH_BYTES)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999) ** rows))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One key for each band of each set (none may be empty)."""
    rng = np.random.default_rng(4)
    factors = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * rows, np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.zeros((len(sets), bands), np.uint64)
    for k, (f, s) in enumerate(zip(factors, shifts, strict=True)):
        low = np.minimum.reduceat(flat * f + s, starts)
        keys[:, k // rows] = mixed(keys[:, k // rows] * _STEP + low)
    return keys ^ mixed(np.arange(1, bands + 1, dtype=np.uint64))


def odd_sketch(hashes: np.ndarray) -> tuple[bytes, int]:
    """The parity bitmap of a sorted set's minima, and how many minima there are."""
    cell = hashes >> np.uint64(64 - SAMPLES.bit_length() + 1)
    first = np.ones(len(hashes), bool)
    first[1:] = cell[1:] != cell[:-1]
    bits = (mixed(hashes[first] ^ _STEP) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH_BITS) % 2 == 1).tobytes(), int(first.sum())


def sketch_passes(threshold: float):
    """Whether two sketches leave it open that the sets reach the threshold."""

    def of(table: pa.Table):
        sketch, minima = fixed_rows(table.column("sketch"), np.uint64), table.column("minima").to_numpy()

        def similar(i: int, js: np.ndarray) -> np.ndarray:
            differ = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1)
            apart = -SKETCH_BITS / 2 * np.log(1 - np.minimum(2 * differ / SKETCH_BITS, 0.999))
            most = np.maximum(minima[js], minima[i])
            shared = (minima[js] + minima[i] - apart) / 2
            slack = SLACK * 1.35 * np.sqrt(threshold * (1 - threshold) / most)
            return shared >= (threshold - slack) * most

        return similar

    return of


def features(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, digest, keys, sketch, minima) of each document; what a document without words has is null."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for chunk in chunks:
            ids, texts = chunk.column("doc_id"), chunk.column("text").cast(pa.binary()).to_pylist()
            for a, b in text_batches(texts):
                sets = shingle_sets(texts[a:b], words)
                full = [s for s in sets if len(s)]
                keys = iter(signatures(full, bands, rows).view(np.int64).tolist() if full else [])
                sketches = [odd_sketch(s) if len(s) else (None, None) for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([s for s, _ in sketches], pa.binary()), pa.array([m for _, m in sketches], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "keys", "sketch", "minima"])
                del sets, full, keys, sketches, columns
        give_back()

    rows_in = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows_in.mapInArrow(task, "doc_id long, n long, digest binary, keys array<long>, sketch binary, minima int")


def full_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(id, cluster, size, hashes) of the documents in members (id, cluster, size)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    few = members.count() <= BROADCAST_IDS
    chosen = rows.join(F.broadcast(members) if few else members, "id")

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for chunk in chunks:
            texts = chunk.column("text").cast(pa.binary()).to_pylist()
            for a, b in text_batches(texts):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts[a:b], words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(chunk.column(c).slice(a, b - a) for c in ("id", "cluster", "size")), sets], names=["id", "cluster", "size", "hashes"])
                del sets
        give_back()

    return chosen.mapInArrow(task, "id long, cluster long, size long, hashes binary")


def set_passes(num: int, den: int):
    """Whether den * |A & B| >= num * |A | B| on full sets."""

    def of(table: pa.Table):
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)

        def similar(i: int, js: np.ndarray) -> np.ndarray:
            able = den * np.minimum(sizes[js], sizes[i]) >= num * np.maximum(sizes[js], sizes[i])
            out, chosen = np.zeros(len(js), bool), js[able]
            if len(chosen) and sizes[i]:
                flat, own = np.concatenate([sets[j] for j in chosen]), sets[i]
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes[chosen]) - sizes[chosen])
                out[able] = den * both >= num * (sizes[chosen] + sizes[i] - both)
            return out

        return similar

    return of


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: documents linked by a Jaccard similarity of num/den or more.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows with the same
    doc_id count as one document: whatever one of them is linked with, all are. Rows without id are linked with
    nothing, component_id is null and they are kept. Each input row gives one row; an empty table gives none; extra
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    threshold = num / den
    found = materialise(features(docs, words, bands_for(threshold, rows), rows), "near-features")
    named = found.filter("digest is not null and doc_id is not null")
    classes = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "near-classes")
    lead = materialise(named.join(classes.select("digest", "id"), "digest").filter("doc_id = id").dropDuplicates(["digest"]).select("id", "keys", "sketch", "minima"), "near-leads")
    keyed = lead.select(F.explode("keys").alias("key"), "id")
    dealt = block_pairs(repeated(keyed).join(lead.drop("keys"), "id"), "key", "size", "id")
    clusters = materialise(components(forest(dealt, sketch_passes(threshold), "key"), "near-clusters"), "near-clusters")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = materialise(clusters.join(sizes, "component").select("id", F.col("component").alias("cluster"), "size"), "near-members")
    sets = full_sets(docs, members, words).filter(F.length("hashes") > 0)
    links = forest(block_pairs(sets, "cluster", "size", "id"), set_passes(num, den), "cluster")
    shared = named.join(classes, "digest").filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count() > 0
    if twice:  # rows that share an id tie their classes together
        linked = components(links.unionByName(shared), "near-components")
        own = found.join(linked.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("id", F.col("doc_id"))
    else:
        linked = components(links, "near-components")
        own = found.join(classes, "digest", "left").join(linked, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one stays for each group of near-duplicates: that with the smallest doc_id."""
    gone = materialise(near_duplicates(docs, words, num, den).filter("not kept").select("doc_id").distinct(), "near-gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
