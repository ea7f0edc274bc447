"""Operator 3, packing by first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are tokenised and cut at multiples of the sequence length; only the last, shorter piece of each has to share
a sequence. A seeded hash deals documents into groups; Spark sorts a group's pieces by falling length, and the task
places each as it comes: a tournament tree over the bins' free room finds the first bin that has room in log steps. So
a task holds one group's tree and one batch of pieces, however long the documents are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import cell_of, give_back, seeded, small_batches
from lexiloom.llm.tokens import WIDE, Room, shared_cache, text_batches, with_end

SEQUENCE, GROUP_DOCS = 4096, 1024


class FirstFit:
    """Bins of equal capacity. Inner nodes hold the most room of the bins below; bins open as they are needed."""

    def __init__(self, capacity: int, leaves: int = 256):
        self.capacity, self.leaves, self.bins = capacity, leaves, 0
        self.room = [capacity] * (2 * leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the first bin with room for it: the bin, and the offset there."""
        if self.room[1] < length:
            self._grow()
        i, room = 1, self.room
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        b = i - self.leaves
        self.bins = max(self.bins, b + 1)
        offset = self.capacity - room[i]
        room[i] -= length
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return b, offset

    def _grow(self) -> None:
        used = self.room[self.leaves :]
        self.leaves *= 2
        self.room = [self.capacity] * self.leaves + used + [self.capacity] * (self.leaves - len(used))
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, keeps_space: bool = False, carried: tuple[str, ...] = (), room: Room = WIDE) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, group ...): the pieces of each document; ids as little-endian u32 bytes."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids", *carried]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None
        for chunk in chunks:
            cache = cache or shared_cache(tokenizer, keeps_space, room)
            doc_ids, texts = chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()
            more = [chunk.column(c) for c in carried]
            for a, b in text_batches(texts, room):
                flat, per = with_end(*cache.encode(texts[a:b]), end_id)
                data, at, rows, source = flat.astype("<u4").tobytes(), 0, [], []
                for k, n in enumerate(per.tolist()):
                    for s in range(0, n, length):
                        m = min(length, n - s)
                        rows.append((doc_ids[a + k], s, m, n, data[4 * (at + s) : 4 * (at + s + m)]))
                        source.append(a + k)
                    at += n
                taken = pa.array(source, pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(taken) for c in more)], names=names)
                del flat, data, rows, columns
                give_back(collect=False)

    small_batches(docs.sparkSession, room.arrow_bytes)
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"), *(docs[c] for c in carried))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(task, f"doc_id long, start long, length int, doc_tokens long, ids binary{kept}")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 3, group_col: str | None = None, room: Room = WIDE) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): every piece with its place.

    Sequences hold at most `length` ids; offsets are gapless from 0. Each id of a document lies in one piece; null and
    empty texts have one piece, the end id. Documents are grouped by a hash of id and text, repeated rows are packed
    one by one, rows without id too. group_col: a long column of docs that groups them instead, for orders to keep.
    room: what a worker may hold.
    """
    if group_col is None:
        n = docs.select("doc_id").count()
        group = cell_of(seeded(seed, docs["doc_id"], docs["text"]), F.lit(max(1, math.ceil(n / group_docs))))
    else:
        group = docs[group_col].cast("long")
    cut = pieces(docs.select(docs["doc_id"], docs["text"], group.alias("group")), tokenizer, end_id, length, carried=("group",), room=room)
    # equal lengths come in the order of their ids, so that a task that runs again gives the same bins
    dealt = cut.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", F.crc32("ids"))

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, FirstFit(length)
        for chunk in chunks:
            bins, offsets = [], []
            for g, m in zip(chunk.column("group").to_pylist(), chunk.column("length").to_pylist(), strict=True):
                if g != now:
                    now, fit = g, FirstFit(length)
                b, offset = fit.place(m)
                bins.append((g << 32) | b)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "ids")), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    return dealt.mapInArrow(task, "doc_id long, start long, length int, doc_tokens long, ids binary, sequence_id long, offset long")


def pack_digest(packed: DataFrame) -> DataFrame:
    """The contract's columns, from the packed ids."""
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
