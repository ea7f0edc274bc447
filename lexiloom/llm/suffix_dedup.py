"""Operator 4, removal of repeated byte strings by suffix arrays (suffix_array.py sorts them by linear grouping).

Which windows of LENGTH bytes repeat anywhere is decided exactly, without one suffix array over everything:

1. Every window has an anchor, its leftmost smallest hash of GRAM bytes. Equal windows have equal anchors at the same
   distance. Windows of a text with the same anchor follow one another: their union is a segment. Only hashes move.
2. An anchor met once holds no repeated window. Equal segments, told by 128-bit digests, are one kind.
3. The kinds of an anchor are gathered, one segment of each, two where it occurs again; a suffix array over them tells
   which of their windows repeat.
4. An anchor with more than KINDS segments would be too much for one task. Its windows are counted by their digests
   instead, each on its own: exact, and in proportion to the kinds' bytes.
5. The repeated windows of every kind go back to all its places; the bytes they cover are removed.

Shorter passages aren't removed, but reported: as the bytes of an anchor's kinds lie side by side in step 3 and 4, their
runs of PASSAGE_WORDS whole words about the anchor are compared as well. A passage of fewer than `length` bytes is found
where its smallest gram is the anchor in two texts, which is the likelier the longer it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.groups import units
from lexiloom.llm.shared import clear_worker, materialise, small_batches
from lexiloom.llm.suffix_array import repeated_windows
from lexiloom.llm.texts import RangeHashes, powers

LENGTH, GRAM = 400, 32
#: Words of a passage that is reported, though it may be too short to be removed.
PASSAGE_WORDS = 50
#: Window starts handled at a time, below 2**22; a longer text is cut, with overlaps.
BATCH = 1 << 20
#: Most segments of an anchor that one suffix array sorts; bytes sorted at a time.
KINDS, SORT_BYTES = 2048, 400_000
_POSITION = np.uint64((1 << 22) - 1)


def digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of each as two 64-bit numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def segments_of(data: bytes, bounds: list[tuple[int, int]], length: int, gram: int, both) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor, anchor hash, two digests) of the segments of texts data[a:b]."""
    at = np.arange(max(0, len(data) - gram + 1))
    plain = RangeHashes(np.frombuffer(data, np.uint8), both).of(at, at + gram)
    low = (plain & ~_POSITION) | np.arange(len(plain)).astype(np.uint64)  # the leftmost of equal hashes is the smallest
    span, wide = length - gram + 1, 1
    while wide * 2 <= span:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if span > wide and len(low) > span - wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    anchor = (low & _POSITION).astype(np.int64)
    starts = [np.arange(a, b - length + 1) for a, b in bounds if b - a >= length]
    if not starts:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    own = np.concatenate(starts)
    text = np.repeat([k for k, (a, b) in enumerate(bounds) if b - a >= length], [len(s) for s in starts])
    pick = anchor[own]
    new = np.ones(len(own), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    count = np.diff(np.append(i, len(own)))
    first = own[i]
    d = digests([data[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)])
    return text[i], first, count, pick[i], plain[pick[i]].view(np.int64), d[:, 0], d[:, 1]


def pieces_of(texts: list[bytes], length: int, most: int = BATCH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (text number, offset, bytes) with about `most` bytes; cuts overlap so that each window is in one piece."""
    batch, size = [], 0
    for k, t in enumerate(texts):
        for off in range(0, max(1, len(t) - length + 1), most):
            piece = t[off : off + most + length - 1]
            if batch and size + len(piece) > most + length:
                yield batch
                batch, size = [], 0
            batch.append((k, off, piece))
            size += len(piece)
    if batch:
        yield batch


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): rows by doc_id and text; equal rows have equal keys, and both count as places."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "doc_id", "text")


def segment_table(rows: DataFrame, length: int, gram: int, most: int = BATCH) -> DataFrame:
    """(k1, k2, start, windows, lead, anchor, d1, d2) of every segment; lead: bytes before the anchor."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        both = powers(most + 2 * length + 8)
        for chunk in chunks:
            k1, k2 = (chunk.column(c).to_numpy() for c in ("k1", "k2"))
            for batch in pieces_of(chunk.column("text").cast(pa.binary()).to_pylist(), length, most):
                ends = np.cumsum([len(p) for *_, p in batch])
                bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
                data = b"".join(p for *_, p in batch)
                k, first, count, at, anchor, d1, d2 = segments_of(data, bounds, length, gram, both)
                if len(k):
                    row = np.array([r for r, *_ in batch])[k]
                    start = first - np.array([a for a, _ in bounds])[k] + np.array([o for _, o, _ in batch])[k]
                    columns = [k1[row], k2[row], start, count.astype(np.int32), (at - first).astype(np.int32), anchor, d1, d2]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "start", "windows", "lead", "anchor", "d1", "d2"])

    return rows.mapInArrow(task, "k1 long, k2 long, start long, windows int, lead int, anchor long, d1 long, d2 long")


def sliced(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """places (k1, k2, start, windows, lead, anchor, kind, size) with the bytes of each: fetched from the texts."""
    wanted = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "windows", "lead", "anchor", "id", "size")).alias("slices"))
    both = rows.join(wanted, ["k1", "k2"]).select("text", "slices")

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            texts = chunk.column("text").cast(pa.binary()).to_pylist()
            slices = chunk.column("slices")
            owner = np.repeat(np.arange(len(texts)), np.diff(slices.offsets.to_numpy()))
            flat = slices.flatten()
            start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            for a in range(0, len(owner), 4096):
                part = slice(a, a + 4096)
                data = pa.array([texts[o][s : s + w + length - 1] for o, s, w in zip(owner[part].tolist(), start[part].tolist(), windows[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(c)[part] for c in ("anchor", "id", "size", "lead")), data], names=["anchor", "id", "size", "lead", "data"])

    return both.mapInArrow(task, "anchor long, id long, size long, lead int, data binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_runs(data: bytes, lead: int, gram: int, words: int) -> list[tuple[int, bytes]]:
    """(distance to the anchor, bytes) of each run of so many whole words that holds the anchor; the first and last word may be cut."""
    at = [m.span() for m in _WORD.finditer(data)][1:-1]
    return [(s - lead, data[s:e]) for (s, _), (_, e) in zip(at, at[words - 1 :]) if s <= lead and e >= lead + gram]


def shared_runs(data: list[bytes], leads: list[int], ids: list[int], gram: int, words: int) -> set[int]:
    """The ids, among kinds of one anchor, that have a run of words in common with another id."""
    first: dict[tuple[int, bytes], int] = {}
    out = set()
    for d, lead, i in zip(data, leads, ids, strict=True):
        for run in word_runs(d, lead, gram, words):
            j = first.setdefault(run, i)
            if j != i:
                out |= {i, j}
    return out


def repeated_parts(gathered: DataFrame, length: int, gram: int, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(anchor, id, w1, w2): the runs of windows of each kind that repeat in another segment of the same anchor.

    Rows without w1 and w2 tell kinds with a run of words that another one has.

    A suffix array takes several anchors together; windows of different anchors differ.
    """

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in units(chunks, ("anchor",)):
            data, leads = table.column("data").to_pylist(), table.column("lead").to_pylist()
            anchors, ids = table.column("anchor").to_numpy(), table.column("id").to_numpy()
            held: list[int] = []
            size = 0
            for k, (a, b) in enumerate(bounds):
                if b - a > 1:
                    held += range(a, b)
                    size += sum(len(data[i]) for i in range(a, b))
                if held and (size >= sort_bytes or k == len(bounds) - 1):
                    found = [(held[j], s, e) for j, f in enumerate(repeated_windows([data[i] for i in held], [leads[i] for i in held], length)) for s, e in zip(*_runs(f), strict=True)]
                    if found:
                        row, s, e = (np.array(c, np.int64) for c in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchors[row], ids[row], s, e)], names=["anchor", "id", "w1", "w2"])
                    held, size = [], 0
            told = [(anchors[a], i) for a, b in bounds if ids[a] != ids[b - 1] for i in shared_runs(data[a:b], leads[a:b], ids[a:b].tolist(), gram, PASSAGE_WORDS)]
            if told:
                columns = [pa.array([int(t[k]) for t in told], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(told), pa.int64())] * 2], names=["anchor", "id", "w1", "w2"])

    return gathered.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(task, "anchor long, id long, w1 long, w2 long")


def repeated_singly(crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with any number of kinds: each window is counted by its digest and its distance to the anchor.

    Runs of words are counted alike, as windows with w = -1.
    """

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            data, lead = chunk.column("data").to_pylist(), chunk.column("lead").to_numpy()
            for a in range(0, len(data), 256):
                some = data[a : a + 256]
                count = np.array([len(t) - length + 1 for t in some])
                own = np.repeat(np.arange(a, a + len(some)), count)
                w = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                d = digests([t[k : k + length] for t, n in zip(some, count.tolist(), strict=True) for k in range(n)])
                told = [(k, place, run) for k, t in enumerate(some, a) for place, run in word_runs(t, int(lead[k]), gram, PASSAGE_WORDS)]
                d = np.concatenate([d, digests([run for *_, run in told])])
                place = np.concatenate([w - lead[own], np.array([p for _, p, _ in told], np.int64)])
                own = np.concatenate([own, np.array([k for k, *_ in told], np.int64)])
                w = np.concatenate([w, np.full(len(told), -1)])
                columns = [chunk.column("anchor").take(pa.array(own)), chunk.column("id").take(pa.array(own)), pa.array(w), pa.array(place), pa.array(d[:, 0]), pa.array(d[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "w", "place", "d1", "d2"])

    key = ["anchor", "place", "d1", "d2"]
    windows = materialise(crowded.mapInArrow(task, "anchor long, id long, w long, place long, d1 long, d2 long"), "suffix-windows")
    many = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    hit = windows.join(many, key, "left_semi").groupBy("anchor", "id").agg(F.array_sort(F.collect_set("w")).alias("ws"))  # a kind has few windows
    windows_of = F.filter("ws", lambda w: w >= 0)
    run = hit.select("anchor", "id", F.posexplode(windows_of).alias("k", "w")).groupBy("anchor", "id", F.col("w") - F.col("k"))
    runs = run.agg(F.min("w").alias("w1"), (F.max("w") + 1).alias("w2")).select("anchor", "id", "w1", "w2")
    none = F.lit(None).cast("long")
    return runs.unionByName(hit.filter(F.array_contains("ws", -1)).select("anchor", "id", none.alias("w1"), none.alias("w2")))


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_kinds: int = KINDS) -> DataFrame:
    """(k1, k2, spans, passage): the spans of each row of keyed(docs) that repeated strings of `length` bytes cover.

    passage: whether a run of PASSAGE_WORDS words was found elsewhere; each row has a span or a passage.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    segments = materialise(segment_table(rows, length, gram), "suffix-segments")
    place = F.struct("k1", "k2", "start", "windows", "lead")
    kinds = segments.groupBy("anchor", "d1", "d2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("one"), F.max(place).alias("other"))
    many = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    kinds = materialise(kinds.join(many, "anchor").withColumn("id", F.xxhash64("d1", "d2")), "suffix-kinds")
    sizes = kinds.groupBy("anchor").agg(F.sum(F.least("times", F.lit(2))).alias("size"))
    both = F.when(F.col("times") > 1, F.array("one", "other")).otherwise(F.array("one"))
    places = materialise(kinds.join(sizes, "anchor").select("anchor", "id", "size", F.explode(both).alias("p")).select("p.*", "anchor", "id", "size"), "suffix-places")
    parts = repeated_parts(sliced(rows, places.filter(F.col("size") <= most_kinds), length), length, gram)
    crowded = places.filter(F.col("size") > most_kinds)
    if not crowded.isEmpty():
        parts = parts.unionByName(repeated_singly(sliced(rows, crowded, length), length, gram))
    repeats = materialise(parts.distinct(), "suffix-repeats")
    at = segments.withColumn("id", F.xxhash64("d1", "d2")).join(repeats, ["anchor", "id"])
    covered = at.select("k1", "k2", (F.col("start") + F.col("w1")).alias("s"), (F.col("start") + F.col("w2") + (length - 1)).alias("e"))
    span = F.when(F.col("s").isNotNull(), F.struct("s", "e"))
    spans = covered.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.some(F.col("s").isNull()).alias("passage"))
    return materialise(spans, "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, passage) of each row: maximal removed runs, and the bytes that stay.

    Texts are their UTF-8 bytes; null counts as empty; windows never cross texts, and a text shorter than `length` has
    none. All bytes of every place of a repeated string go, the first included. Equal rows are places of their own.
    passage: whether something was removed, or a passage of PASSAGE_WORDS words was found elsewhere that is too short.
    Each input row gives one row, rows without id too; an empty table gives none; extra columns are ignored.
    """
    spans = repeated_bytes(docs, length, gram)
    rows = keyed(docs)
    both = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans", F.coalesce("passage", F.lit(False)).alias("passage"))

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            out: list[list] = [[], [], [], []]
            for t, found in zip(chunk.column("text").cast(pa.binary()).to_pylist(), chunk.column("spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for x in found or ():
                    if runs and x["s"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["e"])
                    else:
                        runs.append([x["s"], x["e"]])
                edges = [0, *(x for r in runs for x in r), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, v in zip(out, (len(t), len(t) - len(kept), [{"s": a, "e": b} for a, b in runs], kept), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
            passage = pa.array([p or n > 0 for p, n in zip(chunk.column("passage").to_pylist(), out[1], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), passage], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "passage"])

    return both.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, spans array<struct<s:bigint,e:bigint>>, kept binary, passage boolean")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the bytes that stay; whether the document has a repeated passage, and what stays as text.

    Halves of characters become U+FFFD there.
    """
    found = remove_repeats(docs)
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage").cast("int").alias("repeats_passage"), kept.alias("kept_text"))
