"""Operator 2, token ids in binary files of Simple-8b words.

A file holds the documents of one range of ids, in ascending order of doc_id. Its ids are cut into blocks of BLOCK;
each block is coded on its own into 64-bit little-endian words: the top four bits select how many ids of how many bits
the other sixty hold (SELECTORS, lowest id in the lowest bits), selector ESCAPE says that the next word is one raw
64-bit id. The unused places of a block's last word are zero. After the words come the block table (the word at which
each block begins) and the document table, so that a reader can decode any block, or many at once, by array operations.

    b"LXS8" version:u32 | words | block offsets:u64[] | doc_id:i64[] has_id:u8[] n_tokens:u64[] | n_words n_ids n_blocks n_docs:u64 b"LXS8"

Files are written by tasks through pyarrow.fs under names of their own; only the manifest, which Spark commits, says
which count, so a task that ran twice or half leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.shared import give_back, materialise, scratch_path, small_batches
from lexiloom.llm.tokens import shared_cache, text_batches, with_end

MAGIC, VERSION, BLOCK, ESCAPE = b"LXS8", 1, 1024, 15
#: Selector: (ids in a word, bits of each).
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
_COUNT, _BITS = np.zeros(16, np.int64), np.zeros(16, np.uint64)
for _s, (_c, _b) in SELECTORS.items():
    _COUNT[_s], _BITS[_s] = _c, _b
_COUNT[ESCAPE] = 1
#: Documents of a file on average; blocks that a reader decodes at a time.
FILE_DOCS, READ_BLOCKS = 16_384, 512


def _widths(ids: np.ndarray) -> np.ndarray:
    """The bits that each id needs, 1 at least."""
    if ids.max(initial=0) < 2**53:
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(ids.shape, np.uint8)
    for shift in range(1, 64):
        out += (ids >> np.uint64(shift)) > 0
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ids, and how many words each block of BLOCK ids takes."""
    n, row = len(ids), BLOCK + 64
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, row), np.uint64)  # a row for each block; places past its end hold zeros that need no bits
    width = np.zeros((blocks, row), np.uint8)
    full = n // BLOCK
    for into, values in ((padded, np.asarray(ids, np.uint64)), (width, _widths(np.asarray(ids, np.uint64)))):
        into[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
        into[full:, : n - full * BLOCK] = values[full * BLOCK :]
    sizes = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    most = {1: width}  # the widest of the next 1, 2, 4 ... ids
    for k in (1, 2, 4, 8, 16):
        wide = most[k].copy()
        np.maximum(wide[:, : row - k], most[k][:, k:], out=wide[:, : row - k])
        most[2 * k] = wide
    select = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in reversed(SELECTORS):
        c, b = SELECTORS[s]
        k = 1 << (c.bit_length() - 1)
        reach = most[k][:, :BLOCK] if k == c else np.maximum(most[k][:, :BLOCK], most[k][:, c - k : c - k + BLOCK])
        np.minimum(select, (reach > b).view(np.uint8) * np.uint8(ESCAPE) | np.uint8(s), out=select)  # ESCAPE has all bits set
    count, flat = _COUNT.astype(np.int64), select.reshape(-1)
    at, live, begins = np.zeros(blocks, np.int64), np.arange(blocks), np.zeros(blocks * BLOCK, bool)
    while len(live):  # all blocks advance together, a word each at a time
        here = live * BLOCK + at[live]
        begins[here] = True
        at[live] += count[flat[here]]
        live = live[at[live] < sizes[live]]
    lane, first = np.divmod(np.flatnonzero(begins), BLOCK)
    chosen, place, values = flat[lane * BLOCK + first], lane * row + first, padded.reshape(-1)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (c, b) in SELECTORS.items():
        own = np.flatnonzero(chosen == s)
        if len(own):
            w, f = words[own], place[own]
            for j in range(c):
                w |= values[f + j] << np.uint64(j * b)
            words[own] = w
    per = np.bincount(lane, minlength=blocks)
    if len(raw := np.flatnonzero(chosen == ESCAPE)):
        words = np.insert(words, raw + 1, values[place[raw]])
        per = per + np.bincount(lane[raw], minlength=blocks)
    return words, per


def decode_blocks(words: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
    """The n ids of whole consecutive blocks that take per[i] words each."""
    if not n:
        return np.zeros(0, np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(select == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    raw = raw[:-1]
    count = _COUNT[select]
    count[raw] = 0
    ends = np.cumsum(per)
    held = np.add.reduceat(count, ends - per)
    size = np.full(len(per), BLOCK)
    size[-1] = n - BLOCK * (len(per) - 1)
    last = ends - 1
    last = np.where(raw[last], last - 1, last)
    count[last] -= held - size  # the unused places of a block's last word
    word = np.repeat(np.arange(len(words)), count)
    place = (np.arange(n) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    bits = _BITS[select[word]]
    out = (words[word] >> (place * bits)) & ((np.uint64(1) << bits) - np.uint64(1))
    if len(esc := np.flatnonzero((select == ESCAPE) & ~raw)):
        out[(np.cumsum(count) - count)[esc]] = words[esc + 1]
    return out


class TokenWriter:
    """Writes one file, a batch of documents at a time; holds less than a block of ids besides the batch."""

    def __init__(self, stream):
        self.out, self.rest = stream, np.zeros(0, np.uint32)
        self.offsets, self.docs, self.has, self.counts, self.words, self.ids = [], [], [], [], 0, 0
        stream.write(MAGIC + np.array([VERSION], "<u4").tobytes())

    def _put(self, ids: np.ndarray) -> None:
        words, per = encode_blocks(ids)
        self.offsets.append(self.words + np.cumsum(per) - per)
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)

    def add(self, doc_ids: list, flat: np.ndarray, per: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.has.append(np.array([d is not None for d in doc_ids], np.uint8))
        self.counts.append(per.astype("<u8"))
        self.ids += len(flat)
        ids = np.concatenate([self.rest, flat])
        full = len(ids) // BLOCK * BLOCK
        self._put(ids[:full])
        self.rest = ids[full:]

    def close(self) -> tuple[int, int]:
        self._put(self.rest)
        parts = [np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.has, np.uint8), (self.counts, "<u8"))]
        for p in parts:
            self.out.write(p.tobytes())
        self.out.write(np.array([self.words, self.ids, len(parts[0]), len(parts[1])], "<u8").tobytes() + MAGIC)
        return len(parts[1]), self.ids


class TokenReader:
    """Reads one file: the document table at once, the ids by runs of blocks."""

    def __init__(self, stream):
        self.file = stream
        size = stream.size()
        tail = stream.read_at(36, size - 36)
        head = stream.read_at(8, 0)
        if tail[32:] != MAGIC or head != MAGIC + np.array([VERSION], "<u4").tobytes():
            raise ValueError("not a file of token ids, or of another version")
        self.n_words, self.n_ids, self.n_blocks, self.n_docs = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        at = 8 + 8 * self.n_words

        def part(n: int, kind) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = np.frombuffer(stream.read_at(size, at), kind) if n else np.zeros(0, kind)
            at += size
            return out

        self.offsets = part(self.n_blocks, "<u8").astype(np.int64)
        self.docs, self.has, self.counts = part(self.n_docs, "<i8"), part(self.n_docs, np.uint8), part(self.n_docs, "<u8").astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        edges = np.append(self.offsets, self.n_words)[first : last + 1]
        words = np.frombuffer(self.file.read_at(int(8 * (edges[-1] - edges[0])), int(8 + 8 * edges[0])), "<u8").astype(np.uint64)
        return decode_blocks(words, np.diff(edges), min(self.n_ids, last * BLOCK) - first * BLOCK)

    def documents(self, blocks: int = READ_BLOCKS) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
        """(doc_id, ids before it in the file, its ids, those ids in pieces) of each document in order."""
        at, buffer, base, block = 0, np.zeros(0, np.uint32), 0, 0
        for d, has, n in zip(self.docs.tolist(), self.has.tolist(), self.counts.tolist(), strict=True):
            pieces, need, begin = [], n, at
            while need:
                if at - base >= len(buffer):
                    base, buffer = at, self.blocks(block, min(block + blocks, self.n_blocks)).astype("<u4")
                    block += blocks
                piece = buffer[at - base : at - base + need]
                pieces.append(piece)
                at, need = at + len(piece), need - len(piece)
            yield (d if has else None), begin, n, pieces


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, keeps_space: bool = True, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the ids of all documents; returns the manifest (path, part, n_docs, n_ids, start), a row for each file.

    path: a folder that all executors see, by a URI that pyarrow.fs opens; a new one in spark.checkpoint.dir if None.
    Null and empty texts have only the end id. Rows without id come first; rows with equal ids stand beside each other
    in the order of a hash of their texts. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or scratch_path(spark, "tokens")
    path = path if "://" in path else f"file://{path}"
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    parts = max(1, math.ceil(docs.select("doc_id").count() / file_docs))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id()).drop("h")

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        writer = None
        for chunk in chunks:
            if not chunk.num_rows:
                continue
            if writer is None:
                store, folder = fs.FileSystem.from_uri(path)
                store.create_dir(folder, recursive=True)
                part = chunk.column("part")[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.lxs8"
                stream = store.open_output_stream(f"{folder}/{name}")
                writer, cache = TokenWriter(stream), shared_cache(tokenizer, keeps_space)
            ids, texts = chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()
            for a, b in text_batches(texts):
                writer.add(ids[a:b], *with_end(*cache.encode(texts[a:b]), end_id))
                give_back(collect=False)
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    written = materialise(dealt.mapInArrow(task, "path string, part int, n_docs long, n_ids long"), "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for chunk in chunks:
            for uri, start in zip(chunk.column("path").to_pylist(), chunk.column("start").to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(uri)
                rows = []
                with store.open_input_file(place) as file:
                    for doc, begin, n, pieces in TokenReader(file).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.tobytes(), crc)
                        rows.append((doc, start + begin, n, crc))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    count = max(1, files.count())
    return files.repartition(count, "path").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns: documents are written, and read back from the files."""
    return read_tokens(write_tokens(docs, tokenizer, end_id=0))
