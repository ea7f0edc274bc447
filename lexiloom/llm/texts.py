"""Texts inside tasks: bounded batches, and hashes of byte ranges by array operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_BYTE = np.random.default_rng(8).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def batches(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to `most` or less; a larger item is a range of its own."""
    start, held, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield start, n - 1
            start, held = n - 1, 0
        held += size
    if start < n:
        yield start, n


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class RangeHashes:
    """64-bit hashes of any range of some bytes, by running sums."""

    def __init__(self, data: np.ndarray, both: tuple[np.ndarray, np.ndarray] | None = None):
        up, self.down = both or powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins; one place more for the end. No text is null."""
    texts = texts.cast(pa.string())  # offsets of 32 bits, whatever the session's setting
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset) if offsets else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of the maximal runs of bytes that are members, within texts that begin at bounds[:-1]."""
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    held = bounds[:-1] < bounds[1:]
    begins, ends = bounds[:-1][held], bounds[1:][held] - 1
    first[begins], last[ends] = member[begins], member[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(bounds, start, side="right") - 1
