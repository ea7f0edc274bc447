"""Helpers that the training-data operators share: scratch tables, seeded hashes, what Python workers keep."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.plans.scratch import materialise, scratch_path  # noqa: F401  one place for tables in the middle of a plan

_KEPT: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one object only, made anew for another key."""
    if key not in _KEPT:
        clear_worker()
        _KEPT[key] = make()
    return _KEPT[key]


def clear_worker() -> None:
    """Gives back what the worker's earlier tasks have kept: called by tasks that keep nothing themselves."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back(collect: bool = True) -> None:
    """Returns freed memory to the system: idle workers would hold it while other stages need it.

    collect=False skips the search for cycles, which reads the whole heap: for loops that make none.
    """
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def spent(*broadcasts: Broadcast) -> None:
    """Drops this process's copies of broadcast values; a later task of the worker loads them again."""
    for b in broadcasts:
        vars(b).pop("_value", None)
    give_back()


def seeded(seed: int, *cols: Column) -> Column:
    """A 64-bit hash of cols that differs with seed; nulls are allowed."""
    return F.xxhash64(F.lit(int(seed)), *cols)


def unit(h: Column) -> Column:
    """A hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(2**53))


def cell_of(h: Column, cells: Column) -> Column:
    """The cell of h when the unsigned 64-bit range is cut into that many equal parts, in order."""
    return F.least(F.floor(unit(h) * cells).cast("long"), cells - 1)


def unsigned(h: Column) -> Column:
    """Maps a hash so that the signed order of the result is the unsigned order of h."""
    return h.bitwiseXOR(F.lit(-(2**63)))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def small_batches(spark: SparkSession, bytes_each: int = 8 << 20) -> None:
    """Bounds the Arrow batches that tasks hand to Python by bytes: ten thousand long texts can be gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
