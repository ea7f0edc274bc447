"""Tables written in the middle of a plan, to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only used where spark.checkpoint.dir is unset and one process does all the work, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/lexiloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
