"""A corpus from raw documents to packed sequences, in five stages; counted as part of lexiloom.llm.

Each stage reads what its predecessor wrote. All but the last return the columns of documents, extra ones too. The mix is
an order: the files of that stage hold the documents in it, and packing groups consecutive documents of it, so every
group of sequences has the target weights.

Null texts count as empty. Of equal texts, and of near-duplicates, the document with the smallest id stays, and one
without id where none has one; near-duplicates need ids. Empty texts are one group of equal texts. Repeated rows are one
document from the exact stage on. Sources that are null or not listed have a share of the mix. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from lexiloom.llm.shared import materialise, table
from lexiloom.llm.tokens import NARROW


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic from the labelled examples."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.near_dedup(docs, words=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_mix_order(mixing.mix(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence; groups are stretches of the mix where docs come from files."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    try:
        place = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files: no order to keep
        return packing.pack_digest(packing.pack(docs, tokenizer, room=NARROW))
    stretch = F.pmod(F.xxhash64("file", F.floor(F.col("row") / packing.GROUP_DOCS)), F.lit(2**31 - 1))
    grouped = place.select("doc_id", "text", stretch.alias("stretch"))
    return packing.pack_digest(packing.pack(grouped, tokenizer, group_col="stretch", room=NARROW))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Nearest-neighbour votes have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
