"""Operator 1, exact dedup with a heavy-hitter split [native: DataFrame functions only].

1. One scan turns each text into the SHA-256 of its normalised form; only (id, digest) goes on.
2. approx_top_k summarises the digests: its frequent-items sketch is the Misra-Gries counter summary
   with decrements in batches, built per task and merged. Every digest with more than N / CANDIDATES rows is in it.
3. The candidates are counted exactly; those above the bound are the winners. Fewer than CANDIDATES can be, whatever
   the input, so they are broadcast and their rows get their keeper on the map side, without a shuffle.
4. The remaining digests (at most N / CANDIDATES rows each) are grouped and joined by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import materialise, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
#: Frequent digests looked for, and counters of a summary. 8192 counters leave an error of N * 3.5 / 8192 < N / 1024.
CANDIDATES, COUNTERS = 1024, 8192


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row_no) of every row; row_no tells repeated rows apart."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def heavy_digests(digests: DataFrame, candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """(digest, first, group_size) of the digests with more than N / candidates rows; fewer than candidates rows."""
    tracked = digests.select(F.xxhash64("digest").alias("h"))
    summary = tracked.agg(F.expr(f"approx_top_k(h, {candidates}, {counters})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = summary.select(F.explode("top").alias("t"), "n").select(F.col("t.item").alias("h"), "n")
    hits = digests.withColumn("h", F.xxhash64("digest")).join(F.broadcast(found), "h")
    return hits.groupBy("digest").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"), F.max("n").alias("n")).filter(F.col("group_size") * candidates > F.col("n")).drop("n")


def first_row() -> Column:
    """The row that stays: smallest id, null ids last, then the first of repeated rows."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = CANDIDATES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. A row without id stays only if its whole group has none, with keep_id null. Of repeated
    rows (same id, equal text) each is reported and counted, exactly one can be kept. An empty table gives no rows.
    Extra columns are ignored.
    """
    digests = materialise(digest_table(docs, id_col, text_col), "dedup-digests")
    winners = materialise(heavy_digests(digests, candidates), "dedup-winners")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
    marked = digests.join(F.broadcast(winners), "digest").unionByName(light.join(groups, "digest"))
    return marked.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("first.row_no")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that share id and text count as one document; if they differ in other columns, any one of them stays.
    """
    kept = dedup_report(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    kept = materialise(kept, "dedup-kept")
    same = docs[id_col].eqNullSafe(kept.kept_id) & (F.unhex(F.sha2(normalised(docs[text_col]), 256)) == kept.kept_digest)
    ids = docs.select(id_col)
    repeated = ids.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    rows = docs.join(kept, same, "left_semi")
    return rows.dropDuplicates([id_col, text_col]) if repeated else rows
