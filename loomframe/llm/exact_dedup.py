"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import durable, once, small, text_of, without_rows

#: Code points of a text that the second step hashes.
PREFIX = 256


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Groups of two or more equal texts: _len, _pre, _sha (hex SHA-256), _keep (largest id), _n.

    Step 1 counts byte lengths; step 2 hashes the first `prefix` code points of texts whose length is shared; step 3
    reads the full content only of texts whose length and prefix are shared. Each count is combined before the
    shuffle, so a group with a third of all rows moves one row a task. A table of survivors is broadcast only up to
    a counted size; beyond it the join is shuffled on hashes.

    A null text counts as empty; empty texts equal one another. No rows: no groups.
    """
    rows = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    rows = rows.withColumn("_len", F.octet_length("_text"))
    lengths = durable(rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len"))
    shared = rows.select("_id", "_len", F.xxhash64(F.substring("_text", 1, prefix)).alias("_pre"))
    shared = shared.join(small(lengths), "_len", "left_semi")
    prefixes = durable(shared.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len", "_pre"))
    last = rows.withColumn("_pre", F.xxhash64(F.substring("_text", 1, prefix)))
    few = small(prefixes)
    if few is prefixes:  # too many to broadcast: hash in the scan, so that no text is shuffled
        last = last.select("_id", "_len", "_pre", F.sha2("_text", 256).alias("_sha")).join(prefixes, ["_len", "_pre"], "left_semi")
    else:
        last = last.join(few, ["_len", "_pre"], "left_semi").select("_id", "_len", "_pre", F.sha2("_text", 256).alias("_sha"))
    return last.groupBy("_len", "_pre", "_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null id is smaller than any other. Rows that repeat both id
    and text are one document: all of them carry the same answer (drop_copies leaves one of them). Other columns of
    the input, whatever their names, are ignored.
    """
    groups = small(durable(copy_groups(docs, id_col, text_col).select("_sha", "_keep", "_n")))
    rows = docs.select(docs[id_col].alias("doc_id"), F.sha2(text_of(docs, text_col), 256).alias("text_sha256"))
    out = rows.join(groups, rows["text_sha256"] == groups["_sha"], "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with every column as it was; of rows that repeat id and text
    (null counts as empty), one stays."""
    groups = small(durable(copy_groups(docs, id_col, text_col).select("_sha", "_keep", "_n")))
    rows = docs.select(docs[id_col].alias("_id"), F.sha2(text_of(docs, text_col), 256).alias("_own"), F.xxhash64(text_of(docs, text_col)).alias("_hash"))
    marked = rows.join(groups, rows["_own"] == groups["_sha"], "inner")
    gone = durable(marked.filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_hash").distinct())
    kept = without_rows(docs, gone, id_col, text_col)
    again = marked.filter(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    again = durable(again.select("_id", "_hash"))
    return kept if again.isEmpty() else once(kept, again, id_col, text_col)
