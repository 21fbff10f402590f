"""Exact duplicates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letters that case folding takes in.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = False) -> DataFrame:
    """Groups equal texts: by a 128-bit hash, and inside the hash group by the bytes themselves.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. `keep` says which id of a group
    stays, "min" or "max".

    The grouping key is (hash, text): Spark's hash aggregation finds the hash's bucket and then compares bytes, so two
    texts of one hash stay apart. It is combined on the map side, so a text that a third of all rows share is sent once
    per task. The decisions go back to the rows over (hash, SHA-256), a join whose right side has one row per text, which
    adaptive execution can split where one key is hot.

    Null text counts as empty; empty texts are equal to each other. A null id never wins over another id; a group of null
    ids only has keep_id null and all of it is kept. Rows that repeat an id and a text count in group_size and share the
    decision. An empty table gives no rows. Other columns are ignored, whatever they are called.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.translate(text, UPPER, LOWER) if fold_case else text
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", "_text", F.unhex(F.md5("_text")).alias("_hash"))
    best = F.max("_id") if keep == "max" else F.min("_id")
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keys = rows.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    return keys.join(groups, ["_hash", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = False) -> DataFrame:
    """The rows of df that exact_dedup keeps, with all columns of df; rows of equal id and text are one row.

    A row is known by its id and the digest of its text, so null and repeated ids decide for no other text. Only the rows
    that go are joined (an anti join): rows whose text is unique need no partner. Null text counts as empty; very long texts
    are compared whole; an empty table gives no rows. Other columns go through as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.translate(text, UPPER, LOWER) if fold_case else text, 256)
    gone = exact_dedup(df, id_col, text_col, keep, fold_case).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_gone_text"))
    rows = df.withColumn("_digest", digest)
    left = rows.join(gone, F.col("_gone").eqNullSafe(rows[id_col]) & (F.col("_gone_text") == F.col("_digest")), "left_anti")
    return left.dropDuplicates([id_col, "_digest"]).select(*df.columns)
