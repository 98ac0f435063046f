"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one stable id per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import body, fresh, join_groups, staged


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: str = "max") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; a null text counts as the empty text.
    ``keep`` ("max" or "min") says which id of a group stays.

    The 128-bit hash leads the grouping key; the text itself is the last part of
    the key, so the aggregation compares bytes and two texts of one hash stay
    apart. Rows find their group again by the hash and the SHA-256; should two
    different texts ever share both, the query raises instead of merging them.
    Copies are counted map-side before the shuffle, and a group with a large
    share of all rows is joined by broadcast, not in one task.

    Edge cases: rows that repeat id and text are one document and share its
    decision; a group whose ids are all null has ``keep_id`` null and its rows
    are kept; other columns of ``docs`` are ignored; empty input gives no rows.
    """
    text = body(text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", "_text", F.unhex(F.md5("_text")).alias("_h"), F.sha2("_text", 256).alias("_s"))
    best = F.max if keep == "max" else F.min
    texts = keyed.groupBy("_h", "_s", "_text").agg(best("_id").alias("_k"), F.count("*").alias("_n"))
    merged = texts.groupBy("_h", "_s").agg(best("_k").alias("keep_id"), F.sum("_n").alias("group_size"),
                                           F.count("*").alias("_texts"))
    collision = F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("bigint")
    groups = staged(merged.select("_h", "_s", "keep_id", F.when(F.col("_texts") == 1, F.col("group_size"))
                                  .otherwise(collision).alias("group_size")), "exact-groups")
    members = staged(keyed.select("_id", "_h", "_s"), "exact-members")
    return join_groups(members, groups, ["_h", "_s"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_s").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "max") -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep (all columns stay); a row goes by id and text."""
    one, other = fresh(docs, "_id", "_s")
    gone = (exact_duplicates(docs.select(id_col, text_col), id_col, text_col, keep).filter(~F.col("kept"))
            .select(F.col(id_col).alias(one), F.col("text_sha256").alias(other)).distinct())
    mine = F.col(id_col).eqNullSafe(F.col(one)) & (F.sha2(body(text_col), 256) == F.col(other))
    return docs.join(gone, mine, "left_anti").select(*docs.columns)
