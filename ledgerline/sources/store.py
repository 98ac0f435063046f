"""Storing the result of a load or change: plain Parquet folders, new rows appended.

A ledger lies under ``<root>/<table>/load_id=<n>/``, facts further by month and
the rows that hang on an expense by blocks of its id (:func:`ledgerline.schema.write_table`).

* A load or an addition writes its new rows into folders of its own load id and the
  highest ids it gave beside them; nothing else is read or rewritten. Read the
  ledger with ``Ledger.read(spark, root, before=n)``, judge the batch, append as
  load ``n``: a repeated run judges against the same rows and replaces its own folders.
* An update or delete also names the keys whose stored rows go. Only the folders
  that hold such a key are rewritten, from a copy staged in the shared folder. Both
  halves are staged first, so :func:`apply_staged` may be repeated until it ends.

* ``id_blocks`` names the folders that hold ids of a block; keys that are expense ids open those folders only.
* :func:`fold` rewrites the small folders of many loads as one load, also from a staged copy.

One writer at a time; the caller gives the load ids in increasing order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerline.schema import (BLOCK, EXPENSE_KEY, ID_COLUMNS, ID_MARKS_SCHEMA, INDEX, INDEX_KEY, INDEX_SCHEMA, LOAD, PARTITION_BY,
                               TABLES, block_of, conform, folder_of, index_block, max_ids, stored_schema, write_index,
                               write_marks, write_table)
from ledgerline.session import scratch_path


def append_rows(root: str, load: int, added: dict[str, DataFrame]) -> None:
    """Write the new rows of each table as load ``load``; a repeated call replaces only that load's folders."""
    for t in TABLES:
        if t in added:
            write_table(added[t], t, f"{root}/{t}/{LOAD}={load}", "overwrite")
    marks = max_ids({t: df for t, df in added.items() if t in ID_COLUMNS})
    if marks is not None:
        write_marks(marks, f"{root}/id_marks/{LOAD}={load}", "overwrite")
    held = [t for t in added if t in INDEX_KEY]
    if held:
        spark = added[held[0]].sparkSession
        if _index(spark, root) is not None:  # a ledger stored without an index goes on without one
            write_index(spark, root, load, held)


def _index(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(StructType([*INDEX_SCHEMA.fields, StructField(LOAD, LongType())])).parquet(f"{root}/{INDEX}")
    except AnalysisException:
        return None


def _in_folders(by: list[str], folders: list) -> Column:
    """Whether a stored row lies in one of ``folders``: a single hashed test of its folder columns, so it prunes them."""
    return F.concat_ws("/", *[F.col(c).cast("string") for c in by]).isin(["/".join(str(r[c]) for c in by) for r in folders])


def folders_with(spark: SparkSession, root: str, table: str, keys: DataFrame, load: int) -> DataFrame:
    """Rows of ``table`` before ``load`` in the folders that may hold a row of ``keys``.

    Keys that are expense ids are looked up in ``id_blocks``, by block; the
    driver gets the folders' names, as any scan lists them. Other keys leave all folders.
    """
    stored = spark.read.schema(stored_schema(table)).parquet(f"{root}/{table}").filter(F.col(LOAD) < F.lit(load))
    index = _index(spark, root) if INDEX_KEY.get(table) in keys.columns else None
    if index is None:
        return stored
    blocks = keys.select(index_block(F.col(INDEX_KEY[table])).alias("block")).distinct()
    part = PARTITION_BY[table]
    found = (index.filter((F.col("table_name") == table) & (F.col(LOAD) < F.lit(load))).join(blocks, "block", "left_semi")
             .select(LOAD, F.col("folder").alias(part)).distinct().collect())
    return stored.filter(_in_folders([LOAD, part], found))


def stage_change(result, folder: str) -> list[str]:
    """Write the new rows and the removed keys of a result under ``folder``; returns the tables with removals."""
    for t, df in result.added.items():
        conform(df, t).write.mode("overwrite").parquet(f"{folder}/added/{t}")
    for t, keys in result.removed.items():
        if EXPENSE_KEY.get(t) in keys.columns:
            keys = keys.withColumn(BLOCK, block_of(F.col(EXPENSE_KEY[t])))  # the key names its folder
        keys.distinct().write.mode("overwrite").parquet(f"{folder}/removed/{t}")
    return [t for t in TABLES if t in result.removed]


def remove_rows(spark: SparkSession, root: str, table: str, keys: DataFrame, load: int) -> None:
    """Rewrite the folders of earlier loads that hold a row of ``keys``, without those rows.

    ``keys`` must not read the table. Folder columns among the keys prune the
    search; the folders found (metadata: one row each) prune the rewrite.
    """
    by = [c for c in (LOAD, PARTITION_BY.get(table)) if c]
    path, schema = f"{root}/{table}", stored_schema(table)
    stored = folders_with(spark, root, table, keys, load)
    found = stored.join(keys, keys.columns, "left_semi").select(*by).distinct().collect()
    if not found:
        return
    kept = (stored.filter(_in_folders(by, found)).join(keys, keys.columns, "left_anti")
            .hint("rebalance", *by).sortWithinPartitions(*by))
    copy = scratch_path(spark, f"kept-{table}")
    kept.write.partitionBy(*by).parquet(copy)
    staged = spark.read.schema(schema).parquet(copy)
    full = {tuple(r) for r in staged.select(*by).distinct().collect()}
    (staged.sortWithinPartitions(*by).write.partitionBy(*by).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))
    nothing = spark.createDataFrame([], schema).drop(*by)
    for r in found:  # folders that lost their last row
        if tuple(r) not in full:
            nothing.write.mode("overwrite").parquet("/".join([path, *(f"{c}={r[c]}" for c in by)]))


def apply_staged(spark: SparkSession, folder: str, root: str, load: int, added: list[str], removed: list[str]) -> None:
    """Put a staged change into the stored ledger; repeat it if it was interrupted."""
    for t in removed:
        remove_rows(spark, root, t, spark.read.parquet(f"{folder}/removed/{t}"), load)
    append_rows(root, load, {t: spark.read.parquet(f"{folder}/added/{t}") for t in added})


def save(result, root: str, load: int) -> None:
    """Store a LoadResult or ChangeResult as load ``load`` of the ledger under ``root``."""
    if not result.removed:
        append_rows(root, load, result.added)
        return
    spark = result.rejects.sparkSession
    folder = scratch_path(spark, f"change-{load}")
    removed = stage_change(result, folder)
    apply_staged(spark, folder, root, load, list(result.added), removed)


# ---------------------------------------------------------------- folding

def stage_fold(spark: SparkSession, root: str, first: int, last: int, folder: str) -> None:
    """Copy the rows of loads ``first`` to ``last`` to ``folder``, in few files per month or block."""
    these = F.col(LOAD).between(first, last)
    for t in TABLES:
        rows = spark.read.schema(stored_schema(t)).parquet(f"{root}/{t}").filter(these)
        write_table(rows, t, f"{folder}/rows/{t}", "overwrite")
        rows.select(LOAD).distinct().write.mode("overwrite").parquet(f"{folder}/loads/{t}")
    marks = spark.read.schema(StructType([*ID_MARKS_SCHEMA.fields, StructField(LOAD, LongType())])).parquet(f"{root}/id_marks")
    write_marks(marks.filter(these), f"{folder}/rows/id_marks", "overwrite")
    marks.filter(these).select(LOAD).distinct().write.mode("overwrite").parquet(f"{folder}/loads/id_marks")


def apply_fold(spark: SparkSession, folder: str, root: str, last: int) -> None:
    """Put a staged fold into the ledger as load ``last``; repeat it if it was interrupted."""
    def replaced(t: str, rows: DataFrame, by: str | None) -> None:
        def put(df: DataFrame, load: int) -> None:
            (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(f"{root}/{t}/{LOAD}={load}")
        put(rows.sortWithinPartitions(by) if by else rows, last)
        for r in spark.read.parquet(f"{folder}/loads/{t}").collect():  # the loads' numbers
            if r[LOAD] != last:
                put(rows.limit(0), r[LOAD])

    for t in TABLES:
        by = PARTITION_BY.get(t)
        fields = [f for f in stored_schema(t).fields if f.name != LOAD]
        replaced(t, spark.read.schema(StructType(fields)).parquet(f"{folder}/rows/{t}"), by)
    replaced("id_marks", spark.read.schema(ID_MARKS_SCHEMA).parquet(f"{folder}/rows/id_marks"), None)
    if _index(spark, root) is not None:
        write_index(spark, root, last, list(INDEX_KEY))


def fold(spark: SparkSession, root: str, first: int, last: int) -> None:
    """Rewrite loads ``first`` to ``last`` of a stored ledger as the one load ``last``.

    The rows stay the same and so does ``Ledger.read``; ``before`` a load between
    the two no longer tells them apart, so fold only loads that will not be repeated.
    The index keeps naming folded folders that are empty now: they cost a look, no row.
    """
    folder = scratch_path(spark, f"fold-{first}-{last}")
    stage_fold(spark, root, first, last, folder)
    apply_fold(spark, folder, root, last)
