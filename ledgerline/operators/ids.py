"""Id allocation for new rows: unique, increasing in a given order, after the current maximum.

The rank of a row is computed without a single-partition window over the rows:
the rows are range-partitioned on the order key, numbered inside each
partition, and shifted by the row count of all earlier partitions (a table of
one row per partition, so its broadcast has a proven size bound).

The input is checkpointed to the shared checkpoint folder first: a lost
executor then re-reads the same rows instead of recomputing a possibly
different partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.schema import ID_COLUMNS, ID_MARKS_SCHEMA
from ledgerline.session import checkpoint_dir, staged


def next_id_base(ledger, table: str, rows: DataFrame | None = None) -> DataFrame:
    """One-row frame ``_base``: the highest id the table ever had (0 when none).

    With current id marks (every stored ledger has them) it is read from the
    marks alone; else it is the larger of the current maximum and the mark that
    deletes leave behind (AUTOINCREMENT semantics: ids are not reused).
    ``rows`` overrides the table rows (e.g. a dimension with rows just added).
    """
    id_col = ID_COLUMNS[table]
    if ledger.marks_current and rows is None:
        return (ledger.id_marks.filter(F.col("table_name") == table)
                .agg(F.coalesce(F.max("max_id"), F.lit(0)).cast("long").alias("_base")))
    ids = (rows if rows is not None else ledger.table(table)).select(F.col(id_col).cast("long").alias("_v"))
    if ledger.id_marks is not None:
        ids = ids.unionByName(ledger.id_marks.filter(F.col("table_name") == table)
                              .select(F.col("max_id").alias("_v")))
    return ids.agg(F.coalesce(F.max("_v"), F.lit(0)).cast("long").alias("_base"))


def mark_deleted(ledger, tables: list[str]):
    """Ledger whose id marks remember the highest id of ``tables`` before a delete."""
    if ledger.marks_current:
        return ledger
    spark = ledger.users.sparkSession
    marks = [ledger.table(t).agg(F.max(ID_COLUMNS[t]).cast("long").alias("max_id"))
             .select(F.lit(t).alias("table_name"), "max_id") for t in tables]
    old = ledger.id_marks if ledger.id_marks is not None else spark.createDataFrame([], ID_MARKS_SCHEMA)
    merged = old
    for m in marks:
        merged = merged.unionByName(m.filter(F.col("max_id").isNotNull()))
    merged = merged.groupBy("table_name").agg(F.max("max_id").alias("max_id"))
    return ledger.with_tables(id_marks=merged)


def allocate_ids(rows: DataFrame, order_cols: list[str], id_col: str, base: DataFrame,
                 partitions: int | None = None, stage: bool = False) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, ... in ``order_cols`` order (which must be unique).

    Rows are range-partitioned and sorted inside each partition; the position
    inside the partition comes from ``monotonically_increasing_id`` (partition
    index in the upper bits, row index in the lower ones) of that same sorted
    stage, so no further shuffle is needed. The numbered rows are checkpointed
    once, so partition sizes and the rows they offset come from one
    materialised copy. ``stage`` writes that copy as compressed columns instead
    (of types that parquet has): a fraction of the disk, and of a known size.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    # without an explicit count AQE may merge adjacent range partitions of a small batch;
    # merged partitions stay contiguous and in order, which is all the numbering needs
    ranged = (rows.repartitionByRange(partitions, *order_cols) if partitions
              else rows.repartitionByRange(*order_cols))
    numbered = (ranged.sortWithinPartitions(*order_cols)
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_rn", F.monotonically_increasing_id()
                            - F.shiftleft(F.col("_part").cast("long"), 33) + 1))
    numbered = staged(numbered, "numbered") if stage else numbered.checkpoint(eager=True)
    sizes = numbered.groupBy("_part").agg(F.max("_rn").alias("_n"))
    # one row per partition: a proven bound for the single-partition running sum and the broadcast
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("long").alias("_off"))
    new_id: Column = base.select("_base").scalar() + F.col("_off") + F.col("_rn")
    return (numbered.join(F.broadcast(offsets), "_part")
            .withColumn(id_col, new_id.cast("long")).drop("_part", "_rn", "_off"))
