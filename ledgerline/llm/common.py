"""Shared Spark helpers of the operators: table access, written stages, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

#: A side is broadcast only when a count of its rows shows at most this many (rows here are a few hundred bytes).
BROADCAST_ROWS = 100_000
#: A key is heavy when it holds at least 1/HEAVY of all rows: there can be at most HEAVY such keys.
HEAVY = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before those that ``df`` has a column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: later jobs, and tasks retried after a lost executor, read
    the written files instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; otherwise as it is (Spark shuffles it).

    Call it on staged frames: the count is a job.
    """
    return F.broadcast(df) if df.count() <= limit else df


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], size_col: str = "group_size") -> DataFrame:
    """Inner join of rows to their group's row, safe when one group holds a third of all rows.

    ``groups`` has one row per key with the number of left rows in ``size_col``.
    Groups with at least 1/HEAVY of all rows -- at most HEAVY of them, whatever
    the input -- are broadcast; the rest is a shuffle join. Both inputs should be staged.
    """
    total = groups.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    is_heavy = F.col(size_col) * HEAVY >= F.lit(total)
    heavy = groups.filter(is_heavy)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return (left.join(F.broadcast(heavy), keys)
            .unionByName(rest.join(groups.filter(~is_heavy), keys)))


def arrow_batches(spark: SparkSession, rows: int = 2048, mb: int = 16) -> None:
    """Small Arrow batches, so that a batch of very long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
