"""CSV sources and sinks (S2-S5 file edges).

Readers map the columns of every file by *its own header names* (Spark maps a
file set by the first file's header), keep every field as text, and add ``seq``: an id that increases
in file order, used to order diagnostics and to give new rows their ids.
Writers quote with doubled quotes, keep blanks, write missing values as empty
fields, and write one part file per output partition in sort order;
``single_file=True`` writes everything in one task, so only for small exports.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns the importers read.
EXPENSE_CSV_COLUMNS = ["amount", "category", "payment_method", "date", "description", "tag"]
EXPENSE_CSV_REQUIRED = ["amount", "category", "payment_method", "date"]
GROUP_CSV_COLUMNS = ["group_name", "date_created", "description", "expense_id", "creator_username",
                     "amount", "category_name", "payment_method", "expense_date", "expense_description",
                     "tags", "split_usernames", "split_amounts"]
GROUP_CSV_REQUIRED = ["amount", "category_name", "payment_method", "expense_date"]


def _read_text_csv(spark: SparkSession, paths, multiline: bool = False) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("escape", '"').option("multiLine", multiline)
            .option("mode", "PERMISSIVE").csv(paths))


def _layouts(spark: SparkSession, path: str) -> list:
    """The files of ``path`` grouped by their header line: one row (header, files) per layout.

    One distributed pass over the text finds the first line of every file. The
    driver receives the file names, which it lists for any scan anyway.
    """
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(
        name.alias("file"), "value", F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"))
    heads = (lines.filter(F.col("start") == 0).groupBy("file")
             .agg(F.min_by("value", "line").alias("header")))
    return (heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
            .orderBy(F.col("files")[0]).collect())


def _by_name(df: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"CSV header lacks required columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def _read_by_name(spark: SparkSession, path: str, columns: list[str], required: list[str],
                  multiline: bool) -> DataFrame:
    """Every file is mapped by its own header; files with the same header are read together."""
    parts = [_by_name(_read_text_csv(spark, row.files, multiline), columns, required)
             for row in _layouts(spark, path)]
    if not parts:
        parts = [spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))]
    return functools.reduce(DataFrame.unionByName, parts).select(
        F.monotonically_increasing_id().alias("seq"), *columns)


def read_expense_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Personal import file -> (seq, amount, category, payment_method, date, description, tag)."""
    return _read_by_name(spark, path, EXPENSE_CSV_COLUMNS, EXPENSE_CSV_REQUIRED, multiline)


def read_group_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S3: group import file -> seq + the 13 group columns as text."""
    return _read_by_name(spark, path, GROUP_CSV_COLUMNS, GROUP_CSV_REQUIRED, multiline)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists",
              compression: str = "none") -> str:
    """Write a text frame as CSV with a header; the frame's sort order is kept per part file.

    ``compression`` names a codec of Spark's CSV writer (``gzip``, ...) for files that Spark reads back.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
     .option("emptyValue", "").option("nullValue", "")
     .option("compression", compression).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path
