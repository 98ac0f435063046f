"""Ledger tables: fixed schemas, the Ledger container, and the declared constraints.

Schemas are never inferred. ``password`` of the users table is not carried:
login is not data work.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField,
                               StructType)


def _schema(*cols: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in cols])


L, S, D, DT = LongType(), StringType(), DoubleType(), DateType()

SCHEMAS: dict[str, StructType] = {
    "users": _schema(("uid", L, False), ("username", S, False), ("role", S, False)),
    "categories": _schema(("cid", L, False), ("category_name", S, False)),
    "payment_methods": _schema(("pid", L, False), ("method", S, False)),
    "expenses": _schema(("eid", L, False), ("uid", L, False), ("amount", D, False),
                        ("cid", L, False), ("pid", L, False), ("date", DT, False),
                        ("description", S, True)),
    "tags": _schema(("tid", L, False), ("tag_name", S, False)),
    "expenses_tags": _schema(("eid", L, False), ("tid", L, False)),
    "groups": _schema(("gid", L, False), ("date_created", DT, False), ("group_name", S, False),
                      ("description", S, True)),
    "user_group": _schema(("uid", L, False), ("gid", L, False)),
    "group_expenses": _schema(("geid", L, False), ("uid", L, False), ("gid", L, False),
                              ("amount", D, False), ("cid", L, False), ("pid", L, False),
                              ("date", DT, False), ("description", S, True)),
    "split_users": _schema(("geid", L, False), ("uid", L, False), ("split_amount", D, False)),
    "group_expense_tags": _schema(("geid", L, False), ("tid", L, False)),
}

TABLES = tuple(SCHEMAS)

# Declared constraints of the ledger (fixed values: they restate the table definitions).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "users": ("uid",),
    "categories": ("cid",),
    "payment_methods": ("pid",),
    "expenses": ("eid",),
    "tags": ("tid",),
    "expenses_tags": ("eid", "tid"),
    "groups": ("gid",),
    "user_group": ("uid", "gid"),
    "group_expenses": ("geid",),
    "split_users": ("uid", "geid"),
    "group_expense_tags": ("geid", "tid"),
}

UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "users": ("username",),
    "categories": ("category_name",),
    "tags": ("tag_name",),
    "groups": ("group_name",),
}

# (table, columns, referenced table, referenced columns)
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("expenses", "uid", "users", "uid"),
    ("expenses", "cid", "categories", "cid"),
    ("expenses", "pid", "payment_methods", "pid"),
    ("expenses_tags", "eid", "expenses", "eid"),
    ("expenses_tags", "tid", "tags", "tid"),
    ("user_group", "uid", "users", "uid"),
    ("user_group", "gid", "groups", "gid"),
    ("group_expenses", "uid", "users", "uid"),
    ("group_expenses", "gid", "groups", "gid"),
    ("group_expenses", "cid", "categories", "cid"),
    ("group_expenses", "pid", "payment_methods", "pid"),
    ("split_users", "geid", "group_expenses", "geid"),
    ("split_users", "uid", "users", "uid"),
    ("group_expense_tags", "geid", "group_expenses", "geid"),
    ("group_expense_tags", "tid", "tags", "tid"),
)

ROLES = ("Admin", "User")

# Surrogate key of each table with generated ids; ids are never reused (see ``id_marks``).
ID_COLUMNS = {"users": "uid", "categories": "cid", "payment_methods": "pid", "expenses": "eid",
              "tags": "tid", "groups": "gid", "group_expenses": "geid"}
ID_MARKS_SCHEMA = _schema(("table_name", S, False), ("max_id", L, False))


def check_constraints() -> dict[str, list[tuple[str, "F.Column"]]]:
    """CHECK constraints per table as (name, condition that must hold)."""
    lower_ok = lambda c: F.col(c) == F.lower(F.col(c))
    return {
        "users": [("role_in_admin_user", F.col("role").isin(*ROLES))],
        "categories": [("category_name_lower", lower_ok("category_name"))],
        "tags": [("tag_name_lower", lower_ok("tag_name"))],
        "expenses": [("amount_non_negative", F.col("amount") >= 0)],
        "group_expenses": [("amount_non_negative", F.col("amount") >= 0)],
        "split_users": [("split_amount_non_negative", F.col("split_amount") >= 0)],
    }


# Folders of a stored table: load_id=<n> first, then this column derived from the row. Facts lie by month;
# rows that hang on an expense lie by blocks of its id, so that a key alone names the folder.
LOAD, MONTH, BLOCK = "load_id", "part_month", "part_block"
ID_BLOCK = 100_000_000
#: A block's rows are written in this many files (about 100 MB each when the block is full), also when there is one block.
BLOCK_FILES = 8
EXPENSE_KEY = {"expenses_tags": "eid", "split_users": "geid", "group_expense_tags": "geid"}
PARTITION_BY: dict[str, str] = {"expenses": MONTH, "group_expenses": MONTH, "expenses_tags": BLOCK,
                                "split_users": BLOCK, "group_expense_tags": BLOCK}

#: ``id_blocks`` names, for every stored table with an expense id, the folders that hold an id of each block of this many ids.
INDEX, INDEX_BLOCK = "id_blocks", 1_000_000
INDEX_KEY = {"expenses": "eid", "group_expenses": "geid", **EXPENSE_KEY}
INDEX_SCHEMA = _schema(("table_name", S, False), ("block", L, False), ("folder", S, False))


def month_of(date: Column) -> Column:
    """Value of ``part_month``: the first day of the month."""
    return F.trunc(date, "month")


def block_of(key: Column) -> Column:
    """Value of ``part_block`` for the id of the expense a row hangs on."""
    return F.floor(key / F.lit(ID_BLOCK)).cast("long")


def partition_column(table: str) -> Column | None:
    """The derived folder column of ``table``, or None if it lies in its load folder only."""
    by = PARTITION_BY.get(table)
    if by is None:
        return None
    return month_of(F.col("date")) if by == MONTH else block_of(F.col(EXPENSE_KEY[table]))


def stored_schema(table: str) -> StructType:
    """Schema of a stored table with its folder columns."""
    by = PARTITION_BY.get(table)
    extra = [StructField(LOAD, L)] + ([StructField(by, DT if by == MONTH else L)] if by else [])
    return StructType(SCHEMAS[table].fields + extra)


@dataclass(frozen=True)
class Ledger:
    users: DataFrame
    categories: DataFrame
    payment_methods: DataFrame
    expenses: DataFrame
    tags: DataFrame
    expenses_tags: DataFrame
    groups: DataFrame
    user_group: DataFrame
    group_expenses: DataFrame
    split_users: DataFrame
    group_expense_tags: DataFrame
    # highest id ever given per table, kept when rows are deleted so ids are not reused
    id_marks: DataFrame | None = None
    # True when id_marks covers every row of every table, so that new ids need no scan of the facts
    marks_current: bool = False
    # partitions of stages dealt by expense, where these should grow with the rows (None: the session's number)
    key_parts: int | None = None

    def keyed(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt by the id of an expense."""
        return df if self.key_parts is None else df.repartition(self.key_parts, key)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_tables(self, **changed) -> "Ledger":
        """The ledger with other tables. Tables with generated ids make the id marks stale
        unless ``marks_current`` is given along with them."""
        if "marks_current" not in changed and any(t in ID_COLUMNS for t in changed):
            changed["marks_current"] = False
        return replace(self, **changed)

    def with_rows(self, **added: DataFrame) -> "Ledger":
        """The ledger with further rows per table; current id marks stay current."""
        tables = {t: conform(self.table(t), t).unionByName(conform(df, t)) for t, df in added.items()}
        marks = max_ids(added)
        if self.marks_current and marks is not None:
            tables["id_marks"] = self.id_marks.unionByName(marks)
        return replace(self, **tables)

    def items(self):
        return [(t, getattr(self, t)) for t in TABLES]

    @staticmethod
    def read(spark: SparkSession, path: str, before: int | None = None) -> "Ledger":
        """Read a stored ledger: ``<path>/<table>/load_id=<n>/...`` parquet with the fixed schema.

        ``before`` reads only the loads before that one: what a load, also a
        repeated one, is judged against. Facts keep ``part_month``, so that date
        filters prune folders.
        """
        def stored(t: str) -> DataFrame:
            df = spark.read.schema(stored_schema(t)).parquet(f"{path}/{t}")
            df = df if before is None else df.filter(F.col(LOAD) < F.lit(before))
            return df.drop(LOAD, BLOCK)

        try:
            marks = spark.read.schema(StructType([*ID_MARKS_SCHEMA.fields, StructField(LOAD, L)])).parquet(f"{path}/id_marks")
            marks = (marks if before is None else marks.filter(F.col(LOAD) < F.lit(before))).drop(LOAD)
            current = marks.select("table_name").distinct().count() == len(ID_COLUMNS)
        except AnalysisException:
            marks, current = None, False
        return Ledger(**{t: stored(t) for t in TABLES}, id_marks=marks, marks_current=current)

    def write(self, path: str, mode: str = "errorifexists", load: int = 0) -> str:
        """Store the whole ledger as load ``load`` of ``path``, with the highest id of every table."""
        for name, df in self.items():
            write_table(df, name, f"{path}/{name}/{LOAD}={load}", mode)
        spark = self.users.sparkSession
        ids = {t: spark.read.schema(stored_schema(t)).parquet(f"{path}/{t}") for t in ID_COLUMNS}
        marks = max_ids(ids)
        if self.id_marks is not None:
            marks = marks.unionByName(self.id_marks)
        write_marks(marks, f"{path}/id_marks/{LOAD}={load}", mode)
        write_index(spark, path, load, list(INDEX_KEY), mode)
        return path

    @staticmethod
    def from_testdata(spark: SparkSession, sf_dir: str) -> "Ledger":
        """The driver's test tables mapped onto a ledger (FIXTURES.md section 2)."""
        from ledgerline.sources.testdata import ledger_from_testdata

        return ledger_from_testdata(spark, sf_dir)

    @staticmethod
    def empty(spark: SparkSession) -> "Ledger":
        return Ledger(**{t: spark.createDataFrame([], SCHEMAS[t]) for t in TABLES})

    @staticmethod
    def from_rows(spark: SparkSession, **rows) -> "Ledger":
        """Small hand-written ledgers for unit tests; missing tables are empty."""
        return Ledger(**{t: spark.createDataFrame(rows.get(t, []), SCHEMAS[t]) for t in TABLES})


# Sort order inside each written file: parquet row-group statistics then let the
# scan skip row groups for the usual filters (a user, a group, a date range).
CLUSTER_BY = {"expenses": ("uid", "date"), "group_expenses": ("gid", "date"), "split_users": ("geid",),
              "expenses_tags": ("eid",), "group_expense_tags": ("geid",), "user_group": ("gid",)}


def write_table(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """Write rows of one table under ``path`` with the fixed schema, sorted within each file.

    Tables with a folder column are first spread by it: Spark splits a folder with many rows
    over several tasks and merges small ones, so each folder gets few files of even size.
    """
    out, by = conform(df, table), PARTITION_BY.get(table)
    if by is not None:
        out = out.withColumn(by, partition_column(table))
        if by == BLOCK:
            out = (out.withColumn("_slice", F.pmod(F.col(EXPENSE_KEY[table]), F.lit(BLOCK_FILES)))
                   .hint("rebalance", by, "_slice").drop("_slice"))
        else:
            out = out.hint("rebalance", by)
    order = [c for c in (by, *CLUSTER_BY.get(table, ())) if c]
    out = out.sortWithinPartitions(*order) if order else out
    (out.write.partitionBy(by) if by else out.write).mode(mode).parquet(path)


def max_ids(rows: dict[str, DataFrame]) -> DataFrame | None:
    """(table_name, max_id) of those frames whose table has generated ids; 0 without rows."""
    out = None
    for t, df in rows.items():
        if t in ID_COLUMNS:
            one = df.agg(F.coalesce(F.max(F.col(ID_COLUMNS[t]).cast("long")), F.lit(0).cast("long")).alias("max_id")).select(
                F.lit(t).alias("table_name"), "max_id")
            out = one if out is None else out.unionByName(one)
    return out


def write_marks(marks: DataFrame, path: str, mode: str) -> None:
    """One row per table."""
    (marks.groupBy("table_name").agg(F.max("max_id").alias("max_id"))
     .select([F.col(f.name) for f in ID_MARKS_SCHEMA.fields]).write.mode(mode).parquet(path))


def folder_of(table: str) -> Column:
    """A stored row's folder below its load, as text."""
    return F.col(PARTITION_BY[table]).cast("string")


def index_block(key: Column) -> Column:
    return F.floor(key / F.lit(INDEX_BLOCK)).cast("long")


def write_index(spark: SparkSession, root: str, load: int, tables: list[str], mode: str = "overwrite") -> None:
    """The blocks of ids that load ``load`` holds, read from the key columns of its written files."""
    rows = spark.createDataFrame([], INDEX_SCHEMA)
    for t in tables:
        held = spark.read.schema(stored_schema(t)).parquet(f"{root}/{t}").filter(F.col(LOAD) == F.lit(load))
        rows = rows.unionByName(held.select(F.lit(t).alias("table_name"), index_block(F.col(INDEX_KEY[t])).alias("block"),
                                            folder_of(t).alias("folder")).distinct())
    rows.write.mode(mode).parquet(f"{root}/{INDEX}/{LOAD}={load}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast the columns of ``table`` in schema order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])
