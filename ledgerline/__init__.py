"""ledgerline: expense-ledger analytics and maintenance as Spark DataFrame jobs.

A ledger is eleven tables (see :mod:`ledgerline.schema`). Every report takes an
optional user / group scope; ``None`` runs the report for every user or group
in one distributed pass.
"""

from ledgerline.schema import Ledger, SCHEMAS  # noqa: F401
from ledgerline.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["Ledger", "SCHEMAS", "get_spark", "checkpoint_dir"]
