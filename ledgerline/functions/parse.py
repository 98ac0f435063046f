"""Parsing of text fields from imports (F4, F6) without exceptions (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import WHITESPACE, strip

# Fixed patterns. A finite number as Python's float() takes it (optional sign,
# '_' between digits, fraction, exponent); a date as YYYY-M-D with a four digit year.
_DIGITS = r"\d(?:_?\d)*"
NUMBER_PATTERN = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(c) -> Column:
    """Text -> double like float(); NULL when it does not parse, and for NaN / infinity."""
    t = strip(_c(c))
    num = F.when(t.rlike(NUMBER_PATTERN), F.regexp_replace(t, "_", "").try_cast("double"))
    # the pattern admits no NaN spelling; an exponent beyond the double range gives infinity
    return F.when(F.abs(num) < F.lit(float("inf")), num)


def parse_date(c) -> Column:
    """'YYYY-M-D' (unpadded month/day allowed) -> date; NULL for impossible dates.

    Like strptime, surrounding blanks are not accepted.
    """
    t = _c(c)
    return F.when(t.rlike(DATE_PATTERN), F.try_to_date(t, "yyyy-M-d"))


_WS = f"[{WHITESPACE}]*"
_ITEM = NUMBER_PATTERN[1:-1]  # the number pattern without its anchors
# a comma-separated list whose non-blank items are all numbers
NUMBER_LIST_PATTERN = rf"^{_WS}(?:{_ITEM})?{_WS}(?:,{_WS}(?:{_ITEM})?{_WS})*$"


def parse_amount_list(text, items) -> Column:
    """The stripped, non-blank ``items`` of ``text`` as doubles, like [float(a) for a in items];
    NULL when any item is not a finite number.

    The whole text is validated with one pattern, so the per-item work is only a
    cast (higher-order functions are evaluated row by row, outside codegen).
    """
    vals = F.transform(_c(items), lambda a: F.regexp_replace(a, "_", "").try_cast("double"))
    ok = _c(text).rlike(NUMBER_LIST_PATTERN) & ~F.exists(vals, lambda v: F.abs(v) == F.lit(float("inf")))
    return F.when(ok, vals)
