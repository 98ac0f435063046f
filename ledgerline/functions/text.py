"""String helpers as Column expressions (F1, F2, F7-F9). All run JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space for strip().
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove surrounding white space (not only blanks)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def norm_name(c) -> Column:
    """strip + lower: the form used for category / tag / method lookups."""
    return F.lower(strip(c))


def split_list(c, sep: str = ",") -> Column:
    """Split on ``sep``, strip every item, drop empty items. NULL input -> empty array."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), sep)
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != F.lit(""))


def join_list(c, sep: str = ", ") -> Column:
    return F.array_join(_c(c), sep)


def month(c) -> Column:
    """'YYYY-MM' of a date."""
    return F.date_format(_c(c), "yyyy-MM")


def has_duplicates(arr) -> Column:
    return F.size(F.array_distinct(_c(arr))) != F.size(_c(arr))


def float_text(c) -> Column:
    """Double -> text as Python's str(float) prints it: plain notation from 1e-4 up to below
    1e16, else ``d.ddde-05`` with an exponent of two digits at least.

    Spark prints scientific notation ('1.2345678E7', '5.0E-4') from 1e7 up and
    below 1e-3; this moves the decimal point of that form, digit for digit.
    """
    x = _c(c)
    s = x.cast("string")
    whole = F.regexp_extract(s, r"^-?(\d)\.", 1)
    frac = F.regexp_replace(F.regexp_extract(s, r"\.(\d+)E", 1), "^0$", "")
    digits = F.concat(whole, frac)
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.regexp_extract(s, r"^(-?)", 1)
    low = F.substring(digits, exp + 2, F.length(digits))
    large = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), exp + 1), exp + 1, F.lit("0")),
                     F.lit("."), F.when(low == "", F.lit("0")).otherwise(low))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    power = F.concat(F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
                     F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exp).cast("string"))
    sci = F.concat(sign, whole, F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)), power)
    # a comparison first: the usual amounts, plain in Spark too, never meet the patterns above
    usual = ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)) | (x == 0)
    return (F.when(usual, s).when(exp.isNull(), s).when((exp >= 0) & (exp < 16), large)
            .when((exp < 0) & (exp >= -4), small).otherwise(sci))
